"""Byte-level BPE encoding and decoding with a given public vocabulary.

Method: the symbols of a word form a doubly linked list; a priority queue holds the merge
rank of every adjacent pair. The lowest rank is merged first, leftmost on ties; an entry
whose symbols have changed since it was pushed is stale and skipped. A word of n bytes costs
O(n log n). Short words that a worker hasn't met yet are merged many at once, in a table with a column per
word: each round merges the leftmost pair of the lowest rank of every word, whose symbols form a linked list too. Decoding
concatenates the vocabulary's strings. A text is first cut at white space
into segments, a run of anything else with the space before it, that no word of the
vocabulary's pattern crosses. Segments recur, so each worker keeps the ids of up to
CACHE_SEGMENTS segments and CACHE_WORDS words, and then starts afresh.

Cases: null text is an empty text: no ids, decoded to the empty string. Added tokens in a
text become their id, as in the vocabulary's own library. Rows are independent, so repeated
rows and ties need no rule, and other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spendspark.llm.frames import with_batches

CACHE_SEGMENTS, CACHE_WORDS = 1 << 18, 1 << 17
CACHED_LENGTH = 64  # longer segments are encoded anew each time
AT_ONCE = 1 << 18  # characters of the texts whose new words are merged at once
ROWS = 1 << 11  # of a table of words, which the processor's cache holds
WIDTHS = (8, 16, 32, 64)  # of the tables, in bytes; longer words go one by one
WIDTH_OF = [next(w for w in WIDTHS if n <= w) for n in range(WIDTHS[-1] + 1)]
LATIN_END = 0x250  # behind the Latin letters
NONE = 1 << 30  # rank of a pair that isn't merged
PLACE_BITS = 6  # of a pair's place in a word of the widest table

# Fixed value: the pattern that splits a text into words before the merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The characters that the pattern's white space stands for.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEGMENTS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

LATIN_WORD = re.compile(f" ?[{''.join(c for c in map(chr, range(LATIN_END)) if c.isalpha())}]+")
RUN = re.compile(f"[{SPACE}][{SPACE}]")


def segments_of(text: str) -> list[str]:
    """The text cut where no word crosses. A text without runs of white space, and without the mark that is put in
    for the cuts, is cut before each space and around each line break."""
    if "\0" in text or RUN.search(text):
        return SEGMENTS.findall(text)
    return [s for s in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if s]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's strings:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Segments(dict):
    """Ids of segments or of words, computed when first asked for."""

    def __init__(self, encode: Callable[[str], list[int]], most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, segment: str) -> list[int]:
        ids = self.encode(segment)
        if len(segment) <= CACHED_LENGTH:
            self.keep({segment: ids})
        return ids

    def keep(self, found: dict[str, list[int]]) -> None:
        if len(self) + len(found) > self.most:
            self.clear()
        self.update(found)


class PairTable:
    """Ranks of many pairs at once, and the symbol that each rank gives."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], byte_ids: list[int]):
        pairs = np.array(list(merges), np.int64).reshape(-1, 2)
        found = np.array(list(merges.values()), np.int64).reshape(-1, 2)
        keys = (pairs[:, 0] << 32) + pairs[:, 1]
        order = np.argsort(keys)
        # a last key that no pair has
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.by_key = np.append(found[order, 0], NONE).astype(np.int32)
        self.result = np.zeros(int(found[:, 0].max(initial=0)) + 1, np.int32)
        self.result[found[:, 0]] = found[:, 1]
        self.ids = np.array(byte_ids, np.int32)
        left, right = np.repeat(self.ids, 256), np.tile(self.ids, 256)
        self.of_bytes = self.ranks(left, right).reshape(256, 256)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it isn't merged or has a symbol under 0."""
        keys = (left.astype(np.int64) << 32) + right
        at = np.searchsorted(self.keys, keys)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.by_key[at], np.int32(NONE))

    def keys_of(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place of each pair as one number, so that the least of a word is the leftmost pair of the lowest rank."""
        ranks = self.ranks(left, right)
        return np.where(ranks < NONE, (ranks << PLACE_BITS) + place, NONE).astype(np.int32)

    def merge(self, words: list[bytes], width: int) -> list[list[int]]:
        """Ids of words of 1 to width bytes. A word is a column; the last line is the end of every word, which has no symbol."""
        n, lengths = len(words), np.array([len(w) for w in words])
        inside = np.arange(width + 1) < lengths[:, None]
        data = np.zeros((n, width + 1), np.uint8)
        data[inside] = np.frombuffer(b"".join(words), np.uint8)
        data, inside = np.ascontiguousarray(data.T), inside.T
        symbols = np.where(inside, self.ids[data], np.int32(-1))
        pair = self.of_bytes[data[:-1], data[1:]]
        keys = np.full((width + 1, n), NONE, np.int32)
        keys[:-1] = np.where(inside[1:] & (pair < NONE), (pair << PLACE_BITS) + np.arange(width, dtype=np.int32)[:, None], NONE)
        # lines are joined to a list: what stands behind and before each place, the end for none
        at, end = np.arange((width + 1) * n).reshape(width + 1, n), width * n + np.arange(n)
        after = np.where(inside, at + n, end)
        after[:-1] = np.where(inside[1:], after[:-1], end)
        before = at - n
        before[0] = end
        symbols, after, before, flat = symbols.ravel(), after.ravel(), before.ravel(), keys.ravel()
        while True:
            least = keys.min(axis=0)
            rows = np.flatnonzero(least < NONE)
            if not len(rows):
                break
            least = least[rows]
            place, merged = least & ((1 << PLACE_BITS) - 1), self.result[least >> PLACE_BITS]
            first = place * n + rows
            second, previous = after[first], before[first]
            behind = after[second]
            symbols[first], symbols[second], flat[second] = merged, -1, NONE
            after[first], before[behind] = behind, first
            new = self.keys_of(np.concatenate([merged, symbols[previous]]), np.concatenate([symbols[behind], merged]),
                               np.concatenate([place, previous // n]))
            flat[first], flat[previous] = new[:len(rows)], new[len(rows):]
        done = symbols.reshape(width + 1, n).T
        left = done >= 0
        ends = np.cumsum(left.sum(axis=1)).tolist()
        ids = done[left].tolist()
        return [ids[start:stop] for start, stop in zip([0, *ends], ends, strict=False)]


class Vocabulary:
    """Pairs to merge with rank and result, the id of each byte, the bytes of each id."""

    def __init__(self, described: str):
        model = json.loads(described)
        ids = model["model"]["vocab"]
        letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.byte_ids = [ids[letter] for letter in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        self.added = {token["content"]: token["id"] for token in model.get("added_tokens", [])}
        size = max([*ids.values(), *self.added.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for text, number in ids.items():
            self.pieces[number] = bytes(byte_of[c] for c in text)
        for text, number in self.added.items():
            self.pieces[number] = text.encode()
        self.words = regex.compile(WORDS)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.decimals = [str(i) for i in range(size)]
        self.of_word = Segments(lambda word: self.merge(word.encode()), CACHE_WORDS)
        self.segments = Segments(self.encode_segment, CACHE_SEGMENTS)
        self.table = PairTable(self.merges, self.byte_ids)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one word."""
        symbols = [self.byte_ids[b] for b in data]
        n = len(symbols)
        if n < 2:
            return symbols
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = []
        for i in range(n - 1):
            if found := self.merges.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = merged, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := self.merges.get((symbols[a], symbols[b]))):
                    heapq.heappush(queue, (found[0], a, symbols[a], symbols[b], found[1]))
        return [s for s in symbols if s >= 0]

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """Ids of each of many words."""
        encoded = [word.encode() for word in words]
        out: list[list[int]] = [[]] * len(words)
        by_width: dict[int, list[int]] = {width: [] for width in WIDTHS}
        for i, data in enumerate(encoded):
            if 0 < len(data) <= WIDTHS[-1]:
                by_width[WIDTH_OF[len(data)]].append(i)
            else:
                out[i] = self.merge(data)
        for width, places in by_width.items():
            for start in range(0, len(places), ROWS):
                own = places[start:start + ROWS]
                for i, ids in zip(own, self.table.merge([encoded[i] for i in own], width), strict=True):
                    out[i] = ids
        return out

    def split(self, segment: str) -> list[str]:
        """Words of a segment. One of Latin letters alone is a word, which is seen without the pattern."""
        return [segment] if LATIN_WORD.fullmatch(segment) else self.words.findall(segment)

    def learn(self, cut: list[list[str]]) -> None:
        """Puts the short segments of the texts cut into segments, and their words, into the caches."""
        new = [s for s in set().union(*cut) if s not in self.segments and len(s) <= CACHED_LENGTH]
        split = list(map(self.split, new))
        words = list(set(chain.from_iterable(split)).difference(self.of_word))
        self.of_word.keep(dict(zip(words, self.merge_many(words), strict=True)))
        of_word = self.of_word.__getitem__
        self.segments.keep({segment: of_word(parts[0]) if len(parts) == 1 else list(chain.from_iterable(map(of_word, parts)))
                            for segment, parts in zip(new, split, strict=True)})

    def encode_many(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text, in their order."""
        group: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            group.append(text or "")
            size += len(group[-1])
            if size >= AT_ONCE or i + 1 == len(texts):
                cut = list(map(segments_of, group))
                self.learn(cut)
                for whole, segments in zip(group, cut, strict=True):
                    yield self.encode(whole) if self.has_added(whole) else list(chain.from_iterable(map(self.segments.__getitem__, segments)))
                group, size = [], 0

    def encode_segment(self, segment: str) -> list[int]:
        words = self.words.findall(segment)
        if len(words) == 1:
            return self.of_word[segment]  # both caches hold the same key and list
        return list(chain.from_iterable(map(self.of_word.__getitem__, words)))

    def has_added(self, text: str) -> bool:
        return any(token in text for token in self.added)

    def encode_plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.segments.__getitem__, segments_of(text))))

    def encode(self, text: str) -> list[int]:
        if not self.has_added(text):
            return self.encode_plain(text)
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(self.added[part])
            else:
                out += self.encode_plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")

    def listed(self, ids: list[int]) -> str:
        """The ids as decimal numbers joined by commas."""
        return ",".join(map(self.decimals.__getitem__, ids))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_loaded: dict[str, Vocabulary] = {}


def on_worker(described) -> Vocabulary:
    """The vocabulary of a broadcast description, built once per worker."""
    text = described.value
    if text not in _loaded:
        _loaded.clear()
        _loaded[text] = Vocabulary(text)
    return _loaded[text]


def read_vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read where the driver runs and broadcast as text: its size is
    that of the vocabulary, whatever the documents are."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def id_lists(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode(df: DataFrame, vocabulary_path: str, text: str = "text", ids: str | None = "ids", decoded: str | None = None,
           keep_text: bool = True, n_ids: str | None = None, ids_sha256: str | None = None, decoded_sha256: str | None = None) -> DataFrame:
    """df with the ids of its texts and, in columns that the caller names, the text that those ids
    decode to, their number, and the digests of the ids and of that text. Digests are taken where the
    ids are, so that a column that isn't asked for is never sent."""
    described = read_vocabulary(df, vocabulary_path)
    kinds = {ids: T.ArrayType(T.IntegerType(), False), decoded: T.StringType(), n_ids: T.LongType(), ids_sha256: T.StringType(),
             decoded_sha256: T.StringType()}
    added = [T.StructField(name, kind) for name, kind in kinds.items() if name]

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        vocabulary = on_worker(described)
        found: dict[str | None, list] = {name: [] for name in kinds}
        for own in vocabulary.encode_many(batch.column(text).to_pylist()):
            back = vocabulary.decode(own) if decoded or decoded_sha256 else ""
            for name, value in ((ids, own), (decoded, back), (n_ids, len(own))):
                if name:
                    found[name].append(value)
            if ids_sha256:
                found[ids_sha256].append(digest(vocabulary.listed(own)))
            if decoded_sha256:
                found[decoded_sha256].append(digest(back))
        return {f.name: id_lists(found[f.name]) if f.name == ids else pa.array(found[f.name], pa.int64() if f.name == n_ids else pa.string())
                for f in added}

    names = {f.name for f in added}
    plain = df.drop(*names - {text})
    return with_batches(plain, run, added, drop=() if keep_text else (text,))


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text of its ids; null ids give the empty text."""
    described = read_vocabulary(df, vocabulary_path)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        vocabulary = on_worker(described)
        return {decoded: pa.array([vocabulary.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())}

    return with_batches(df.drop(decoded), run, [T.StructField(decoded, T.StringType())])


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Per document the number of tokens and the digests of its ids and of its decoded text."""
    return encode(docs.select("doc_id", "text"), vocabulary_path, ids=None, keep_text=False, n_ids="n_tokens", ids_sha256="ids_sha256",
                  decoded_sha256="decoded_sha256")
