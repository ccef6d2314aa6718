"""Benchmark decontamination with a generalised suffix automaton over the words of the items.

Method: the words of all test items are inserted into one automaton (A-Z lower-cased). The
words of a document stream through it; after each word the automaton knows the longest
sequence ending there that occurs in an item. A match of at least `window` words, or of a
whole item that has fewer, marks its words as hit.

Before that, numpy drops what cannot match: a hit lies in a run of item words whose
neighbouring pairs all occur in items, as long as the shortest window. Only such runs, whose
words are compared byte by byte, walk through the automaton.

The automaton is held by every task, so its items must be few: beyond `block_words` words they
are dealt by hash into blocks, each of which passes over the documents in turn with an
automaton of its own. The driver reads one block at a time to broadcast it.

Cases: a null or empty text has no words and is never contaminated; an item without words
never occurs; equal items under several ids all count, a repeated id counts once, and items
without an id mark words but are not counted. Rows are judged one by one, so repeated rows
get equal results; other columns of the documents are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark.llm.frames import with_batches
from spendspark.llm.words import LOWER, batch_words, byte_table, find_words, text_buffers

WINDOW = 13  # words
COVERAGE = 20  # a document is contaminated if hit words * COVERAGE >= its words
BLOCK_WORDS = 2_000_000  # of one automaton, about 1 GB

INSIDE = byte_table("letters_digits")


class Automaton:
    """Suffix automaton of several sequences of word numbers."""

    def __init__(self) -> None:
        self.following: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.longest = [0]

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def _extend(self, last: int, symbol: int) -> int:
        following, link, longest = self.following, self.link, self.longest
        known = following[last].get(symbol)
        if known is not None:
            return known if longest[known] == longest[last] + 1 else self._split(last, known, symbol)
        state = len(following)
        following.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and symbol not in following[p]:
            following[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = following[p][symbol]
            link[state] = q if longest[q] == longest[p] + 1 else self._split(p, q, symbol)
        return state

    def _split(self, p: int, q: int, symbol: int) -> int:
        """A state for the sequences of q that are reached through p."""
        following, link, longest = self.following, self.link, self.longest
        copy = len(following)
        following.append(dict(following[q]))
        link.append(link[q])
        longest.append(longest[p] + 1)
        link[q] = copy
        while p >= 0 and following[p].get(symbol) == q:
            following[p][symbol] = copy
            p = link[p]
        return copy

    def match_lengths(self, sequence: list[int]) -> Iterator[int]:
        """Length of the longest match that ends at each word."""
        following, link, longest = self.following, self.link, self.longest
        state = length = 0
        for symbol in sequence:
            while state and symbol not in following[state]:
                state = link[state]
                length = longest[state]
            if symbol in following[state]:
                state = following[state][symbol]
                length += 1
            yield length


class Items:
    """The items of one block, ready to be matched."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        texts = pa.array([text for _, text in items], pa.string())
        hashes, starts, ends, edges, data = batch_words(texts, INSIDE)
        self.vocabulary, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
        lowered = LOWER[data]
        self.spelling = [lowered[starts[k]:ends[k]].tobytes() for k in first]
        self.automaton = Automaton()
        self.windows: dict[tuple[int, ...], set[str]] = {}
        pairs = []
        for (item, _), begin, end in zip(items, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            sequence = numbers[begin:end].tolist()
            if not sequence:
                continue
            self.automaton.add(sequence)
            pairs.append(numbers[begin:end - 1].astype(np.int64) << 32 | numbers[begin + 1:end])
            for i in range(max(1, len(sequence) - window + 1)):
                ids = self.windows.setdefault(tuple(sequence[i:i + window]), set())
                if item is not None:
                    ids.add(item)
        self.short_lengths = sorted({len(w) for w in self.windows if len(w) < window})
        self.least = min([*self.short_lengths, window])
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def numbers_of(self, hashes: np.ndarray) -> np.ndarray:
        return look_up(self.vocabulary, hashes)

    def hits(self, numbers: np.ndarray, spelled) -> tuple[np.ndarray, set[str]]:
        """Hit words of a run, and the items with an occurring window. spelled(k) is the
        bytes of word k."""
        sequence = [n if self.spelling[n] == spelled(k) else -1 for k, n in enumerate(numbers.tolist())]
        hit, found = np.zeros(len(sequence), bool), set()
        for k, length in enumerate(self.automaton.match_lengths(sequence)):
            lengths = [n for n in self.short_lengths if n <= length]
            for n in lengths + [self.window] * (length >= self.window):
                items = self.windows.get(tuple(sequence[k - n + 1:k + 1]))
                if items is not None:
                    hit[k - n + 1:k + 1] = True
                    found |= items
        return hit, found


def look_up(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value among the sorted values, -1 where it is missing."""
    if not len(values):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[at] == wanted, at, -1)


def match(items: Items, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """Per text: number of words, hit flags of its words, ids of the items found."""
    hashes, starts, ends, edges, data = batch_words(texts, INSIDE)
    numbers = items.numbers_of(hashes)
    hit = np.zeros(len(hashes), bool)
    found: list[set[str]] = [set() for _ in range(len(texts))]
    known = numbers >= 0
    # a run goes on while both words are known, their pair occurs in an item and no text ends
    joined = np.zeros(len(hashes), bool)
    both = np.flatnonzero(known[1:] & known[:-1]) + 1
    joined[both] = look_up(items.pairs, numbers[both - 1] << 32 | numbers[both]) >= 0
    inner = edges[:-1]
    joined[inner[inner < len(joined)]] = False
    firsts = np.flatnonzero(known & ~joined)
    carried_on = np.append(joined[1:], False)
    lasts = np.flatnonzero(known & ~carried_on) + 1
    long = lasts - firsts >= items.least
    for begin, end in zip(firsts[long].tolist(), lasts[long].tolist(), strict=True):
        flags, ids = items.hits(numbers[begin:end], lambda k, b=begin: LOWER[data[starts[b + k]:ends[b + k]]].tobytes())
        if flags.any():
            hit[begin:end] |= flags
            found[int(np.searchsorted(edges, begin, "right")) - 1] |= ids
    return np.diff(edges), [hit[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], found


def in_blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> tuple[DataFrame, int]:
    """Distinct items with the number of their block, dealt by hash, and how many blocks there are. A text of
    b bytes has (b + 1) / 2 words at most, whatever parts them."""
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL").distinct()
    words = rows.agg(F.sum(F.ceil((F.octet_length("text") + 1) / 2))).first()[0] or 0
    n_blocks = max(1, -(-int(words) // block_words))
    return rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))), n_blocks


_loaded: dict[str, Items] = {}


def spans_of(hit: np.ndarray) -> list[int]:
    """First word and end of every run of hit words, one after the other."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edges.tolist()


def without(data: np.ndarray, begin: int, end: int, starts: np.ndarray, ends: np.ndarray, spans: list[int],
            least: int) -> str:
    """The text data[begin:end] without its spans of at least `least` words, each cut from its
    first word to the next word that stays."""
    kept, at = [], begin
    for first, last in zip(spans[::2], spans[1::2], strict=True):
        if last - first >= least:
            kept.append(data[at:starts[first]].tobytes())
            at = int(starts[last]) if last < len(starts) else int(ends[last - 1])
    return (b"".join(kept) + data[at:end].tobytes()).decode("utf-8", "replace")


# the columns that mark adds, and the names that they have where the caller doesn't see them
MARKS = ("n_words", "n_hit", "hit_spans", "hit_items")
HIDDEN = tuple(f"{name} of the decontamination" for name in MARKS)


def mark(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = True, names: tuple[str, ...] = MARKS) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (first word and end of each run of hit words, one
    after the other) and hit_items (ids, sorted), in columns of these names or of those given;
    columns that docs has under them are replaced."""
    n_words, n_hit, hit_spans, hit_items = names
    added = [T.StructField(n_words, T.LongType()), T.StructField(n_hit, T.LongType()),
             T.StructField(hit_spans, T.ArrayType(T.IntegerType())), T.StructField(hit_items, T.ArrayType(T.StringType()))]
    marked = docs.drop(*names)
    numbered, n_blocks = in_blocks(items, item_id, item_text, block_words)
    for number in range(n_blocks):
        # the driver holds the items of one block at a time
        sent = docs.sparkSession.sparkContext.broadcast(
            [(r["item"], r["text"]) for r in numbered.filter(F.col("block") == number).select("item", "text").collect()])

        def run(batch: pa.RecordBatch, sent=sent, key=uuid.uuid4().hex, first=number == 0) -> dict[str, pa.Array]:
            if key not in _loaded:
                _loaded.clear()
                _loaded[key] = Items(sent.value, window)
            words, hits, found = match(_loaded[key], batch.column(text))
            if not first:
                for hit, spans in zip(hits, batch.column(hit_spans).to_pylist(), strict=True):
                    for begin, end in zip(spans[::2], spans[1::2], strict=True):
                        hit[begin:end] = True
                found = [a.union(b) for a, b in zip(found, batch.column(hit_items).to_pylist(), strict=True)]
            return {n_words: pa.array(words, pa.int64()), n_hit: pa.array([int(h.sum()) for h in hits], pa.int64()),
                    hit_spans: pa.array([spans_of(h) for h in hits], pa.list_(pa.int32())),
                    hit_items: pa.array([sorted(f) for f in found], pa.list_(pa.string()))}

        drop = () if keep_text or number + 1 < n_blocks else (text,)
        marked = with_batches(marked, run, added if number == 0 else [], drop=drop)
    return marked


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", least: int = WINDOW, **options) -> DataFrame:
    """docs whose texts have lost every run of at least `least` hit words; all else stays as it is."""
    marked = mark(docs, items, text=text, names=HIDDEN, **options)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column(text)
        data, offsets = text_buffers(texts)
        starts, ends = find_words(data, offsets, INSIDE)
        edges = np.searchsorted(starts, offsets)
        out = []
        for k, (whole, spans) in enumerate(zip(texts, batch.column(HIDDEN[2]).to_pylist(), strict=True)):
            a, b = edges[k], edges[k + 1]
            out.append(without(data, int(offsets[k]), int(offsets[k + 1]), starts[a:b], ends[a:b], spans, least)
                       if spans else whole.as_py())
        return {text: pa.array(out, pa.string())}

    return with_batches(marked, run, [], drop=HIDDEN)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * COVERAGE >= n_words)


def reject(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones; the others stay as they are."""
    marked = mark(docs, items, names=HIDDEN, **options)
    return marked.filter(~contaminated(F.col(f"`{HIDDEN[1]}`"), F.col(f"`{HIDDEN[0]}`"))).drop(*HIDDEN)


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, contaminated."""
    marked = mark(docs.select("doc_id", "text"), items, keep_text=False, **options)
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


# The query in DuckDB's SQL: every window of every item against all of the same length.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
k AS (SELECT item, ws, least(13, len(ws)) AS k FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g FROM k),
pos AS (SELECT doc_id, s.k, unnest(range(1, len(ws) - s.k + 2)) AS i, ws FROM d JOIN (SELECT DISTINCT k FROM k) s ON len(ws) >= s.k),
hit AS (SELECT pos.doc_id, pos.i, pos.k, win.item FROM pos JOIN win ON win.k = pos.k AND win.g = array_to_string(pos.ws[pos.i:pos.i + pos.k - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) x GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
