"""Language of texts and of the spans of a text, word by word.

Method: a word's script, by ranges of code points, narrows the languages that it may belong
to: those of whose learned words at least SHARE are written in it. Among these a word scores by
its byte n-grams, with word ends marked, and by itself: logarithms of how often each
language has them against the mean of all languages. Viterbi finds the labels of a text's words that
score highest in sum when every change of language costs SWITCH; neighbouring words of one label are a
span. The language of a text is the one whose words hold the most bytes.

The counts are gathered in Spark from a sample of about ROWS texts of each language, of at most
MAX_CHARS code points, chosen by a hash of doc_id: BUCKETS counts for each language is all
that reaches the driver and goes back to the tasks. Every text is labelled whole. Viterbi runs
on all pieces of PIECE words of a group of texts at once: first the best score through a piece
from each language to each, then the scores at its beginning, then the path back. A task
works off texts in groups of about CELLS words times languages, or one text.

Cases: null texts, texts without a letter and all texts where no language is learned are `und`,
score 0. A script that no language has narrows nothing. Of languages with equally many bytes the
first by name wins. Rows are labelled one by one, so repeated rows and ids need no rule; rows with a null id or a null
language are not learned from. Added columns replace columns of the same names; others pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark.llm.frames import with_batches
from spendspark.llm.words import byte_table, mix, spelled_words, text_buffers, word_hashes

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
ROWS = 2000  # of each language
MAX_CHARS = 20_000
SMOOTHING = 0.5
SHARE = 0.001
SWITCH = 8.0
EXCLUDED = -1000.0  # score of a language that a word's script rules out
PIECE = 128  # words
CELLS = 1 << 22
UNKNOWN = "und"

INSIDE = byte_table("letters_digits").copy()
INSIDE[48:58] = False

# Ranges of code points of the scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "ethiopic": [(0x1200, 0x137F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
    "kana": [(0x3040, 0x30FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
}
_RANGES = sorted((first, last, number) for number, name in enumerate(SCRIPTS, 1) for first, last in SCRIPTS[name])
_FIRST, _LAST, _NUMBER = (np.array(x) for x in zip(*_RANGES, strict=True))

SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("lang", T.StringType())]))


def scripts_of(words: pa.Array) -> np.ndarray:
    """Number of each word's script, 0 without one: the last by number of those its letters have, so
    that a word with a letter outside Latin is not Latin. No word is empty."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    data, _ = text_buffers(words)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.searchsorted(_FIRST, points, "right") - 1
    script = np.where((at >= 0) & (points <= _LAST[at]), _NUMBER[at], 0)
    return np.maximum.reduceat(script, np.cumsum(sizes) - sizes) if len(words) else np.zeros(0, np.int64)


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word and of the word itself, and the word each belongs to."""
    data, offsets = text_buffers(words)
    edges = offsets + 2 * np.arange(len(offsets))
    marked = np.zeros(int(edges[-1]), np.uint64)
    inner = np.ones(len(marked), bool)
    inner[edges[:-1]] = inner[edges[1:] - 1] = False
    marked[inner] = data.astype(np.uint64) + np.uint64(3)
    marked[edges[:-1]], marked[edges[1:] - 1] = 1, 2
    owner = np.repeat(np.arange(len(words)), np.diff(edges))
    room = edges[1:][owner] - np.arange(len(marked))
    buckets, owners = [mix(word_hashes(data, offsets[:-1], offsets[1:]) ^ np.uint64(0x1D))], [np.arange(len(words))]
    value = np.zeros(len(marked), np.uint64)
    for n in GRAMS:
        # the value of n letters from each place on, from that of n - 1 of them
        value = value * np.uint64(0x100000001B3)
        value[:len(value) - n + 1] += marked[n - 1:]
        at = np.flatnonzero(room >= n)
        buckets.append(mix(value[at] + np.uint64(n)))
        owners.append(owner[at])
    return (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """langs in ascending order; weights: bucket x language; allowed: script x language."""

    langs: list[str]
    weights: np.ndarray
    allowed: np.ndarray
    key: str = ""

    def word_scores(self, words: pa.Array) -> np.ndarray:
        buckets, owners = subwords(words)
        found = np.empty((len(words), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            # the n-gram sizes and the word itself each tell of all letters once
            found[:, k] = np.bincount(owners, self.weights[buckets, k], len(words)) / (len(GRAMS) + 1)
        found[~self.allowed[scripts_of(words)]] = EXCLUDED
        return found


def best_path(scores: np.ndarray, edges: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of each word: words edges[k]:edges[k + 1] of text k get the labels with the highest sum of
    scores, each change of label costing switch. On a tie the label before stays, else the lowest wins."""
    n_labels = scores.shape[1]
    labels = np.zeros(len(scores), np.int64)
    per_text = -(-np.diff(edges) // PIECE)
    n_pieces = int(per_text.sum())
    if not n_pieces:
        return labels
    text = np.repeat(np.arange(len(per_text)), per_text)
    nth = np.arange(n_pieces) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begins = edges[text] + PIECE * nth
    sizes = np.minimum(PIECE, edges[text + 1] - begins)
    by_size = np.argsort(-sizes, kind="stable")  # at step t the pieces longer than t come first
    first = begins[by_size]
    longer = np.searchsorted(-sizes[by_size], -np.arange(PIECE), "left")

    def forward(state: np.ndarray, came: np.ndarray | None = None) -> np.ndarray:
        """Best scores through each piece; state: (piece, ..., label)."""
        for t in range(PIECE):
            n = longer[t]
            if not n:
                break
            now = state[:n]
            top = now.max(-1, keepdims=True) - np.float32(switch)
            if came is not None:
                came[first[:n] + t] = np.where(now >= top, np.arange(n_labels), now.argmax(-1)[:, None])
            own = scores[first[:n] + t].reshape(n, *[1] * (state.ndim - 2), n_labels)
            state[:n] = np.maximum(now, top) + own
        return state

    place = np.empty(n_pieces, np.int64)
    place[by_size] = np.arange(n_pieces)
    last_of = np.append(np.flatnonzero(nth == 0)[1:] - 1, n_pieces - 1)
    most = int(nth.max())
    entering = np.zeros((n_pieces, n_labels), np.float32)
    if most:
        through = np.full((n_pieces, n_labels, n_labels), -np.inf, np.float32)
        through[:, np.arange(n_labels), np.arange(n_labels)] = 0
        through = forward(through)
        for k in range(1, most + 1):
            at = np.flatnonzero(nth == k)
            before = entering[at - 1][:, :, None] + through[place[at - 1]]
            entering[at] = before.max(1)
            entering[at] -= entering[at].max(1, keepdims=True)
    came = np.zeros((len(scores), n_labels), np.uint8 if n_labels < 256 else np.int32)
    at_end = forward(entering[by_size].copy(), came)
    # what label the word before a piece has, for each label of the piece's last word
    back = np.tile(np.arange(n_labels), (n_pieces, 1))
    for t in range(PIECE - 1, -1, -1):
        n = longer[t]
        if n:
            back[:n] = np.take_along_axis(came[first[:n] + t].astype(np.int64), back[:n], 1)
    label = np.zeros(n_pieces, np.int64)
    label[last_of] = at_end[place[last_of]].argmax(1)
    for k in range(most, 0, -1):
        at = np.flatnonzero(nth == k)
        label[at - 1] = back[place[at], label[at]]
    now = label[by_size]
    for t in range(PIECE - 1, -1, -1):
        n = longer[t]
        if n:
            labels[first[:n] + t] = now[:n]
            now[:n] = came[first[:n] + t, now[:n]]
    return labels


def label(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language (place in model.langs, -1 without words) and its share of the bytes of each text; labels
    of all words, and edges: words edges[k]:edges[k + 1] are those of text k."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    words, edges = spelled_words(texts, INSIDE)
    coded = words.dictionary_encode()
    of_word = model.word_scores(coded.dictionary)
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    n_langs, n = len(model.langs), len(texts)
    labels = np.zeros(len(numbers), np.int64)
    at, limit = 0, max(1, CELLS // n_langs)
    while at < n:
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + limit, "right")) - 1)
        a, b = edges[at], edges[end]
        labels[a:b] = best_path(of_word[numbers[a:b]], edges[at:end + 1] - a)
        at = end
    text = np.repeat(np.arange(n), np.diff(edges))
    held = np.bincount(text * n_langs + labels, sizes, n * n_langs).reshape(n, n_langs)
    total = held.sum(1)
    top = np.where(total > 0, held.argmax(1), -1)
    share = np.divide(held.max(1), total, out=np.zeros(n), where=total > 0)
    return top, share, labels, edges


def spans_of(labels: np.ndarray, edges: np.ndarray, langs: list[str]) -> list[list[dict]]:
    """Runs of words of one label in each text."""
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    opens = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    spans: list[list[dict]] = [[] for _ in range(len(edges) - 1)]
    for i, j in zip(opens.tolist(), np.append(opens, len(labels))[1:].tolist(), strict=True):
        first = int(edges[text[i]])
        spans[text[i]].append({"first": i - first, "end": j - first, "lang": langs[labels[i]]})
    return spans


def train(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS,
          max_chars: int = MAX_CHARS) -> Model:
    """A model of the rows for which learn holds."""
    known = docs.filter(learn).select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast(
        "string").alias("lang")).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.length("text").between(1, max_chars))
    # one row per language, as in the model
    sizes = {row["lang"]: row["size"] for row in known.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).collect()}
    if not sizes:
        return fitted([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    limits = F.create_map(*[F.lit(x) for name, size in sizes.items() for x in (name, float(rows << 30) / size)])
    sample = known.filter(draw < limits[F.col("lang")]).select("lang", "text")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, edges = spelled_words(pc.utf8_lower(batch.column("text").cast(pa.large_string())), INSIDE)
            if not len(words):
                continue
            names = batch.column("lang").dictionary_encode()
            of_text = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            coded = words.dictionary_encode()
            buckets, owners = subwords(coded.dictionary)
            scripts = scripts_of(coded.dictionary)
            numbers = coded.indices.to_numpy(zero_copy_only=False)
            of_word = np.repeat(of_text, np.diff(edges))
            for k, name in enumerate(names.dictionary.to_pylist()):
                times = np.bincount(numbers[of_word == k], minlength=len(coded.dictionary))
                # the scripts follow behind the buckets
                n = np.concatenate([np.bincount(buckets, times[owners], BUCKETS), np.bincount(scripts, times, len(SCRIPTS) + 1)])
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()),
                                                  pa.array(n[used].astype(np.int64))], schema=pa.schema(
                    [("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())]))

    counts = sample.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    return fitted(counts["lang"].to_pylist(), counts["bucket"].to_numpy(), counts["n"].to_numpy())


def fitted(names: list[str], buckets: np.ndarray, counts: np.ndarray) -> Model:
    langs = sorted(set(names))
    place = {name: k for k, name in enumerate(langs)}
    table = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(langs)))
    np.add.at(table, (buckets, np.array([place[name] for name in names], np.int64)), counts)
    grams, scripts = table[:BUCKETS] + SMOOTHING, table[BUCKETS:]
    weights = np.log(grams / grams.sum(0)) if langs else grams
    allowed = scripts >= SHARE * np.maximum(scripts.sum(0), 1)
    allowed |= ~allowed.any(1, keepdims=True)
    allowed[0] = True
    return Model(langs, (weights - weights.mean(1, keepdims=True)).astype(np.float32) if langs else weights, allowed, uuid.uuid4().hex)


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", spans: str | None = "spans",
             keep_text: bool = True) -> DataFrame:
    """docs with the language of each text, the share of its bytes of words that are labelled so, and
    the spans: first word and end (from 0, words as runs of letters) and language."""
    added = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())] + ([T.StructField(spans, SPANS)] if spans else [])
    letter = "text has a letter"
    plain = docs.drop(*{f.name for f in added} - {text}).withColumn(letter, F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))
    if not model.langs:
        found = plain.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0)} | ({spans: F.array().cast(SPANS)} if spans else {}))
        return found.drop(letter) if keep_text else found.drop(letter, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        own = sent.value
        top, share, labels, edges = label(own, batch.column(text))
        known = batch.column(letter).to_numpy(zero_copy_only=False) & (top >= 0)
        found = {lang: pa.array([own.langs[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), known.tolist(), strict=True)], pa.string()),
                 score: pa.array(np.where(known, share, 0.0))}
        if spans:
            parts = spans_of(labels, edges, own.langs)
            found[spans] = pa.array([p if ok else [] for p, ok in zip(parts, known.tolist(), strict=True)],
                                    pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
        return found

    return with_batches(plain, run, added, drop=(letter,) if keep_text else (letter, text))


def held_out(doc_id: str = "doc_id") -> Column:
    """One document in four, by the checksum of its id, is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """Per document its language, the share of the text in it, and whether its label was held out."""
    model = train(docs, ~held_out())
    found = identify(docs.select("doc_id", "text"), model, spans=None, keep_text=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
