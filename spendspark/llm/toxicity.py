"""Toxicity scores from subword-bag embeddings and a linear softmax.

Method: a word is the bag of its byte n-grams (with word ends marked) and of itself, each
hashed to a bucket with an embedding. The embeddings of a window of words are averaged and go
into a linear softmax; both are trained together in numpy. A misspelling that was never seen
shares most n-grams with the word it comes from. The n-grams are of UTF-8 bytes, so a
non-ASCII letter counts as two or more.

A few words make a long document toxic and would drown in an average over all of it, so a
document is judged by its most toxic window. Labels are per document: training starts on
averages over whole documents and goes on with the windows that the model finds most toxic,
both in toxic documents and, as hard negatives, in clean ones.

Bound of the training sample: ROWS documents of each class, first in hash order of doc_id,
texts of at most MAX_CHARS code points. Everything else, scoring above all, sees whole texts
of all documents. After training the score of a window needs one number per bucket, so the
model that goes to the tasks has BUCKETS floats.

Cases: null and empty texts and texts without a letter or digit score 0. Labels that are null
are not used; several labels of one document count as toxic if any is; of several texts
under one doc_id the smallest is learned from. Without labels of both classes every other text
scores the share of toxic labels (0 if there are none). Rows are scored one by one, so
repeated rows get equal scores; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark.llm.frames import with_batches
from spendspark.llm.words import LOWER, batch_words, byte_table, mix

BUCKETS = 1 << 17
DIMENSIONS = 16
GRAMS = (3, 4, 5)
WINDOW = 3  # words; windows start at every word
ROWS = 3000  # of each class
MAX_CHARS = 20_000
WHOLE_EPOCHS, WINDOW_EPOCHS = 1, 10
MODELS = 3
DRAWN = 4  # clean windows drawn for each document
CALIBRATE = 6
BATCH = 256
RATE = 0.6

INSIDE = byte_table("letters_digits")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each length, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of each word, and the word each belongs to."""
    lengths = ends - starts
    edges = np.concatenate([[0], np.cumsum(lengths + 2)])
    marked = np.empty(int(edges[-1]), np.uint8)
    inner = np.ones(len(marked), bool)
    inner[edges[:-1]] = inner[edges[1:] - 1] = False
    marked[edges[:-1]], marked[edges[1:] - 1] = ord("<"), ord(">")
    marked[inner] = LOWER[data[ranges(starts, lengths)]]
    owner = np.repeat(np.arange(len(starts), dtype=np.int32), lengths + 2)
    room = (np.repeat(edges[1:], lengths + 2) - np.arange(len(marked))).astype(np.int32)
    del inner
    place = lambda value: (mix(value) & np.uint64(BUCKETS - 1)).astype(np.int32)
    buckets, owners = [place(hashes ^ np.uint64(0x5BD1E995))], [np.arange(len(starts), dtype=np.int32)]
    for n in GRAMS:
        at = np.flatnonzero(room >= n).astype(np.int32)
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value *= np.uint64(0x100000001B3)
            value += marked[at + k] + np.uint64(1)
        buckets.append(place(value))
        owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners)


class Words:
    """The words of some texts, each distinct one with its subwords."""

    def __init__(self, texts: pa.Array):
        hashes, starts, ends, self.edges, data = batch_words(texts, INSIDE)
        distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.number = number.astype(np.int32)
        starts, ends = starts[first], ends[first]
        del hashes, first, number
        buckets, owners = subwords(data, starts, ends, distinct)
        order = np.argsort(owners, kind="stable")
        self.buckets = buckets[order]
        self.sizes = np.bincount(owners, minlength=len(distinct))
        self.first = np.cumsum(self.sizes) - self.sizes

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, end and text of every window; together they cover all words."""
        counts = np.diff(self.edges)
        per_text = np.where(counts > 0, np.maximum(counts - WINDOW, 0) + 1, 0)
        owner = np.repeat(np.arange(len(counts)), per_text)
        starts = ranges(self.edges[:-1], per_text)
        return starts, np.minimum(starts + WINDOW, self.edges[owner + 1]), owner

    def logits(self, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean weight of the subwords of each window."""
        if not len(starts):
            return np.zeros(0)
        of_word = np.add.reduceat(weights[self.buckets].astype(np.float64), self.first)
        sums = np.concatenate([[0.0], np.cumsum(of_word[self.number])])
        sizes = np.concatenate([[0], np.cumsum(self.sizes[self.number])])
        return (sums[ends] - sums[starts]) / (sizes[ends] - sizes[starts])


def highest(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest value of each owner (minus infinity without one) and where it stands."""
    top, at = np.full(n, -np.inf), np.full(n, -1)
    order = np.lexsort((-values, owner))
    owners, place = np.unique(owner[order], return_index=True)
    top[owners], at[owners] = values[order[place]], order[place]
    return top, at


class Model:
    """Weights of the buckets and a bias; all of the softmax that scoring needs."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts)
        starts, ends, owner = words.windows()
        found = np.zeros(len(texts))
        if len(owner):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            top = np.maximum.reduceat(words.logits(self.weights, starts, ends), first) + self.bias
            found[owner[first]] = 1 / (1 + np.exp(-np.clip(top, -700, 700)))
        return found


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Mean of MODELS models that set other documents aside: past the average, all that a model
    does is linear, so the mean of their weights is the mean of their logits."""
    return fit_words(Words(pa.array(texts, pa.string())), np.array(toxic, np.int64))


def fit_words(words: Words, labels: np.ndarray) -> Model:
    share = labels.mean() if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), 700.0 if share else -700.0)
    models = [fit_one(words, labels, part) for part in range(MODELS)]
    return Model(np.mean([m.weights for m in models], axis=0), float(np.mean([m.bias for m in models])))


def fit_one(words: Words, labels: np.ndarray, part: int) -> Model:
    share = labels.mean()
    starts, ends, owner = words.windows()
    random = np.random.default_rng(part)
    embeddings = random.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    softmax = random.normal(0, 0.3, (DIMENSIONS, 2))
    bias = np.zeros(2)
    squares = [np.full_like(x, 1e-8) for x in (embeddings, softmax, bias)]
    weight_of = np.array([0.5 / (1 - share), 0.5 / share])

    def step(first: np.ndarray, end: np.ndarray, label: np.ndarray) -> None:
        lengths = end - first
        number = words.number[ranges(first, lengths)]
        of = np.repeat(np.arange(len(first)), lengths)
        used, local = np.unique(number, return_inverse=True)
        buckets = words.buckets[ranges(words.first[used], words.sizes[used])]
        word = np.repeat(np.arange(len(used)), words.sizes[used])
        vectors = np.stack([np.bincount(word, embeddings[buckets, k], len(used)) for k in range(DIMENSIONS)], 1)
        sizes = np.bincount(of, words.sizes[number], len(first))[:, None]
        averages = np.stack([np.bincount(of, vectors[local, k], len(first)) for k in range(DIMENSIONS)], 1) / sizes
        logits = averages @ softmax + bias
        shares = np.exp(logits - logits.max(1, keepdims=True))
        shares /= shares.sum(1, keepdims=True)
        error = (shares - np.eye(2)[label]) * (weight_of[label] / len(first))[:, None]
        to_average = error @ softmax.T / sizes
        to_word = np.stack([np.bincount(local, to_average[of, k], len(used)) for k in range(DIMENSIONS)], 1)
        touched, place = np.unique(buckets, return_inverse=True)
        to_bucket = np.stack([np.bincount(place, to_word[word, k], len(touched)) for k in range(DIMENSIONS)], 1)
        squares[0][touched] += to_bucket ** 2
        embeddings[touched] -= RATE * to_bucket / np.sqrt(squares[0][touched])
        for values, square, slope in ((softmax, squares[1], averages.T @ error), (bias, squares[2], error.sum(0))):
            square += slope ** 2
            values -= RATE * slope / np.sqrt(square)

    def epoch(first: np.ndarray, end: np.ndarray, label: np.ndarray) -> None:
        order = random.permutation(len(first))
        for i in range(0, len(order), BATCH):
            chosen = order[i:i + BATCH]
            step(first[chosen], end[chosen], label[chosen])

    def flat() -> Model:
        return Model(embeddings @ (softmax[:, 1] - softmax[:, 0]), bias[1] - bias[0])

    # one document in CALIBRATE sets the cut between the classes and is not trained on: on
    # documents that the model has learned by heart, any cut looks good
    aside = np.zeros(len(labels), bool)
    for kind in (0, 1):
        own = np.flatnonzero(labels == kind)
        aside[own[part::CALIBRATE]] = len(own) >= 2 * CALIBRATE
    full = np.flatnonzero((np.diff(words.edges) > 0) & ~aside)
    for _ in range(WHOLE_EPOCHS):
        epoch(words.edges[full], words.edges[full + 1], labels[full])
    for _ in range(WINDOW_EPOCHS):
        _, at = highest(words.logits(flat().weights, starts, ends), owner, len(labels))
        top = at[(at >= 0) & ~aside]
        clean = np.flatnonzero((labels[owner] == 0) & ~aside[owner])
        drawn = random.choice(clean, min(len(clean), DRAWN * len(top)), replace=False)
        chosen = np.concatenate([top, drawn])
        epoch(starts[chosen], ends[chosen], labels[owner[chosen]])
    model = flat()
    top, at = highest(words.logits(model.weights, starts, ends) + model.bias, owner, len(labels))
    judged = (at >= 0) & (aside | ~aside.any())
    model.bias -= best_cut(top[judged], labels[judged])
    return model


def best_cut(values: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap that leaves the fewest documents on the wrong side."""
    order = np.argsort(values, kind="stable")
    values, labels = values[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(labels)]) + (len(labels) - labels.sum()) - np.concatenate([[0], np.cumsum(1 - labels)])
    inner = np.arange(1, len(values))
    best = inner[wrong[inner] == wrong[inner].min()] if len(inner) else inner
    if not len(best):
        return 0.0
    gap = best[np.argmax(values[best] - values[best - 1])]
    return float((values[gap] + values[gap - 1]) / 2)


def held_out(doc_id: str = "doc_id") -> Column:
    """One document in five, by the checksum of its id, is never learned from; a document
    without an id belongs to none of the folds and isn't learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, max_chars: int = MAX_CHARS) -> Model:
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # twice the rows wanted pass the draw, so that the order below meets no more than those
    chosen = [known.filter((F.col("toxic") == kind) & (draw < int(min(1.0, 2 * rows / sizes.get(kind, 1)) * (1 << 30)))).orderBy(
        draw, "doc_id").limit(rows) for kind in (0, 1)]
    # at most 2 * rows ids
    sample = docs.select("doc_id", "text").filter(F.length("text").between(1, max_chars)).join(
        F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = sample.toArrow().sort_by("doc_id")
    labels = found["toxic"].to_numpy().astype(np.int64)
    words = Words(found["text"].combine_chunks())
    del found  # the texts are not held while the models are fitted
    return fit_words(words, labels)


def score(docs: DataFrame, model: Model, column: str = "score", text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the score of each text in a new column."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {column: pa.array(Model(*sent.value).scores(batch.column(text)), pa.float64())}

    plain = docs if column == text else docs.drop(column)
    return with_batches(plain, run, [T.StructField(column, T.DoubleType())], drop=() if keep_text else (text,))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document its score and prediction, and whether its label was held out."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels), keep_text=False)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted to be toxic."""
    name = "score of toxicity"
    return score(docs, train(docs, labels), column=name).filter(F.col(f"`{name}`") < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
