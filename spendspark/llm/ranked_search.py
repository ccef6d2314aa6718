"""Ranked lexical search over a length-stratified index, with integer scores.

Method: documents of equal normaliser m form a stratum. An index row holds a term, one of its
counts tf within the stratum, and the documents that have the term just so often: all of them
share one impact, which is computed once. The highest tf of a query's terms in a stratum
bounds the score of every document there, and these bounds order the visits. First the strata
that some query ranks first are visited, so many as hold k documents; the k-th score found so
far is what others must reach. Of the other strata only those are read whose bound reaches it
for some query, and a task leaves out each query whose bound within its unit does not.

A stratum is dealt by hash into units of about UNIT_WORDS words and UNIT_DOCS documents, so a
stratum or a term that holds a third of all rows is many units of bounded size. Texts are
shuffled once, to their unit; the index is a written table. Postings of query terms alone are
shuffled again. Queries are worked off in blocks of about BLOCK_QUERIES queries and BLOCK_TERMS
terms, one block after the other; a block is what is broadcast.

Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. N
counts the documents with a term, L their terms, n one document's terms, df the documents with
the term; w = floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + (25 n N) div L, and a document
scores the sum of w * ((10^9 tf) div (1000 tf + 12 m)) over the query's terms with repeats.

Cases: null and empty texts have no terms; they are in no statistic and no result. Equal scores
rank by ascending id, null ids last. Rows that repeat an id are documents of their own. Queries
that repeat id and text are one query; texts without a known term yield no rows, and two texts
under one id are ranked apart. Other columns, whatever their names, are not read. Without
documents or queries the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark.llm.words import byte_table, find_words, spelled_words, text_buffers
from spendspark.session import cut

INSIDE = byte_table("letters_digits")

UNIT_WORDS = 1 << 20
UNIT_DOCS = 1 << 13
BLOCK_QUERIES = 512
BLOCK_TERMS = 100_000
TOP = 20


@dataclass
class Index:
    """postings: m, unit, term, tf, n_docs, places (of documents within their unit), and one
    row without a term per unit, whose ids are those of the places in ascending order.
    strata: m, n_docs, n_terms. n_docs and n_terms of all."""

    postings: DataFrame
    strata: DataFrame
    n_docs: int
    n_terms: int
    id_type: T.DataType


def normaliser(n: Column, n_docs: int, n_terms: int) -> Column:
    return F.lit(75) + F.call_function("div", F.lit(25) * n * F.lit(n_docs), F.lit(n_terms))


def with_length(docs: DataFrame) -> DataFrame:
    """docs with the number of terms of each text in n."""
    schema = T.StructType([*docs.schema.fields, T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            starts, _ = find_words(data, offsets, INSIDE)
            n = np.diff(np.searchsorted(starts, offsets))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n"])

    return docs.mapInArrow(run, schema)


def invert(key: tuple[pa.Scalar, ...], unit: pa.Table) -> pa.Table:
    """Index rows of one unit of a stratum."""
    unit = unit.take(pc.sort_indices(unit, sort_keys=[("id", "ascending")], null_placement="at_end"))
    words, edges = spelled_words(unit["text"].combine_chunks(), INSIDE, lower=True)
    coded = words.dictionary_encode()
    n = len(unit)
    pairs, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), np.diff(edges)),
                          return_counts=True)
    term, place = np.divmod(pairs, n)
    order = np.lexsort((place, tf, term))
    term, tf, place = term[order], tf[order], place[order]
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])))
    bounds = np.append(first, len(term))
    rows = len(first) + 1  # the last row holds the ids
    ids = unit["id"].combine_chunks()
    empty = np.zeros(rows, np.int32)
    return pa.table({
        "m": pa.array(np.full(rows, key[0].as_py()), pa.int64()),
        "unit": pa.array(np.full(rows, key[1].as_py()), pa.int64()),
        "term": pa.concat_arrays([coded.dictionary.take(pa.array(term[first])).cast(pa.string()), pa.nulls(1, pa.string())]),
        "tf": pa.array(np.append(tf[first], 0), pa.int64()),
        "n_docs": pa.array(np.append(np.diff(bounds), n), pa.int64()),
        "places": pa.ListArray.from_arrays(pa.array(np.append(bounds, bounds[-1]), pa.int32()), pa.array(place, pa.int32())),
        "ids": pa.ListArray.from_arrays(pa.array(np.append(empty, n), pa.int32()), ids)})


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit_words: int = UNIT_WORDS, unit_docs: int = UNIT_DOCS) -> Index:
    """The index of all rows of docs, as tables in the shared checkpoint folder."""
    id_type = docs.schema[doc_id].dataType
    counted = with_length(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))).filter("n > 0")
    lengths = cut(counted.groupBy("n").agg(F.count(F.lit(1)).alias("n_docs")))
    all_of = lengths.agg(F.sum("n_docs").alias("n_docs"), F.sum(F.col("n") * F.col("n_docs")).alias("n_terms")).first()
    n_docs, n_terms = int(all_of["n_docs"] or 0), int(all_of["n_terms"] or 0)
    m = normaliser(F.col("n"), n_docs, max(n_terms, 1))
    strata = lengths.groupBy(m.alias("m")).agg(F.sum("n_docs").alias("n_docs"), F.sum(F.col("n") * F.col("n_docs")).alias("n_terms"))
    units = F.greatest(F.ceil(F.col("n_docs") / unit_docs), F.ceil(F.col("n_terms") / unit_words))
    dealt = counted.withColumn("m", m).join(strata.select("m", units.alias("units")), "m").select(
        "m", F.pmod(F.xxhash64("id", "text"), "units").alias("unit"), "id", "text")
    schema = T.StructType([T.StructField("m", T.LongType()), T.StructField("unit", T.LongType()), T.StructField("term", T.StringType()),
                           T.StructField("tf", T.LongType()), T.StructField("n_docs", T.LongType()),
                           T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("ids", T.ArrayType(id_type))])
    postings = cut(dealt.groupBy("m", "unit").applyInArrow(lambda key, unit: invert(key, unit.select(["id", "text"])), schema))
    return Index(postings, strata, n_docs, n_terms, id_type)


def query_terms(queries: DataFrame, item_id: str, text: str) -> DataFrame:
    """query (a number), item_id, term and its count qtf, of every distinct query."""
    asked = cut(queries.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).distinct().withColumn(
        "query", F.monotonically_increasing_id()))
    schema = T.StructType([asked.schema["query"], asked.schema["item_id"], T.StructField("term", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, edges = spelled_words(batch.column("text"), INSIDE, lower=True)
            row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(edges)))
            yield pa.RecordBatch.from_arrays([batch.column("query").take(row), batch.column("item_id").take(row), words.cast(pa.string())],
                                             names=["query", "item_id", "term"])

    return asked.mapInArrow(run, schema).groupBy("query", "item_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


class Block:
    """The terms of a block of queries, each with the queries that hold it and what it gains
    them: w times its count there. least: the score that a query's documents must reach."""

    def __init__(self, queries: np.ndarray, terms: list[str], gains: np.ndarray, least: np.ndarray):
        self.queries = np.unique(queries)  # numbers in ascending order; below, places in it
        order = sorted(range(len(terms)), key=terms.__getitem__)
        self.asking = np.searchsorted(self.queries, queries[order])
        self.gains = gains[order]
        names = [terms[i] for i in order]
        first = [i for i, name in enumerate(names) if i == 0 or name != names[i - 1]]
        self.range_of = {names[i]: (i, end) for i, end in zip(first, [*first[1:], len(names)], strict=True)}
        self.least = least  # in the order of self.queries


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def best_of_unit(m: int, unit: pa.Table, block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the block's queries, places in the unit's ids and scores of each query's k
    best documents of a unit."""
    names = unit["term"].to_pylist()
    tf = unit["tf"].to_numpy()
    impact = impacts(tf, m)
    flat = unit["places"].combine_chunks()
    bounds, places = flat.offsets.to_numpy(), flat.values.to_numpy()
    n = len(unit["ids"][names.index(None)])
    rows_of: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        if name in block.range_of:
            rows_of.setdefault(name, []).append(i)
    bound = np.zeros(len(block.queries), np.int64)
    for name, rows in rows_of.items():
        first, end = block.range_of[name]
        bound[block.asking[first:end]] += block.gains[first:end] * impact[rows].max()
    active = np.flatnonzero((bound > 0) & (bound >= block.least))
    at = np.full(len(block.queries), -1)
    at[active] = np.arange(len(active))
    scores = np.zeros((len(active), n), np.int64)
    for name, rows in rows_of.items():
        first, end = block.range_of[name]
        asking, gains = at[block.asking[first:end]], block.gains[first:end]
        asking, gains = asking[asking >= 0], gains[asking >= 0]
        if len(asking):
            here = np.concatenate([places[bounds[i]:bounds[i + 1]] for i in rows])
            worth = np.repeat(impact[rows], bounds[np.array(rows) + 1] - bounds[rows])
            for row, gain in zip(asking.tolist(), gains.tolist(), strict=True):
                scores[row, here] += gain * worth
    found = []
    for row, query in enumerate(active.tolist()):
        own = scores[row]
        good = np.flatnonzero(own >= max(1, int(block.least[query])))
        if len(good) > k:
            good = good[own[good] >= np.partition(own[good], len(good) - k)[len(good) - k]]
        good = good[np.argsort(-own[good], kind="stable")][:k]
        found.append((np.full(len(good), query), good, own[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def visit(postings: DataFrame, spark: SparkSession, block: Block, k: int, id_type: T.DataType) -> DataFrame:
    """query, doc_id, score of each query's k best documents in every unit of the postings."""
    sent = spark.sparkContext.broadcast(block)
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])

    def run(key: tuple[pa.Scalar, ...], unit: pa.Table) -> pa.Table:
        queries, places, scores = best_of_unit(key[0].as_py(), unit, sent.value, k)
        ids = unit["ids"].combine_chunks()
        return pa.table({"query": pa.array(sent.value.queries[queries], pa.int64()), "doc_id": ids.flatten().take(pa.array(places)),
                         "score": pa.array(scores, pa.int64())})

    return postings.groupBy("m", "unit").applyInArrow(run, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = TOP, item_id: str = "item_id", text: str = "text",
           block_queries: int = BLOCK_QUERIES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every query."""
    spark = queries.sparkSession
    wanted = cut(query_terms(queries, item_id, text))
    # highest tf of every asked term in each stratum, and its documents there
    in_stratum = cut(index.postings.filter("term IS NOT NULL").join(wanted.select("term").distinct(), "term").groupBy("term", "m").agg(
        F.max("tf").alias("top"), F.sum("n_docs").alias("n_docs")))
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * index.n_docs + 2) / (2.0 * F.sum("n_docs") + 1))).cast("long")
    weights = in_stratum.groupBy("term").agg(weight.alias("w"))
    gains = cut(wanted.join(weights, "term").select("query", "item_id", "term", (F.col("w") * F.col("qtf")).alias("gain")))
    sizes = gains.agg(F.countDistinct("query").alias("queries"), F.count(F.lit(1)).alias("terms")).first()
    n_blocks = max(1, math.ceil(sizes["queries"] / block_queries), math.ceil(sizes["terms"] / block_terms))
    m = F.col("m")
    best_impact = F.call_function("div", F.lit(1_000_000_000) * F.col("top"), F.lit(1000) * F.col("top") + F.lit(12) * m)
    found = None
    for number in range(n_blocks):
        own = gains.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == number)
        asked = own.select("query", "term", "gain").toArrow()
        if not asked.num_rows:
            continue
        bounds = cut(own.join(in_stratum, "term").groupBy("query", "m").agg(F.sum(F.col("gain") * best_impact).alias("bound")).filter("bound > 0"))
        # documents in strata that a query would visit before this one
        before = Window.partitionBy("query").orderBy(F.col("bound").desc(), "m").rowsBetween(Window.unboundedPreceding, -1)
        first = bounds.join(index.strata.select("m", "n_docs"), "m").withColumn("before", F.coalesce(F.sum("n_docs").over(before), F.lit(0)))
        visited = cut(first.filter(F.col("before") < k).select("m").distinct())
        terms = own.select("term").distinct()
        rows = index.postings.filter("term IS NOT NULL").join(terms, "term", "left_semi").select("m", "unit", "term", "tf", "places", F.lit(None).cast(
            T.ArrayType(index.id_type)).alias("ids")).unionByName(index.postings.filter("term IS NULL").select("m", "unit", "term", "tf", "places", "ids"))
        numbers, names, gain = asked["query"].to_numpy(), asked["term"].to_pylist(), asked["gain"].to_numpy()
        everyone = np.unique(numbers)
        begun = cut(ranked(visit(rows.join(visited, "m", "left_semi"), spark, Block(numbers, names, gain, np.ones(len(everyone), np.int64)), k,
                                 index.id_type), k))
        # at most one row per query of the block
        reached = cut(begun.filter(F.col("rank") == k).select("query", F.col("score").alias("least")))
        least = np.ones(len(everyone), np.int64)
        for row in reached.collect():
            least[np.searchsorted(everyone, row["query"])] = row["least"]
        others = bounds.join(visited, "m", "left_anti").join(reached, "query", "left").filter(
            F.col("bound") >= F.coalesce("least", F.lit(1))).select("m").distinct()
        rest = visit(rows.join(others, "m", "left_semi"), spark, Block(numbers, names, gain, least), k, index.id_type)
        best = ranked(begun.select("query", "doc_id", "score").unionByName(rest), k)
        found = best if found is None else found.unionByName(best)
    items = gains.select("query", "item_id").distinct()
    if found is None:
        found = spark.createDataFrame([], T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", index.id_type),
                                                        T.StructField("score", T.LongType()), T.StructField("rank", T.IntegerType())]))
    return found.join(items, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def report(docs: DataFrame, queries: DataFrame) -> DataFrame:
    return search(build(docs.select("doc_id", "text")), queries.select("item_id", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qtf FROM b GROUP BY item_id, term),
f AS (SELECT q.item_id, p.doc_id, CAST(sum(q.qtf * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.n_docs) // s.n_terms)))) AS BIGINT) AS score
      FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term, s GROUP BY q.item_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
