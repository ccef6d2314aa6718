"""Periodic runs of words, found from string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are equal) of at least
max(LEAST, 3 * q) words that neither neighbour extends.

Method: at every dyadic scale t (a power of two from FIRST_SCALE on) the synchronising set
holds the positions whose hashed t-word substring is the least, by hash, of the t + 1
substrings that begin in their window, at either end of it; substrings of period t/3 or less
are left out of the contest. Whether a position belongs depends on the 2t words from there
alone, so equal contexts are selected alike. A run of period p with 1.5t <= p < 3t has two
selected positions p apart with equal contexts: were none selected in its first part, that
part would have a period of t/3 or less, and with period p the run's own would be shorter
still. Equal contexts in the set are over t/3 apart, so at most MEETINGS neighbours in the
order of contexts can lie p apart. Such pairs propose periods; neighbouring pairs of one
distance form a chain, which is compared word by word and grown to both sides. The highly
periodic regions that a scale leaves out are the runs of the smaller scales; periods below
1.5 * FIRST_SCALE are detected by direct comparison of words so far apart.

Hashes select and propose only: every run is compared word by word, so the result is exact. A text of
n words takes part in scales up to n / 4.5, and each costs a few passes over it in numpy. A
task works off texts of like length together, in groups of about GROUP words or one text.

Cases: words are runs of anything but ASCII white space, compared by their bytes. Null and
empty texts have no words and no runs. Rows are judged one by one, so repeated rows and ids, ties
and null ids need no rule. Added columns replace columns of the same names; others pass through.
Where two runs have the same exponent the one with the smaller start, then period, is the greatest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark.llm.frames import with_batches
from spendspark.llm.words import byte_table, mix, spelled_words

INSIDE = byte_table("not_space")

LEAST = 24  # words
REPEATS = 3
FIRST_SCALE = 4
MEETINGS = 9  # equal contexts of a set are over t/3 apart: 3t / (t/3)
GROUP = 1 << 20  # words
STEP = 32  # words compared at first when a chain is grown

FREE = np.uint64(0xFFFFFFFFFFFFFFFF)  # outside the contest
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of every stretch of true values."""
    steps = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return steps[::2], steps[1::2]


def compared(words: np.ndarray, period: int, first: int = 0, end: int | None = None) -> np.ndarray:
    """start, length, period of the repeats of a period in words[first:end], by comparison."""
    own = words[first:end]
    a, b = stretches(own[:-period] == own[period:])
    good = b - a >= (REPEATS - 1) * period
    return np.stack([a[good] + first, b[good] - a[good] + period, np.full(good.sum(), period)], 1)


def agreeing(words: np.ndarray, left: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """How many words in a row, from left on in the direction of step, equal the word a period later."""
    done = np.zeros(len(left), np.int64)
    active, width = np.arange(len(left)), STEP
    while len(active):
        x = left[active, None] + step * (done[active, None] + np.arange(width))
        y = x + period[active, None]
        equal = (x >= 0) & (y < len(words)) & (words[np.clip(x, 0, len(words) - 1)] == words[np.clip(y, 0, len(words) - 1)])
        whole = equal.all(1)
        done[active] += np.where(whole, width, equal.argmin(1))
        active = active[whole]
        width = max(STEP, min(2 * width, GROUP // max(1, len(active))))
    return done


def lowest(values: np.ndarray, scale: int) -> np.ndarray:
    """Least value of values[i:i + scale + 1] for each i, scale a power of two."""
    least, width = values, 1
    while width < scale:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    return np.minimum(least[:len(values) - scale], values[scale:])


def synchronising(hashes: np.ndarray, scale: int, known: np.ndarray) -> np.ndarray:
    """The selected positions: hashes are those of the substrings of scale words; known are
    the repeats (start, length, period) of smaller periods."""
    regions = known[(REPEATS * known[:, 2] <= scale) & (known[:, 1] >= scale)]
    contest = mix(hashes ^ np.uint64(scale))
    if len(regions):
        depth = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(depth, regions[:, 0], 1)
        np.add.at(depth, regions[:, 0] + regions[:, 1] - scale + 1, -1)
        contest[np.cumsum(depth[:-1]) > 0] = FREE
    least = lowest(contest, scale)
    return np.flatnonzero((least != FREE) & ((contest[:len(least)] == least) | (contest[scale:] == least)))


def proposed(contexts: np.ndarray, selected: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected positions and distances of pairs with equal contexts, 1.5 to 3 scales apart."""
    keys = contexts[selected]
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], selected[order]
    starts, distances = [], []
    for k in range(1, MEETINGS + 1):
        apart = places[k:] - places[:-k]
        near = (keys[k:] == keys[:-k]) & (apart < 3 * scale)
        if not near.any():
            break
        good = near & (2 * apart >= 3 * scale)
        starts.append(places[:-k][good])
        distances.append(apart[good])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(starts), np.concatenate(distances)) if starts else (empty, empty)


def grown(words: np.ndarray, starts: np.ndarray, periods: np.ndarray, context: int) -> np.ndarray:
    """Repeats around the proposed pairs, as start, length, period."""
    order = np.lexsort((starts, periods))
    starts, periods = starts[order], periods[order]
    opens = np.append(True, (np.diff(periods) != 0) | (np.diff(starts) > context))
    first, last = starts[opens], starts[np.append(np.flatnonzero(opens)[1:] - 1, len(starts) - 1)]
    period, end = periods[opens], last + context
    first = first - agreeing(words, first - 1, period, -1)
    end = end + agreeing(words, end, period, 1)
    found = []
    for a, b, p in zip(first.tolist(), end.tolist(), period.tolist(), strict=True):
        if b - a >= (REPEATS - 1) * p:
            if (words[a:b] == words[a + p:b + p]).all():
                found.append(np.array([[a, b - a + p, p]]))
            else:  # hashes were equal though words are not
                found.append(compared(words, p, a, b + p))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def repeats(words: np.ndarray, longest: int) -> np.ndarray:
    """Every run (start, length, period) of words, the words of one or several texts of at
    most `longest` words, each closed by a word of its own."""
    known = [compared(words, p) for p in range(1, 3 * FIRST_SCALE // 2)]
    hashes = mix(words.astype(np.uint64) + np.uint64(1))
    scale = 1
    while 9 * scale <= 2 * longest:
        contexts = mix(hashes[:-scale] * np.uint64(0x9E3779B97F4A7C15) + hashes[scale:]) if len(hashes) > scale else hashes[:0]
        if scale >= FIRST_SCALE and len(contexts) > scale:
            selected = synchronising(hashes, scale, np.concatenate(known))
            starts, periods = proposed(contexts, selected[selected < len(contexts)], scale)
            if len(starts):
                known.append(grown(words, starts, periods, 2 * scale))
        hashes, scale = contexts, 2 * scale
    found = np.concatenate(known)
    found = found[found[:, 1] >= np.maximum(LEAST, REPEATS * found[:, 2])]
    # the same stretch is also found with multiples of its period
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.append(True, (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0)) if len(found) else np.zeros(0, bool)
    return found[fresh]


def find_runs(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in texts words[edges[k]:edges[k + 1]] as (start, length, period) within their
    text, ordered by text, start and period; and the number of runs of each text."""
    lengths = np.diff(edges)
    own, found = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] >= LEAST]
    sizes = np.cumsum(lengths[order] + 1)
    at = 0
    while at < len(order):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, min(int(np.searchsorted(sizes, before + GROUP, "right")),
                              int(np.searchsorted(lengths[order], 2 * lengths[order[at]], "right"))))
        texts = order[at:end]
        begins = np.cumsum(np.append(0, lengths[texts] + 1))
        joined = np.empty(begins[-1], np.int64)
        inside = np.ones(len(joined), bool)
        inside[begins[1:] - 1] = False
        joined[~inside] = -1 - np.arange(len(texts))  # closes the text, equal to no other word
        joined[inside] = words[np.concatenate([np.arange(edges[t], edges[t + 1]) for t in texts])]
        runs = repeats(joined, int(lengths[texts[-1]]))
        place = np.searchsorted(begins, runs[:, 0], "right") - 1
        runs[:, 0] -= begins[place]
        own.append(texts[place])
        found.append(runs)
        at = end
    own, found = np.concatenate(own), np.concatenate(found)
    order = np.lexsort((found[:, 2], found[:, 0], own))
    return found[order], np.bincount(own, minlength=len(lengths))


def collapsed(words: pa.Array, edges: np.ndarray, runs: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The texts without the words that a run holds after its first period, one space between."""
    depth = np.zeros(len(words) + 1, np.int64)
    begins = np.repeat(edges[:-1], counts) + runs[:, 0]
    np.add.at(depth, begins + runs[:, 2], 1)
    np.add.at(depth, begins + runs[:, 1], -1)
    stays = np.cumsum(depth[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(stays)])[edges]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(stays)).cast(pa.string())), " ")


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", rest: str = "collapsed", keep_text: bool = True) -> DataFrame:
    """docs with the runs of each text, ordered by start and period, and with the text that
    is left when each run keeps its first period alone."""
    added = [T.StructField(runs, T.ArrayType(RUN)), T.StructField(rest, T.StringType())]

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        words, edges = spelled_words(batch.column(text), INSIDE)
        numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found, counts = find_runs(numbers, edges)
        fields = pa.StructArray.from_arrays([pa.array(found[:, i], pa.int64()) for i in range(3)], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), fields)
        return {runs: lists, rest: collapsed(words, edges, found, counts)}

    plain = docs.drop(*{runs, rest} - {text})
    return with_batches(plain, run, added, drop=() if keep_text else (text,))


def greatest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in which the texts of ids with checksum 0 modulo 10 repeat a stretch of words up to their end."""
    checksum = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))
    g = F.floor(checksum / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.call_function("div", n - a, F.lit(3) + g % 8)
        return F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda at: F.array_join(F.transform(
            words, lambda word, i: F.when(i >= at["a"], F.get(words, (at["a"] + (i - at["a"]) % at["p"]).cast("int"))).otherwise(word)), " "))

    words = F.filter(F.split(F.col(f"`{text}`"), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    changed = F.get(F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.array(F.lit(""))))), F.lit(0))
    return docs.withColumn(text, F.when(checksum % 10 == 0, changed).otherwise(F.col(f"`{text}`")))


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, its greatest run, and digests of the runs and of the rest."""
    found = with_runs(planted(docs.select("doc_id", "text")), keep_text=False).withColumn("best", greatest(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.call_function("div", F.lit(1000) * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# Pairs of equal words p apart, 16 or more in a row (a run of max(24, 3p) words has as many):
# where a row of 16 words recurs, its matches are chained by their distance.
SQL = r"""
WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
        xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::UBIGINT)),
            lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                lambda d, z: xor(d >> 1, 3988292384::UBIGINT * (d & 1::UBIGINT)))), 4294967295::UBIGINT)::BIGINT AS h FROM documents),
b AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS changed, h // 10 AS g FROM a),
c AS (SELECT *, CASE WHEN changed THEN g % n END AS a FROM b),
d AS (SELECT *, CASE WHEN changed THEN 1 + (n - a) // (3 + g % 8) END AS p FROM c),
w AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(CASE WHEN changed THEN list_transform(range(0, n), lambda i:
        ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE ws END) AS word FROM d WHERE n > 0),
g AS (SELECT doc_id, i, hash(string_agg(word, ' ') OVER v) AS gram, count(*) OVER v AS k
      FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM g x JOIN g y ON y.doc_id = x.doc_id AND y.gram = x.gram AND y.i > x.i WHERE x.k = 16 AND y.k = 16),
o AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS chain FROM m),
s AS (SELECT doc_id, p, min(i) AS start, count(*) + 15 + p AS length FROM o GROUP BY doc_id, p, chain),
r AS (SELECT doc_id, start, length, min(p) AS period FROM s WHERE length >= greatest(24, 3 * p) GROUP BY doc_id, start, length),
f AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
t AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
e AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS rest FROM w ANTI JOIN t ON t.doc_id = w.doc_id AND t.i = w.i GROUP BY w.doc_id),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM r)
SELECT d.doc_id, coalesce(f.n_runs, 0) AS n_runs, z.start, z.length, z.period, (1000 * z.length) // z.period AS exponent_milli,
       sha256(coalesce(f.listed, '')) AS runs_sha256, sha256(coalesce(e.rest, '')) AS collapsed_sha256
FROM d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id AND z.k = 1
"""
