"""Substring dedup by hashing of sentences and lines.

Method: a text is cut into units at line ends and after sentence ends, so a line of several
sentences gives several units. A unit is normalised (lower case, runs of anything but letters
and digits become one space) and named by the MD5 of that. Digests are grouped over all
documents; the earliest occurrence by (doc_id, hash of the text, place) is kept and the rest
are removed, as runs of repeats that follow each other in a document. Offsets of what was
removed are code points in the original text, end exclusive.

min_words is a caller's choice, 0 by default: runs of fewer words stay. The registered query
takes QUERY_WORDS, because sentences of a word or two ("As.") repeat by chance in most documents.

Texts are cut into units once and the places written. Digests are counted first, by partial
counts; places of digests that occur once go no further. Those of the others are written too. A digest that a third of all documents hold is
reduced to its earliest place by partial minimums before the shuffle and joined back as one
row, by a join that Spark splits. Only places of repeats are gathered per document, and only
documents whose repeats hold min_words are cut into units again.

Cases: null and empty texts, and units without letters or digits, repeat nothing; the latter
neither break nor lengthen a run; those between two repeats of a run go with it. Rows that repeat both doc_id and text are judged as one
row, so each loses the same spans; null ids rank first. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark.session import cut

QUERY_WORDS = 12
UNIT = r"[^\n.!?]*+(?:[.!?]++(?![ \t\r\n])[^\n.!?]*+)*+(?:[.!?]++[ \t]*+)?+\n?+"
MARK = "hash of the text"


def normal(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " "))


def units(text: Column) -> Column:
    """The units of a text, which joined together are the text."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0)), lambda u: u != "")


def described(text: Column) -> Column:
    """Digest (null without letters and digits), words and length of every unit."""
    def one(unit: Column) -> Column:
        words = lambda n: F.length(n) - F.length(F.replace(n, F.lit(" "))) + 1
        return F.element_at(F.transform(F.array(normal(unit)), lambda n: F.struct(
            F.when(n != "", F.unhex(F.md5(n))).alias("digest"), F.when(n != "", words(n)).otherwise(0).alias("words"),
            F.length(unit).alias("length"))), 1)

    return F.transform(units(text), one)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 0) -> DataFrame:
    """id, mark and the places (number of the unit, in order) of repeated units, of the rows whose
    repeats hold min_words."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text <> ''").select(
        "id", F.xxhash64("text").alias("mark"), described(F.col("text")).alias("units"))
    places = cut(rows.select("id", "mark", F.posexplode("units").alias("place", "unit")).filter("unit.digest IS NOT NULL").select(
        F.col("unit.digest").alias("digest"), "id", "mark", "place", F.col("unit.words").alias("words")))
    several = places.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    shared = cut(places.join(several, "digest", "left_semi"))
    at = F.struct("id", "mark", "place")
    earliest = shared.groupBy("digest").agg(F.min(at).alias("earliest"))
    later = shared.join(earliest, "digest").filter(~at.eqNullSafe(F.col("earliest")))
    return later.groupBy("id", "mark").agg(F.array_sort(F.collect_set("place")).alias("places"), F.sum("words").alias("words")).filter(
        F.col("words") >= min_words).drop("words")


def spans(described_units: Column, places: Column, min_words: int = 0) -> Column:
    """Start and end of the runs of repeats with enough words; places are in order."""
    span = "struct<start:int,end:int,words:int>"
    empty = F.array().cast(f"array<{span}>")
    numbered = F.transform(described_units, lambda u, i: F.struct(
        u["digest"].isNull().alias("silent"), i.alias("place"), u["words"].alias("words"), u["length"].alias("length")))
    none = F.lit(None).cast(span)

    def step(acc: Column, u: Column) -> Column:
        end = acc["at"] + u["length"]
        repeat = F.coalesce(F.get(places, acc["met"]) == u["place"], F.lit(False))
        grown = F.struct(F.coalesce(acc["run"]["start"], acc["at"]).alias("start"), end.alias("end"),
                         (F.coalesce(acc["run"]["words"], F.lit(0)) + u["words"]).alias("words"))
        run = F.when(repeat, grown).when(u["silent"], acc["run"]).otherwise(none)
        closed = F.when(~repeat & ~u["silent"] & acc["run"].isNotNull(), F.concat(acc["done"], F.array(acc["run"]))).otherwise(acc["done"])
        return F.struct(end.alias("at"), (acc["met"] + repeat.cast("int")).alias("met"), run.alias("run"), closed.alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("met"), none.alias("run"), empty.alias("done"))
    runs = F.aggregate(numbered, start, step, lambda acc: F.when(acc["run"].isNotNull(), F.concat(acc["done"], F.array(acc["run"]))).otherwise(acc["done"]))
    return F.filter(runs, lambda r: r["words"] >= min_words)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 0) -> DataFrame:
    """docs with the text that stays, and removed: the spans of the original text that went."""
    found = repeats(docs, doc_id, text, min_words).select(F.col("id").alias("key of id"), F.col("mark").alias("key of mark"), "places")
    named = docs.drop("removed", "places").withColumn(MARK, F.xxhash64(F.col(text)))
    same = F.col(doc_id).eqNullSafe(F.col("`key of id`")) & (F.col(f"`{MARK}`") == F.col("`key of mark`"))
    met = named.join(found, same, "left").withColumn(
        "removed", F.when(F.col("places").isNotNull(), spans(described(F.col(text)), F.col("places"), min_words)).otherwise(
            F.array().cast("array<struct<start:int,end:int,words:int>>")))
    kept = F.aggregate("removed", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
                       lambda acc, r: F.struct(r["end"].alias("at"), F.concat(
                           acc["out"], F.substring(F.col(text), acc["at"] + 1, r["start"] - acc["at"])).alias("out")),
                       lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    columns = [F.when(F.size("removed") > 0, kept).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`")
               for c in docs.columns if c not in ("removed", "places")]
    return met.select(*columns, "removed")


def report(docs: DataFrame) -> DataFrame:
    """Per document the text that stays and what went, as start:end joined by commas."""
    return dedup(docs.select("doc_id", "text"), min_words=QUERY_WORDS).select(
        "doc_id", "text", F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"])), ",").alias("removed_spans"))


SQL = rf"""
WITH u AS (SELECT doc_id, unnest(units) AS unit, unnest(range(len(units))) AS place
           FROM (SELECT doc_id, regexp_extract_all(text, '(?:[^\n.!?]|[.!?]+[^ \t\r\n.!?])*(?:[.!?]+[ \t]*)?\n?') AS units
                 FROM documents WHERE text <> '')),
n AS (SELECT *, trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS norm FROM u WHERE unit <> ''),
f AS (SELECT *, norm <> '' AS loud, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) > 1 AS again FROM n),
g AS (SELECT *, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY place) AS stop,
             sum(CASE WHEN loud AND NOT again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM f),
r AS (SELECT doc_id, run, min(place) AS first, max(place) AS last, min(stop - length(unit)) AS start, max(stop) AS stop
      FROM g WHERE again GROUP BY doc_id, run HAVING sum(length(norm) - length(replace(norm, ' ', '')) + 1) >= {QUERY_WORDS}),
k AS (SELECT g.doc_id, string_agg(g.unit, '' ORDER BY g.place) AS kept
      FROM g LEFT JOIN r ON g.doc_id = r.doc_id AND g.run = r.run AND g.place BETWEEN r.first AND r.last WHERE r.run IS NULL GROUP BY g.doc_id),
s AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(CAST(start AS bigint) AS varchar) || ':' || CAST(CAST(stop AS bigint) AS varchar), ','
             ORDER BY start) AS removed_spans FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN d.text ELSE coalesce(k.kept, '') END AS text, coalesce(s.n_removed, 0) AS n_removed,
       coalesce(s.removed_spans, '') AS removed_spans
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)
"""
