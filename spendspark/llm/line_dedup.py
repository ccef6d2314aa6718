"""Line dedup by content-defined chunks of lines, in column expressions.

Method: every line is hashed, a rolling hash over WINDOW lines is taken at each line, and a
chunk ends where it begins with one of ENDS (one line in four). So where a chunk ends depends
on the lines next to it alone, and lines inserted above move no later boundary. Chunks of
at least two lines that occur more than once anywhere are removed, but for the first
occurrence by (doc_id, hash of the text, place). An occurrence is removed only if its bytes
equal those of the first one.

Occurrences meet by a 64-bit key without their text; only repeated ones fetch their bytes.
Counts and first places aggregate partially before the shuffle. A chunk that a third of all
documents hold becomes one row per task there, and the join with its bytes, one row per key,
is one that Spark splits.

A text of very many lines costs time and memory in proportion to its length: before the join by
key a row carries the place and the key of one chunk, after it the chunk's own bytes.

Cases: null and empty texts and texts of one line stay as they are. Rows that repeat both
doc_id and text are judged as one row, so each keeps or loses the same lines; null ids rank
first. Chunks that differ though their keys are equal stay. Removed chunks take the line feed
that joins them to the next with them. Other columns pass through.

Two ways to take more. dedup(copies=True) empties a text of several lines that equals that of
an earlier row, with its chunks of one line; such a text is one more chunk there, met by the
same key and compared by SHA-256. dedup_runs takes every two neighbouring lines
that aren't blank, with the blank lines between them, in place of chunks. So a repeated run
of two such lines or more goes whole, wherever the lines around it would end a chunk, and
of every line that goes an equal one stays at an earlier place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 2  # lines
ENDS = ("0", "4", "8", "c")  # first digits of a rolling hash that end a chunk

LINES = "lines of the text"
MARK = "hash of the text"
REMOVED = "chunks removed"
GONE = "lines removed"
WHOLE = -1  # first and last line of the chunk that is a whole text
NOT_BLANK = r"[^\x20\x09-\x0D]"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def chunk_bounds(lines: Column) -> Column:
    """First line and number of lines (both from 0) of every chunk."""
    def bounds(hashes: Column) -> Column:
        rolling = lambda i: F.md5(F.array_join(F.slice(hashes, F.greatest(i - WINDOW + 2, F.lit(1)), F.least(i + 1, F.lit(WINDOW))), ""))
        last = F.size(hashes) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | F.substring(rolling(i), 1, 1).isin(*ENDS))
        return F.transform(F.array(ends), lambda found: F.transform(found, lambda end, k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(F.element_at(found, F.greatest(k, F.lit(1))) + 1).alias("first"), end.alias("end"))))

    hashed = F.transform(F.array(F.transform(lines, F.md5)), bounds)
    return F.flatten(F.flatten(hashed))


def pair_bounds(lines: Column) -> Column:
    """First and last line (both from 0) of every two neighbouring lines that aren't blank."""
    places = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(NOT_BLANK), i)), lambda i: i.isNotNull())
    return F.flatten(F.transform(F.array(places), lambda found: F.transform(F.slice(found, 2, F.size(found)), lambda end, k: F.struct(
        F.get(found, k).alias("first"), end.alias("end")))))


def several(chunks: Column) -> Column:
    return F.filter(chunks, lambda c: c["end"] > c["first"])


def chunk_text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["first"] + 1, chunk["end"] - chunk["first"] + 1), "\n")


def with_lines(text: Column, of_lines: Callable[[Column], Column]) -> Column:
    """The array that of_lines makes of a text's lines, which are split once."""
    return F.flatten(F.transform(F.array(lines_of(text)), of_lines))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("mark", F.xxhash64("text")).filter(
        F.instr("text", "\n") > 0)


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bounds: Callable[[Column], Column] = chunk_bounds,
             copies: bool = False) -> DataFrame:
    """id, mark (hash of the text) and the chunks to remove (first and last line). copies: a text
    that an earlier row has whole has one chunk, from WHOLE to WHOLE, in place of its others."""
    rows = keyed(docs, doc_id, text)

    def keys(lines: Column) -> Column:
        return F.transform(several(bounds(lines)), lambda c: F.struct(
            c["first"].alias("first"), c["end"].alias("end"), F.xxhash64(chunk_text(lines, c)).alias("key")))

    # no row carries more of a text than the numbers and the key of one chunk
    chunks = with_lines(F.col("text"), keys)
    if copies:
        chunks = F.concat(chunks, F.array(F.struct(F.lit(WHOLE).alias("first"), F.lit(WHOLE).alias("end"), F.xxhash64(
            F.lit("whole"), F.col("text")).alias("key"))))
    places = rows.select("id", "mark", F.explode(chunks).alias("chunk")).select(
        F.col("chunk.key").alias("key"), F.struct("id", "mark", F.col("chunk.first").alias("first")).alias("place"), F.col("chunk.end").alias("end"))
    # rows that repeat id and text meet in one row per place
    repeated = places.groupBy("key").agg(F.min("place").alias("earliest"), F.max("place").alias("latest")).filter(
        ~F.col("earliest").eqNullSafe(F.col("latest"))).select("key", "earliest")
    suspects = places.join(repeated, "key").groupBy("place.id", "place.mark").agg(
        F.collect_set(F.struct(F.col("place.first").alias("first"), "end", "key", F.col("place").eqNullSafe(F.col("earliest")).alias("is_first"))).alias("suspects"))
    if copies:
        gone = F.filter("suspects", lambda s: (s["first"] == WHOLE) & ~s["is_first"])
        suspects = suspects.withColumn("suspects", F.when(F.size(gone) > 0, gone).otherwise(F.col("suspects")))
    wanted = suspects.select(F.col("id").alias("key_id"), F.col("mark").alias("key_mark"), "suspects")
    same = F.col("id").eqNullSafe(F.col("key_id")) & (F.col("mark") == F.col("key_mark"))

    def bodies(lines: Column) -> Column:
        return F.transform("suspects", lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end"), s["key"].alias("key"), s["is_first"].alias(
            "is_first"), F.when(s["first"] == WHOLE, F.sha2("text", 256)).otherwise(chunk_text(lines, s)).alias("body")))

    found = rows.join(wanted, same).select("id", "mark", F.explode(with_lines(F.col("text"), bodies)).alias("found")).select("id", "mark", "found.*")
    firsts = found.filter("is_first").groupBy("key").agg(F.min("body").alias("first_body"))
    equal = found.filter("not is_first").join(firsts, "key").filter("body = first_body")
    return equal.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "end")).alias("removed"))


def with_removals(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with their lines, the chunks removed and the numbers of all lines in these."""
    keys = found.withColumnsRenamed({"id": "key of id", "mark": "key of mark", "removed": REMOVED})
    named = docs.withColumn(MARK, F.xxhash64(F.col(f"`{text}`")))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("`key of id`")) & (F.col(f"`{MARK}`") == F.col("`key of mark`"))
    gone = F.array_distinct(F.flatten(F.transform(F.col(f"`{REMOVED}`"), lambda c: F.sequence(c["first"], c["end"]))))
    return named.join(keys, same, "left").withColumn(LINES, lines_of(F.col(f"`{text}`"))).withColumn(
        GONE, F.coalesce(gone, F.array().cast("array<int>")))


def rest() -> Column:
    """The lines that stay. Each step is linear in the number of lines."""
    left = F.array_except(F.sequence(F.lit(0), F.size(f"`{LINES}`") - 1), F.col(f"`{GONE}`"))
    return F.flatten(F.transform(F.array(F.struct(F.col(f"`{LINES}`").alias("lines"), left.alias("left"))), lambda both: F.transform(
        both["left"], lambda i: F.get(both["lines"], i))))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", copies: bool = False) -> DataFrame:
    """docs with the text that stays and, in three further columns, what left it: n_lines
    before, removed_chunks, removed_lines. copies: texts of several lines that an earlier
    row has whole lose all their chunks."""
    given = docs.drop("n_lines", "removed_chunks", "removed_lines")
    met = with_removals(given, removals(docs, doc_id, text, copies=copies), doc_id, text)
    touched = F.col(f"`{REMOVED}`").isNotNull()
    whole = F.coalesce(F.exists(F.col(f"`{REMOVED}`"), lambda c: c["first"] == WHOLE), F.lit(False))
    n_chunks = F.when(whole, F.size(with_lines(F.col(f"`{text}`"), chunk_bounds))).otherwise(F.size(f"`{REMOVED}`"))
    return met.select(
        *[F.when(whole, F.lit("")).when(touched, F.array_join(rest(), "\n")).otherwise(F.col(f"`{text}`")).alias(text) if c == text else F.col(f"`{c}`")
          for c in given.columns],
        n_lines(text), F.when(touched, n_chunks).otherwise(0).cast("long").alias("removed_chunks"),
        F.when(whole, F.size(f"`{LINES}`")).otherwise(F.size(f"`{GONE}`")).cast("long").alias("removed_lines"))


def n_lines(text: str) -> Column:
    return F.when(F.coalesce(F.col(f"`{text}`"), F.lit("")) == "", F.lit(0)).otherwise(F.size(f"`{LINES}`")).cast("long").alias("n_lines")


def dedup_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without repeated runs of two or more lines that aren't blank and, in three
    further columns, what left them: n_lines before, removed_runs, removed_lines."""
    given = docs.drop("n_lines", "removed_runs", "removed_lines")
    met = with_removals(given, removals(docs, doc_id, text, pair_bounds), doc_id, text)
    begins = F.array_except(F.col(f"`{GONE}`"), F.transform(F.col(f"`{GONE}`"), lambda i: i + 1))
    return met.select(
        *[F.when(F.size(f"`{GONE}`") > 0, F.array_join(rest(), "\n")).otherwise(F.col(f"`{text}`")).alias(text) if c == text else F.col(f"`{c}`")
          for c in given.columns],
        n_lines(text), F.size(begins).cast("long").alias("removed_runs"), F.size(f"`{GONE}`").cast("long").alias("removed_lines"))


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text"))


def report_runs(docs: DataFrame) -> DataFrame:
    return dedup_runs(docs.select("doc_id", "text"))


SQL = """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text <> ''),
r AS (SELECT *, md5(coalesce(lag(md5(line)) OVER w, '') || md5(line))[1:1] IN ('0', '4', '8', 'c') AS ends
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM r),
b AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n FROM c GROUP BY doc_id, chunk),
o AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) > 1 AS lost FROM b)
SELECT d.doc_id, CASE WHEN coalesce(bool_or(o.lost), false) THEN coalesce(string_agg(o.body, chr(10) ORDER BY o.chunk) FILTER (NOT o.lost), '')
                 ELSE any_value(d.text) END AS text,
       CAST(coalesce(sum(o.n), 0) AS BIGINT) AS n_lines, CAST(coalesce(sum(o.lost::INT), 0) AS BIGINT) AS removed_chunks,
       CAST(coalesce(sum(o.n) FILTER (o.lost), 0) AS BIGINT) AS removed_lines
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id
"""

RUNS_SQL = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
f AS (SELECT doc_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t),
p AS (SELECT doc_id, ls, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM f WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
b AS (SELECT doc_id, i, e, array_to_string(ls[i:e], chr(10)) AS body FROM p WHERE e IS NOT NULL),
r AS (SELECT doc_id, i, e FROM b QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, e + 1)) AS i FROM r),
k AS (SELECT f.doc_id, f.i, f.line, g.i IS NOT NULL AS lost FROM f LEFT JOIN g ON g.doc_id = f.doc_id AND g.i = f.i),
o AS (SELECT *, lost AND NOT coalesce(lag(lost) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM k)
SELECT d.doc_id, CASE WHEN coalesce(bool_or(o.lost), false) THEN coalesce(string_agg(o.line, chr(10) ORDER BY o.i) FILTER (NOT o.lost), '')
                 ELSE any_value(d.text) END AS text,
       CAST(count(o.i) AS BIGINT) AS n_lines, CAST(coalesce(sum(o.begins::INT), 0) AS BIGINT) AS removed_runs,
       CAST(coalesce(sum(o.lost::INT), 0) AS BIGINT) AS removed_lines
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id
"""
