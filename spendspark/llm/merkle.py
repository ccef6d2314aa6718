"""Document fingerprints: a Merkle tree over paragraphs and sections, in column expressions.

Method: a paragraph is a line; its leaves are runs of up to four words with the spaces after
them, so together they are the whole line. A paragraph's hash is the MD5 of its leaves'
hashes, a section's of its paragraphs', the root of its sections'. A section ends after a
paragraph whose hash begins with 0 or 1 (one in eight), so an inserted paragraph moves no
other boundary.

The fingerprint is a string: root, space, sections joined by `|`; a section is its paragraphs
joined by `,`; a paragraph is its hash, `-` and the first 8 digits of each leaf's. Equal roots
mean equal texts. Of two fingerprints, equal sections and paragraphs can be skipped and only
differing ones are looked into: `changed` does so. The likeness of two is the Jaccard
similarity of their sets of leaves, 1 for equal and 0 where only one is without leaves.

Cases: a null text is an empty one; it has one empty paragraph without leaves. The next
document is that of the next larger (doc_id, hash of text), nulls first, rows that repeat both
counting once; after the last comes the first, so an only document follows itself. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendspark.session import cut

LEAVES = r"(?:[^ ]*+ ){1,4}|[^ ]++"


def _paragraph(line: Column) -> Column:
    leaves = F.transform(F.regexp_extract_all(line, F.lit(LEAVES), F.lit(0)), F.md5)
    # a one-element array binds the hashes, which are needed twice
    return F.element_at(F.transform(F.array(leaves), lambda found: F.concat(
        F.md5(F.array_join(found, "")), F.lit("-"),
        F.array_join(F.transform(found, lambda h: F.substring(h, 1, 8)), ""))), 1)


def _section_hash(section: Column) -> Column:
    return F.md5(F.array_join(F.transform(F.split(section, ","), lambda p: F.substring(p, 1, 32)), ""))


def fingerprint(text: Column) -> Column:
    paragraphs = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), _paragraph)
    closed = F.transform(paragraphs, lambda p: F.concat(p, F.when(p < "2", F.lit("|")).otherwise(F.lit(","))))
    joined = F.regexp_replace(F.array_join(closed, ""), "[|,]$", "")
    return F.element_at(F.transform(F.array(joined), lambda whole: F.concat(
        F.md5(F.array_join(F.transform(F.split(whole, r"\|"), _section_hash), "")), F.lit(" "), whole)), 1)


def leaves_of(found: Column) -> Column:
    """The leaves of a fingerprint, one string of 8 digits each."""
    return leaves_in(F.array_join(F.regexp_extract_all(found, F.lit("-([0-9a-f]*)"), F.lit(1)), ""))


def leaves_in(run: Column) -> Column:
    return F.regexp_extract_all(run, F.lit("[0-9a-f]{8}"), F.lit(0))


def leaf_run(text: Column) -> Column:
    """The leaves of a text, as they follow each other in its fingerprint."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.array_join(
        F.transform(F.regexp_extract_all(line, F.lit(LEAVES), F.lit(0)), lambda leaf: F.substring(F.md5(leaf), 1, 8)), "")), "")


def likeness(left: Column, right: Column) -> Column:
    """Of two arrays of leaves."""
    all_of = F.size(F.array_union(left, right))
    return F.when(all_of == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / all_of)


def changed(left: Column, right: Column) -> Column:
    """Paragraphs of the right fingerprint, as positions from 0, that stand in no section or
    paragraph of the left one."""
    sections = lambda f: F.split(F.substring_index(f, " ", -1), r"\|")
    old = F.flatten(F.transform(F.array_except(sections(left), sections(right)), lambda s: F.split(s, ",")))
    new = F.flatten(F.transform(sections(right), lambda s: F.transform(
        F.split(s, ","), lambda p: F.struct(p.alias("p"), F.array_contains(sections(left), s).alias("kept")))))
    place = F.transform(new, lambda e, i: F.when(~e["kept"] & ~F.array_contains(old, e["p"]), i))
    return F.when(left == right, F.array().cast("array<int>")).otherwise(F.filter(place, lambda i: i.isNotNull()))


def neighbours(keys: DataFrame) -> DataFrame:
    """For distinct rows of doc_id, mark, n_chars: the keys before and after each in order,
    as prev_id, prev_mark, prev_chars; the first comes after the last.

    Ranges of the order are dealt out and numbered; inside a range a window finds the row
    before, and the last rows of all ranges (one per range) tell the rest."""
    ranged = cut(keys.repartitionByRange("doc_id", "mark").withColumn("range", F.spark_partition_id()))
    own = F.struct("doc_id", "mark", "n_chars")
    last = ranged.groupBy("range").agg(F.max(own).alias("last"))  # one row per range
    order = Window.orderBy("range")
    before = last.select("range", F.coalesce(F.lag("last").over(order), F.last("last").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("last"))
    inside = Window.partitionBy("range").orderBy("doc_id", "mark")
    found = ranged.withColumn("prev", F.lag(own).over(inside)).join(before, "range")
    prev = F.coalesce("prev", "last")
    return found.select("doc_id", "mark", prev["doc_id"].alias("prev_id"), prev["mark"].alias("prev_mark"),
                        prev["n_chars"].alias("prev_chars"))


def report(docs: DataFrame) -> DataFrame:
    # a key without nulls, so that grouping and joining by it share one shuffle
    key = lambda doc_id: (F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(doc_id).isNull())
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[c.alias(k) for c, k in zip(key("doc_id"), ("id", "no_id"))]).withColumn(
        "mark", F.xxhash64("text"))
    links = cut(neighbours(rows.select("doc_id", "mark", F.length("text").alias("n_chars")).distinct()))
    keyed = links.select(*[c.alias(k) for c, k in zip(key("doc_id"), ("id", "no_id"))], "mark",
                         *[c.alias(k) for c, k in zip(key("prev_id"), ("to_id", "to_none"))], F.col("prev_mark").alias("to_mark"), "prev_chars")
    # what each document sends to the one before it: as many code points as that one gives up, and its leaves
    sent = rows.join(keyed, ["id", "no_id", "mark"]).select(
        F.col("to_id").alias("id"), F.col("to_none").alias("no_id"), F.col("to_mark").alias("mark"), F.col("doc_id").alias("next_id"),
        F.expr("substring(text, 1, CAST(floor(prev_chars / 4) AS INT))").alias("tail"),
        leaf_run(F.col("text")).alias("next_run")).groupBy("id", "no_id", "mark").agg(
        F.first("tail").alias("tail"), F.first("next_run").alias("next_run"), F.first("next_id").alias("next_id"))
    met = rows.join(sent, ["id", "no_id", "mark"])
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 4) AS INT))"), F.col("tail"))
    prints = met.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"),
                        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(edited).alias("edited_fingerprint"), "next_run", "next_id")
    own = leaves_of(F.col("fingerprint"))
    return prints.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(own, leaves_of(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(own, leaves_in(F.col("next_run"))).alias("near_next"), "next_id")


# The same in DuckDB's SQL.
_FINGERPRINT = """(SELECT md5(coalesce(array_to_string(list_transform(string_split(w, '|'), lambda s: md5(array_to_string(
    list_transform(string_split(s, ','), lambda p: p[1:32]), ''))), ''), '')) || ' ' || w FROM (SELECT regexp_replace(
    array_to_string(list_transform(list_transform(string_split({0}, chr(10)), lambda l: list_transform(
        regexp_extract_all(l, '(?:[^ ]* ){{1,4}}|[^ ]+'), lambda v: md5(v))),
      lambda h: md5(coalesce(array_to_string(h, ''), '')) || '-' || coalesce(array_to_string(list_transform(h, lambda x: x[1:8]), ''), '')
        || CASE WHEN md5(coalesce(array_to_string(h, ''), '')) < '2' THEN '|' ELSE ',' END), ''), '[|,]$', '') AS w))"""
_LEAVES = """regexp_extract_all(array_to_string(regexp_extract_all({0}, '-([0-9a-f]*)', 1), ''), '[0-9a-f]{{8}}')"""
_LIKENESS = """CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1.0
    ELSE len(list_intersect(list_distinct({0}), list_distinct({1})))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"""

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id),
        first_value(text) OVER (ORDER BY doc_id)) AS next_text,
        coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 4) || substr(next_text, 1, n_chars // 4) AS edited FROM n),
f AS (SELECT *, {_FINGERPRINT.format('text')} AS fingerprint, {_FINGERPRINT.format('edited')} AS edited_fingerprint,
        {_FINGERPRINT.format('next_text')} AS next_fingerprint FROM e),
l AS (SELECT *, {_LEAVES.format('fingerprint')} AS a, {_LEAVES.format('edited_fingerprint')} AS b,
        {_LEAVES.format('next_fingerprint')} AS c FROM f)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       {_LIKENESS.format('a', 'b')} AS near_edited, {_LIKENESS.format('a', 'c')} AS near_next, next_id FROM l
"""
