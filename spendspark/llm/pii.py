"""Personal data by fixed shapes and by bootstrapped contextual extraction, in column expressions.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers by their
patterns, leftmost and non-overlapping per kind; a match that fails its check is dropped.

Method: the base matches are the seeds. An instance is a token that holds a digit or an `@`,
trimmed of punctuation; the patterns of an occurrence are the word before and the word after
it. Spark scores the graph of patterns and instances: a pattern scores the mean score of its
instances, with SMOOTHING added to their number; an instance that is no seed scores one minus
the product of what its patterns leave open. After ROUNDS rounds the instances that reach
ACCEPT over patterns that have at least SUPPORT instances are discovered identifiers: they
become spans of kind `other` wherever they occur outside base spans.

A word that stands next to a third of all instances is reduced by partial sums before the
shuffle; its score, one row, is joined back by a join that Spark splits.

Offsets are code points. They come from splitting a text by the same pattern that finds the
matches. The patterns never give back what they took and start only where a match can start,
so their time is linear in the text.

Cases: a null text is empty. Rows that repeat doc_id and text are one row for the graph and get
equal spans; spans of one kind stand in order of their start. The result has one row per row;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark.session import cut

# The shapes of the base kinds, in the order in which spans are listed.
SHAPES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for the kind to be looked for at all.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
CARD_HINT = r"[0-9](?:[\x20-]?+[0-9]){15}"

TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
BEFORE_TRIM = r"^[^\p{L}\p{N}]+"
AFTER_TRIM = r"[^\p{L}\p{N}]+$"
LAST_WORD = r"(?<!\p{L})(\p{L}++)[^\p{L}]*+$"
FIRST_WORD = r"^[^\p{L}]*+(\p{L}++)"

ROUNDS = 3
SMOOTHING = 1.0
SUPPORT = 3
ACCEPT = 0.9

SPAN = "struct<kind:string,start:int,end:int>"


def bind(value: Column, fn) -> Column:
    """fn of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def found_by(text: Column, shape: str) -> Column:
    """Matches of a pattern in order: start, end, body, and the texts before and after it."""
    gaps = F.transform(F.split(text, shape, -1), lambda g: F.struct(g.alias("gap"), F.length(g).alias("n")))
    bodies = F.regexp_extract_all(text, F.lit(shape), F.lit(0))

    def placed(both: Column) -> Column:
        starts = F.aggregate(
            F.arrays_zip(F.slice(both["gaps"], 1, F.size(both["bodies"])).alias("gap"), both["bodies"].alias("body")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda acc, m: F.struct((acc["at"] + m["gap"]["n"] + F.length(m["body"])).alias("at"),
                                    F.concat(acc["starts"], F.array(acc["at"] + m["gap"]["n"])).alias("starts")),
            lambda acc: acc["starts"])
        return bind(starts, lambda s: F.transform(both["bodies"], lambda body, i: F.struct(
            F.element_at(s, i + 1).alias("start"), (F.element_at(s, i + 1) + F.length(body)).alias("end"), body.alias("body"),
            F.element_at(both["gaps"], i + 1)["gap"].alias("before"), F.element_at(both["gaps"], i + 2)["gap"].alias("after"))))

    return bind(F.struct(gaps.alias("gaps"), bodies.alias("bodies")), placed)


def luhn(digits: Column) -> Column:
    """Whether the digits pass the checksum: from the right, every second one doubled."""
    values = F.transform(F.split(F.reverse(digits), "(?!$)"), lambda d, i: bind(
        d.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def small(part: Column) -> Column:
    digits = F.regexp_replace(part, "^0+", "")
    return (F.length(digits) <= 3) & (F.coalesce(F.when(F.length(digits) <= 3, digits.cast("int")), F.lit(0)) <= 255)


def passes(kind: str, body: Column) -> Column:
    digits = F.regexp_replace(body, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(body, r"\."), small)
    if kind == "card":
        return bind(digits, lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def spans_of_kind(text: Column, kind: str) -> Column:
    good = F.filter(found_by(text, SHAPES[kind]), lambda m: passes(kind, m["body"]))
    spans = F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    hint = text.rlike(CARD_HINT) if kind == "card" else F.contains(text, F.lit(HINTS[kind]))
    return F.when(hint, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    return F.concat(*[spans_of_kind(text, kind) for kind in SHAPES])


def word(gap: Column, last: bool) -> Column:
    """The neighbouring word in a gap, however far it is, lower-cased, without punctuation."""
    found = F.lower(F.regexp_extract(gap, LAST_WORD if last else FIRST_WORD, 1))
    return F.when(found != "", found)


def candidates(text: Column, base: Column) -> Column:
    """Tokens that may be identifiers: start, end, instance, word before, word after, and
    whether a base span meets them."""
    def token(m: Column) -> Column:
        cut_off = F.length(m["body"]) - F.length(F.regexp_replace(m["body"], BEFORE_TRIM, ""))
        instance = F.regexp_replace(F.regexp_replace(m["body"], BEFORE_TRIM, ""), AFTER_TRIM, "")
        return F.struct((m["start"] + cut_off).alias("start"), (m["start"] + cut_off + F.length(instance)).alias("end"),
                        instance.alias("instance"), word(m["before"], True).alias("left"), word(m["after"], False).alias("right"))

    tokens = F.filter(F.transform(found_by(text, TOKEN), token), lambda t: F.length(t["instance"]) > 0)
    seeded = F.transform(tokens, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["instance"].alias("instance"), t["left"].alias("left"), t["right"].alias("right"),
        F.exists(base, lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"])).alias("seed")))
    return F.when(text.rlike("[0-9@]"), seeded)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, mark (hash of the text), base spans, candidates. Written once, without
    the text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    based = rows.withColumn("base", base_spans(F.col("text")))
    return cut(based.select("doc_id", F.xxhash64("text").alias("mark"), "base", candidates(F.col("text"), F.col("base")).alias("candidates")))


def occurrences(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "mark", F.explode("candidates").alias("c")).select("doc_id", "mark", "c.*")


def discovered(found: DataFrame) -> DataFrame:
    """Instances beside the seeds that the patterns vouch for."""
    sides = F.array(F.concat(F.lit("before "), "left"), F.concat(F.lit("after "), "right"))
    edges = cut(found.select("instance", "seed", F.explode(sides).alias("pattern")).filter("pattern IS NOT NULL").groupBy(
        "pattern", "instance").agg(F.max("seed").alias("seed")))
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    scores = seeds.select("instance", "seed", F.col("seed").cast("double").alias("score"))
    for _ in range(ROUNDS):
        patterns = edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern").agg(
            F.sum("score").alias("sum"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= SUPPORT) & (F.col("sum") > 0))
        open_part = F.sum(F.log1p(-F.col("sum") / (F.col("n") + SMOOTHING)))
        instances = edges.select("pattern", "instance").join(patterns, "pattern").groupBy("instance").agg((1 - F.exp(open_part)).alias("reached"))
        scores = cut(seeds.join(instances, "instance", "left").select(
            "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("reached", F.lit(0.0))).alias("score")))
    return scores.filter(~F.col("seed") & (F.col("score") >= ACCEPT)).select("instance")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    scanned = scan(docs)
    found = occurrences(scanned)
    other = found.filter("not seed").join(discovered(found), "instance").groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(F.struct(F.lit("other").alias("kind"), "start", "end"))).alias("others"))
    keyed = other.select(F.col("doc_id").alias("key_id"), F.col("mark").alias("key_mark"), "others")
    met = scanned.drop("candidates").join(keyed, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("mark") == F.col("key_mark")), "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    everything = F.concat("base", F.coalesce("others", F.array().cast(f"array<{SPAN}>")))
    return met.select("doc_id", *[count(k) for k in SHAPES], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                      listed(everything).alias("spans"))


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs whose base spans are replaced by their kind in angle brackets."""
    whole = F.col(text)

    def blanked(spans: Column) -> Column:
        # a span that overlaps an earlier one is covered by it up to its own end
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        joined = F.aggregate(
            ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                         F.lit("<"), s["kind"], F.lit(">")).alias("out"))))
        return bind(joined, lambda j: F.concat(j["out"], F.substring(whole, j["at"] + 1, F.length(whole))))

    changed = bind(base_spans(whole), lambda spans: F.when(F.size(spans) > 0, blanked(spans)).otherwise(whole))
    return docs.select(*[F.when(whole.isNotNull(), changed).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
