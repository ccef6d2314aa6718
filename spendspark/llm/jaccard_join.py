"""Jaccard similarity join on word n-grams by vertical partitioning, and its components.

Two texts link when 100 * |common shingles| >= PERCENT * |all shingles of both|.

Method: all shingles stand in one global order: by hash, except that the HEAVY most frequent
ones come last, ordered by frequency. Cuts in that order are the fragments; every set falls
into one segment per fragment. The overlap of a pair is counted fragment by fragment, and
the partial counts are summed per pair. Of many pairs (more than an eighth of the texts) the first fragment goes
first: only pairs that can still link send the others.

Which pairs are counted: similar sets share a shingle among their first n - ceil(t n) + 1 in
the order (their prefix), and the place of the first such shingle bounds their overlap. Each
distinct set sends its prefix only, equal sets being one node from the start.

Not all pairs of a group of sets with a common prefix shingle are counted, as copies of copies
would make the square of their number. Stars come first: every member against the group's
first and last. Components of the links found so far then show which pairs are decided; only
pairs of different components go on, by further stars of CENTRES members a group while more than PAIRS_PER_ENTRY pairs
per entry are left and a round decides a tenth of them (STAR_ROUNDS at most), and then every one of them that passes the length
and place bounds. Of these, pairs whose sketches rule a link out make no row: a sketch holds the parity of
the number of shingles at each of SKETCH bits, so two sets differ by at least as many shingles as their
sketches by bits. So no link between components is lost. Groups of heavy shingles are split
into parts of about PART members.

Bounds: the heavy list has at most HEAVY entries; the map of sets that occur in pairs, which saves
sending the others, has MARKS bits at any size (when it is full, more sets are sent than
needed, none less). Shingles and sets are named by 64-bit hashes: of 30 billion texts about
a dozen pairs of different sets are expected to get one name.

Cases: a text with fewer words than n has its whole sequence as one shingle. Null and empty
texts have no shingles and link with nothing. Ties of frequency go by hash. Repeated rows are
rows of one component; a component's id is its smallest doc_id, null only where all are null.
The columns other than id and text are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from spendspark.llm.components import components
from spendspark.llm.words import batch_words, byte_table, mix, shingle_sets
from spendspark.session import cut, cuts_so_far, remove_cuts

WORDS = 5
PERCENT = 75
HEAVY = 1 << 20  # 16 MB
STEPS = 16
PART = 10_000
FRAGMENT_BITS = 2  # of the hash; the heavy shingles are one more fragment, the last
MARKS = 1 << 26
SKETCH = 1 << 10  # bits: tells sets of up to about 3000 shingles apart
FEW = 1 << 18  # pairs whose names the driver takes as they are, 4 MB
COUNTED = 2_000_000  # shingles that a task holds while it counts
PAIRS_PER_ENTRY = 100  # a pair costs a comparison of two entries, rows only if their sketches leave a link open
STAR_ROUNDS = 8
CENTRES = 4  # of a group, in a star round
STAR_GAIN = 0.1  # share of the pairs left that a star round must decide for another one to follow

INSIDE = byte_table("not_space")
NODE = T.StructField("node", T.LongType())


def node_of(shingles: np.ndarray) -> int:
    """Name of a set: does not depend on the order."""
    total = mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.uint64(len(shingles))).view(np.int64)[0])


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles at each bit, as 64-bit words."""
    counts = np.bincount((shingles & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def sets_in(batch: pa.RecordBatch, text: str, n: int) -> list[np.ndarray]:
    words, _, _, edges, _ = batch_words(batch.column(text), INSIDE)
    return shingle_sets(words, edges, n)


def tasks(df: DataFrame, fields: list[T.StructField], fn) -> DataFrame:
    """fn yields columns of equal length as dicts; runs once per partition."""
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in fn(b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


class Heavy:
    """The most frequent shingles and their counts, in the order of their hashes."""

    def __init__(self, sent: tuple[np.ndarray, np.ndarray]):
        hashes, self.counts = sent
        self.hashes = hashes.view(np.uint64)

    def count(self, shingles: np.ndarray) -> np.ndarray:
        """Count of each heavy shingle, 0 for the others."""
        if not len(self.hashes):
            return np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        return np.where(self.hashes[at] == shingles, self.counts[at], 0)


def sets_and_counts(docs: DataFrame, doc_id: str, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """A row per document (doc_id, size of its set, node, sketch); and counts of the shingles that
    occur in several sets of a task, which is where frequent ones show."""
    fields = [T.StructField("is_doc", T.BooleanType()), T.StructField("doc_id", docs.schema[doc_id].dataType),
              T.StructField("size", T.LongType()), NODE, T.StructField("sketch", T.ArrayType(T.LongType(), False))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        n_held = 0

        def counted() -> dict:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            k = int(often.sum())
            return {"is_doc": np.zeros(k, bool), "doc_id": pa.nulls(k, arrow_id), "size": counts[often],
                    "node": values[often].view(np.int64), "sketch": pa.nulls(k, pa.list_(pa.int64()))}

        for batch in batches:
            sets = sets_in(batch, text, n)
            nodes = [node_of(s) if len(s) else None for s in sets]
            yield {"is_doc": np.ones(len(sets), bool), "doc_id": batch.column(doc_id), "size": [len(s) for s in sets],
                   "node": nodes, "sketch": [sketch_of(s) if len(s) else None for s in sets]}
            for node, found in zip(nodes, sets, strict=True):
                if node is not None and node not in seen:
                    seen.add(node)
                    held.append(found)
                    n_held += len(found)
            if n_held > COUNTED:
                yield counted()
                held, seen, n_held = [], set(), 0
        if held:
            yield counted()

    arrow_id = to_arrow_schema(T.StructType(fields)).field("doc_id").type
    both = cut(tasks(docs.select(doc_id, text), fields, run))
    counts = both.filter("not is_doc").groupBy("node").agg(F.sum("size").alias("size"))
    return both.filter("is_doc").drop("is_doc"), counts


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` of the shingles with the highest counts, by hash. The cut is made between classes
    of about equal counts, of which there are STEPS per doubling, so that no task sends the
    driver more than what is kept."""
    step = F.floor(F.log2("size") * STEPS)
    left, cut_at = most, None
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if row["n"] > left:
            break
        left, cut_at = left - row["n"], row["step"]
    if cut_at is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = counts.filter(step >= cut_at).select("node", "size").toArrow()
    hashes, sizes = (found.column(c).to_numpy() for c in ("node", "size"))
    order = np.argsort(hashes.view(np.uint64))
    return hashes[order], sizes[order]


def prefixes(docs: DataFrame, text: str, n: int, percent: int, heavy) -> DataFrame:
    """An entry for every prefix shingle of every distinct set of a task: shingle, part (0 if
    its group isn't split), node, size of the set, place in the order."""
    fields = [T.StructField("shingle", T.LongType()), T.StructField("part", T.IntegerType()), NODE,
              T.StructField("size", T.IntegerType()), T.StructField("place", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        often = Heavy(heavy.value)
        seen: set[int] = set()
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in fields}
            for found in sets_in(batch, text, n):
                size = len(found)
                if not size or (node := node_of(found)) in seen:
                    continue
                seen.add(node)
                counts = often.count(found)
                prefix = size - -(-percent * size // 100) + 1
                light = found[counts == 0][:prefix]
                if len(light) < prefix:
                    last = np.lexsort((found, counts))[size - int((counts > 0).sum()):]
                    chosen = np.concatenate([light, found[last[:prefix - len(light)]]])
                else:
                    chosen = light
                parts = -(-often.count(chosen) // PART)
                out["shingle"].append(chosen.view(np.int64))
                out["part"].append(np.where(parts > 1, 1 + node % np.maximum(parts, 1), 0))
                out["node"].append(np.full(len(chosen), node))
                out["size"].append(np.full(len(chosen), size))
                out["place"].append(np.arange(len(chosen)))
            if len(seen) > COUNTED:
                seen = set()
            if out["node"]:
                yield {k: np.concatenate(v) for k, v in out.items()}

    return tasks(docs.select(text), fields, run)


def may_link(percent: int, a: str, b: str) -> Column:
    """Bounds on two sets that share the shingle of entries a and b, met by every similar pair
    at its first common shingle. The overlap o of similar sets has
    (100 + percent) * o >= percent * (both sizes)."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    rest = F.least(size_a - F.col(f"{a}.place"), size_b - F.col(f"{b}.place"))
    return (100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)) & (
        (100 + percent) * rest >= percent * (size_a + size_b))


def ordered_pairs(found: DataFrame, a: str, b: str) -> DataFrame:
    first = F.col(f"{a}.node") < F.col(f"{b}.node")
    pick = lambda field, yes, no: F.when(first, F.col(f"{yes}.{field}")).otherwise(F.col(f"{no}.{field}"))
    return found.select(pick("node", a, b).alias("a"), pick("size", a, b).alias("size_a"),
                        pick("node", b, a).alias("b"), pick("size", b, a).alias("size_b"))


def entry(*more: str) -> Column:
    return F.struct("node", "size", "place", *more)


def grouped(entries: DataFrame) -> DataFrame:
    """Entries of groups with several sets, with the group's first and last entry."""
    group = Window.partitionBy("shingle", "part")
    marked = entries.withColumns({"first": F.min(entry()).over(group), "last": F.max(entry()).over(group)})
    several = marked.filter((F.col("first.node") < F.col("last.node")) | (F.col("part") > 0))
    # several tasks may have met the same set
    return several.dropDuplicates(["shingle", "part", "node"])


def first_stars(groups: DataFrame, percent: int) -> DataFrame:
    own = groups.select(entry().alias("own"), F.explode(F.array("first", "last")).alias("end"))
    stars = ordered_pairs(own.filter((F.col("own.node") != F.col("end.node")) & may_link(percent, "own", "end")), "own", "end")
    split = groups.filter("part > 0")
    if split.count():
        # the parts of a split group: their first entries against the first of all
        parts = split.groupBy("shingle", "part").agg(F.min("first").alias("own"))
        first = parts.groupBy("shingle").agg(F.min("own").alias("first"))
        stars = stars.union(ordered_pairs(parts.join(first, "shingle").filter(
            (F.col("own.node") != F.col("first.node")) & may_link(percent, "own", "first")), "own", "first"))
    return stars.distinct()


def marks_of(pairs: DataFrame, n_pairs: int) -> bytes:
    """One bit per set that occurs in a pair, by the low bits of its name: MARKS bits in all."""
    bit = F.col("node").bitwiseAND(F.lit(MARKS - 1))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    if n_pairs <= FEW:
        bits = np.zeros(MARKS, bool)
        bits[nodes.select(bit.alias("bit")).toArrow().column("bit").to_numpy()] = True
        return np.packbits(bits, bitorder="little").tobytes()
    rows = nodes.groupBy(
        F.shiftright(bit, 15).cast("int").alias("block")).agg(
        F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros((MARKS >> 15, 4096), np.uint8)
    for row in rows:
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def is_marked(nodes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    bits = nodes & (MARKS - 1)
    return (marks[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)


def segments(docs: DataFrame, text: str, n: int, heavy, marks) -> DataFrame:
    """Segments of the marked sets: node, fragment, shingles. Every set has one in the first fragment, if an empty one."""
    fields = [NODE, T.StructField("fragment", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.LongType(), False))]
    last = 1 << FRAGMENT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        often = Heavy(heavy.value)
        wanted = np.frombuffer(marks.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in fields}
            for found in sets_in(batch, text, n):
                if not len(found):
                    continue
                node = node_of(found)
                if node in seen or not is_marked(np.array([node]), wanted)[0]:
                    continue
                seen.add(node)
                fragment = np.where(often.count(found) > 0, last, (found >> np.uint64(64 - FRAGMENT_BITS)).astype(np.int64))
                for k in sorted({0, *np.unique(fragment).tolist()}):
                    out["node"].append(node)
                    out["fragment"].append(k)
                    out["shingles"].append(found[fragment == k].view(np.int64))
            if len(seen) > COUNTED:
                seen = set()
            if out["node"]:
                yield out

    return tasks(docs.select(text), fields, run)


def only_marked(parts: DataFrame, marks) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(is_marked(batch.column("node").to_numpy(), wanted)))

    return parts.mapInArrow(run, parts.schema)


def meeting(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs with their partial overlaps, one per fragment, and the sizes of the segments counted. A pair
    meets its segments in one row; several tasks may have sent the same set."""
    # by node alone, which is how the joins need it
    own = parts.repartition("node").dropDuplicates(["node", "fragment"]).groupBy("node").agg(
        F.collect_list(F.struct("fragment", "shingles")).alias("own"))
    met = pairs.join(own.withColumnRenamed("node", "a"), "a").join(
        own.select(F.col("node").alias("b"), F.col("own").alias("others")), "b")
    partial = F.flatten(F.transform("own", lambda x: F.transform(
        F.filter("others", lambda y: y["fragment"] == x["fragment"]), lambda y: F.size(F.array_intersect(x["shingles"], y["shingles"])))))
    length = lambda name: F.aggregate(name, F.lit(0), lambda n, x: n + F.size(x["shingles"]))
    return met.withColumns({"partial": partial, "counted_a": length("own"), "counted_b": length("others")})


def linked(pairs: DataFrame, docs: DataFrame, text: str, n: int, percent: int, heavy, at_once: int) -> DataFrame:
    """The pairs that link, by the overlap summed over the fragments. Of more than at_once pairs, the first fragment is counted
    alone: a pair that would miss the bound if all its other shingles were common goes no further."""
    def enough(overlap: Column) -> Column:
        return (100 + percent) * overlap >= percent * (F.col("size_a") + F.col("size_b"))

    spark = docs.sparkSession
    number = cuts_so_far(spark)
    n_pairs = pairs.count()
    sets_of_pairs = spark.sparkContext.broadcast(marks_of(pairs, n_pairs))
    parts = cut(segments(docs, text, n, heavy, sets_of_pairs))
    overlap = F.aggregate("partial", F.lit(0), lambda total, x: total + x)
    if n_pairs <= at_once:
        found = settle(meeting(pairs, parts).withColumn("overlap", overlap).filter(enough(F.col("overlap"))).select("a", "b"))
        remove_cuts(spark, number, number + 1)
        sets_of_pairs.destroy()
        return found
    rest = F.least(F.col("size_a") - F.col("counted_a"), F.col("size_b") - F.col("counted_b"))
    fields = ["a", "b", "size_a", "size_b", "overlap"]
    first = meeting(pairs, parts.filter("fragment = 0")).withColumn("overlap", overlap)
    alive = settle(first.filter(enough(F.col("overlap") + rest)).select(*fields))
    sets_alive = spark.sparkContext.broadcast(marks_of(alive, n_pairs))
    others = meeting(alive.drop("overlap"), only_marked(parts.filter("fragment > 0"), sets_alive)).withColumn("overlap", overlap)
    total = alive.union(others.select(*fields)).groupBy("a", "b", "size_a", "size_b").agg(F.sum("overlap").alias("overlap"))
    found = settle(total.filter(enough(F.col("overlap"))).select("a", "b"))
    # neither the segments nor the marks are read again
    remove_cuts(spark, number, number + 1)
    sets_of_pairs.destroy()
    sets_alive.destroy()
    return found


def undecided(groups: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """Entries of shingles whose sets are in several components, with their component, the number of their group's
    entries and the sketch of their set."""
    labelled = groups.select("shingle", "node", "size", "place").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = labelled.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"))
    return labelled.join(split.filter("low < high").select("shingle", "members"), "shingle").join(sketches, "node")


def left_over(entries: DataFrame) -> tuple[int, int]:
    """Entries, and pairs of entries of different components in one group."""
    per_root = entries.groupBy("shingle", "root").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("members").alias("members"))
    row = per_root.agg(F.sum("n"), F.sum(F.col("n") * (F.col("members") - F.col("n")) / 2)).first()
    return int(row[0] or 0), int(row[1] or 0)


def sketches_allow(percent: int, sketch_a: str, sketch_b: str, size_a: str, size_b: str) -> Column:
    """Whether two sets may link by their sketches: the sets differ by at least as many shingles as the sketches by bits."""
    bits = F.zip_with(sketch_a, sketch_b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    apart = F.aggregate(bits, F.lit(0).cast("long"), lambda total, x: total + x)
    both = F.col(size_a).cast("long") + F.col(size_b)
    return (100 + percent) * (both - apart) >= 2 * percent * both


def could_link(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by their sketches."""
    own, other = (sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in ("a", "b"))
    return pairs.join(own, "a").join(other, "b").filter(
        sketches_allow(percent, "sketch_a", "sketch_b", "size_a", "size_b")).select(*pairs.columns)


def entries_allow(percent: int, a: str, b: str) -> Column:
    """What the bounds and the sketches of entries a and b say."""
    return may_link(percent, a, b) & sketches_allow(percent, f"{a}.sketch", f"{b}.sketch", f"{a}.size", f"{b}.size")


def cross_pairs(entries: DataFrame, percent: int) -> DataFrame:
    sides = [entries.select("shingle", F.col("root").alias(f"root_{s}"), entry("sketch").alias(s)) for s in ("x", "y")]
    met = sides[0].join(sides[1], "shingle").filter(
        (F.col("x.node") < F.col("y.node")) & (F.col("root_x") != F.col("root_y")) & entries_allow(percent, "x", "y"))
    return ordered_pairs(met, "x", "y").distinct()


def star_pairs(entries: DataFrame, percent: int, turn: int) -> DataFrame:
    """Every entry against CENTRES of its group, others in each turn. Each group draws for itself: sets that
    meet in many groups meet many centres, so a large group of loosely similar sets soon hangs together."""
    own = entries.select("shingle", "root", entry("sketch").alias("own"))
    drawn = [F.min(F.struct(F.xxhash64("own.node", "shingle", F.lit(turn * CENTRES + k)).alias("draw"), "own", "root")) for k in range(CENTRES)]
    picked = F.array_distinct(F.transform(F.array(*drawn), lambda c: F.struct(c["own"].alias("own"), c["root"].alias("root"))))
    centre = own.groupBy("shingle").agg(picked.alias("picked")).select("shingle", F.explode("picked").alias("c")).select(
        "shingle", F.col("c.own").alias("centre"), F.col("c.root").alias("centre_root"))
    met = own.join(centre, "shingle").filter((F.col("root") != F.col("centre_root")) & entries_allow(percent, "own", "centre"))
    return ordered_pairs(met, "own", "centre").distinct()


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows as cut does. Then the driver collects its garbage, upon which Spark
    deletes the shuffle files of the steps that are done; else they lie on the executors'
    disks until the driver's heap happens to fill."""
    written = cut(df)
    del df
    gc.collect()
    written.sparkSession.sparkContext._jvm.System.gc()
    return written


def similarity_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS,
                       percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, node (equal sets have equal nodes) and component_id of every row."""
    context = docs.sparkSession.sparkContext
    sets, counts = sets_and_counts(docs, doc_id, text, n)
    heavy = context.broadcast(most_frequent(counts, HEAVY))
    groups = settle(grouped(prefixes(docs, text, n, percent, heavy)))

    sketches = sets.filter("node IS NOT NULL").select("node", "sketch").dropDuplicates(["node"])
    pairs = settle(could_link(first_stars(groups, percent), sketches, percent))
    tried = pairs
    # so many pairs send about as much as an eighth of the sets
    at_once = sets.count() // 8
    links = linked(pairs, docs, text, n, percent, heavy, at_once)
    before = None
    for turn in range(STAR_ROUNDS + 1):
        # a star per component says as much as all links so far
        roots = components(links)
        links = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
        open_entries = settle(undecided(groups, roots, sketches))
        n_entries, n_pairs = left_over(open_entries)
        if not n_pairs:
            break
        slow = before is not None and n_pairs > (1 - STAR_GAIN) * before
        last = n_pairs <= PAIRS_PER_ENTRY * n_entries or slow or turn == STAR_ROUNDS
        before = n_pairs
        pairs = cross_pairs(open_entries, percent) if last else star_pairs(open_entries, percent, turn)
        pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti").select("a", "size_a", "b", "size_b")
        pairs = settle(pairs)
        links = links.union(linked(pairs, docs, text, n, percent, heavy, at_once))
        tried = tried.union(pairs)
        if last:
            break

    roots = components(links)
    smallest = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = smallest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = rooted.join(of_root, "root").select("node", "component_id")
    return sets.join(of_node, "node", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), "node",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    return similarity_classes(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of its smallest doc_id. Documents
    without shingles stay, and so do rows without an id. Rows that repeat the kept id with
    the same text all stay."""
    found = similarity_classes(docs)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept id")).distinct()
    without_id = docs.filter(F.col("doc_id").isNull())
    return docs.join(kept, F.col("doc_id") == F.col("`kept id`"), "left_semi").union(without_id)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the first by (id with nulls last, hash of the
    text), and of rows that repeat both the one with the least other columns, which must be
    of types that have an order. Rows without shingles stay, as they are in no component."""
    mark = F.xxhash64(text)
    at = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), mark.alias("mark"))
    found = similarity_classes(docs.select(at.alias("at"), F.col(text).alias("text")), "at", "text")
    first = found.filter(F.col("node").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = cut(first.groupBy("doc_id").agg(F.count("node").alias("n")).select(
        F.col("doc_id.id").alias("kept id"), F.col("doc_id.mark").alias("kept mark"), F.col("n").alias("kept rows")))
    repeated = cut(kept.filter("`kept rows` > 1"))
    same = F.col(doc_id).eqNullSafe(F.col("`kept id`")) & (mark == F.col("`kept mark`"))
    once = docs.join(kept.filter("`kept rows` < 2"), same, "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    least = docs.join(repeated, same, "left_semi").groupBy(F.col(doc_id).alias("kept id"), mark.alias("kept mark")).agg(
        F.min(F.struct(*columns)).alias("least row")).select("`least row`.*")
    return once.union(least)


# The query in DuckDB's SQL: all pairs that share a shingle, then everything reachable.
SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                     WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id
"""
