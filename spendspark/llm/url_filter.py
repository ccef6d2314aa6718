"""URL filters as a sort-merge range join.

Method: a host becomes a key of its labels in reverse order, each closed by a separator, so
all subdomains of a rule's host lie in one interval of keys, the one that starts with the
rule's key. Pages are dealt out by ranges of (key, path); a rule goes to every range that its
interval meets. Each task sorts its rules and pages together and sweeps over them once with a
stack of the rules whose interval is open: intervals nest, so an interval ends where a key no
longer starts with its own. A page tries the rules of the open hosts on its path.

The longest rule (host and path) wins; of equally long ones the longer host, of equal rules
`block`. A page that no rule fits gets the default.

The bounds of the ranges come from about SAMPLE pages chosen by hash; they shape the work
only. A host with a third of all pages spreads over ranges by its paths, equal URLs by a hash of the page id.
Memory of a task is the stack: the rules of the hosts that enclose the current one.

Cases: a null URL or one without `://` has an empty host and path, which no rule fits. Rules
without a host are left out, a null path is empty. Repeated pages are judged alike, each row
on its own; an empty table of rules leaves the default everywhere. Columns of the pages
other than page_id and url are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendspark.llm.frames import with_batches

SAMPLE = 20_000
CLOSE = "\x01"  # after each label of a key
END = "\U0010ffff"  # after every key that continues it

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    after = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract(after, r"^[^/?#]*", 0)
    rest = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWERED), rest


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), CLOSE), F.lit(CLOSE))


class Open:
    """Rules of one host whose interval is open."""

    def __init__(self, key: str):
        self.key = key
        self.rules: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []

    def add(self, host: str, path: str, verdict: str) -> None:
        if self.rules.get(path, ("", ""))[1] != "block":
            self.rules[path] = (host, verdict)
        self.lengths = sorted({len(p) for p in self.rules}, reverse=True)

    def fitting(self, host: str, path: str) -> tuple[str, str, str] | None:
        for n in self.lengths:
            if n <= len(path) and (found := self.rules.get(path[:n])):
                own, verdict = found
                if host == own or host.endswith("." + own):
                    return own, path[:n], verdict
        return None


def sweep(rows: Iterator[dict]) -> Iterator[tuple[dict, str | None, str | None]]:
    """Pages with their rule and its verdict, from rules and pages sorted by range and key,
    rules first."""
    stack: list[Open] = []
    current = None
    for row in rows:
        if row["range"] != current:
            current, stack = row["range"], []
        while stack and not row["key"].startswith(stack[-1].key):
            stack.pop()
        if row["page"]:
            best = max((f for f in (o.fitting(row["host"], row["path"]) for o in stack) if f),
                       key=lambda f: (len(f[0]) + len(f[1]), len(f[0])), default=None)
            yield row, best and best[0] + best[1], best and best[2]
        else:
            if not stack or stack[-1].key != row["key"]:
                stack.append(Open(row["key"]))
            stack[-1].add(row["host"], row["path"], row["verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page. rules: host, path, verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    keyed = split.select("page_id", "host", "path", host_key(F.col("host")).alias("key"),
                         F.coalesce(F.xxhash64("page_id"), F.lit(0)).alias("tie"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = min(1.0, SAMPLE / max(1, keyed.count()))
    drawn = keyed.filter(F.pmod(F.xxhash64("key", "path", "tie"), F.lit(1 << 30)) < int(share * (1 << 30))).select(
        "key", "path", "tie").limit(4 * SAMPLE).collect()
    sample = sorted((r["key"], r["path"], r["tie"]) for r in drawn)
    bounds = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if len(sample) > ranges else []

    def place_pages(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        keys = zip(*(batch.column(c).to_pylist() for c in ("key", "path", "tie")), strict=True)
        return {"range": pa.array([bisect_right(bounds, k) for k in keys], pa.int32())}

    def place_rules(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        met = [list(range(bisect_right(bounds, (k, "", -1 << 63)), bisect_right(bounds, (k + END, "", 0)) + 1))
               for k in batch.column("key").to_pylist()]
        return {"ranges": pa.array(met, pa.list_(pa.int32()))}

    wanted = rules.filter(F.col("host").isNotNull() & (F.col("host") != "")).select(
        F.translate("host", UPPER, LOWERED).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    id_type = pages.schema["page_id"].dataType
    rule_rows = with_batches(wanted.withColumn("key", host_key(F.col("host"))), place_rules,
                             [T.StructField("ranges", T.ArrayType(T.IntegerType()))]).select(
        F.lit(False).alias("page"), F.lit(None).cast(id_type).alias("page_id"), "host", "path", "key",
        F.lit(0).cast("long").alias("tie"), "verdict", F.explode("ranges").alias("range"))
    page_rows = with_batches(keyed, place_pages, [T.StructField("range", T.IntegerType())]).select(
        F.lit(True).alias("page"), "page_id", "host", "path", "key", "tie", F.lit("").alias("verdict"), "range")
    dealt = page_rows.union(rule_rows).repartition(ranges, "range").sortWithinPartitions("range", "key", "page", "path", "tie")
    schema = T.StructType([T.StructField("page_id", id_type), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sweep(row for batch in batches for row in batch.to_pylist())
        part: list[dict] = []
        for row, rule, verdict in found:
            part.append({"page_id": row["page_id"], "host": row["host"], "path": row["path"], "rule": rule,
                         "verdict": verdict or default})
            if len(part) == 1000:
                yield pa.RecordBatch.from_pylist(part, arrow)
                part = []
        if part:
            yield pa.RecordBatch.from_pylist(part, arrow)

    return dealt.mapInArrow(run, schema)
