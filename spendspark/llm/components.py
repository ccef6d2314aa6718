"""Connected components of a graph given by its links, by alternating stars.

Tasks first replace every CHUNK of links by stars that connect the same nodes; links that make one
chunk are done with that. Then each round points every node's larger neighbours, then the node itself and its smaller
neighbours, at the smallest node among them. Rounds are written to the shared folder, so a
lost executor re-reads the last one. A node with very many neighbours is reduced by a partial
minimum before the shuffle and joined back by a join that Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendspark.session import cut

CHUNK = 1 << 16  # links that a task holds, 1 MB


def stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links between the smallest node of each component and its other nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    others = root != np.arange(len(nodes))
    return nodes[root[others]], nodes[others]


def _contracted(links: DataFrame, n: int) -> DataFrame:
    """n links as stars, each of a chunk; as many tasks as there are chunks, if Spark has cut them into more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars() -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(name).to_numpy() for x in held]) for name in ("a", "b"))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars_of(a, b)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) > CHUNK:
                yield stars()
                held = []
        if held:
            yield stars()

    return links.coalesce(max(1, -(-n // CHUNK))).mapInArrow(run, "a long, b long")


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("least").alias("a"), "b").filter("a < b").distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    moved = links.join(least, "b").filter("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("least").alias("a"), "b")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """node and root (the smallest node of its component) for every node that has a link and
    is not a root itself. links: a, b; links to itself, repeats and either direction are
    fine. With rounds, stops early: nodes with the same root are connected, but a component
    may still be in parts."""
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    n = links.count()
    now = cut(_contracted(links, n))
    if n <= CHUNK:
        return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    state = _state(now)
    done = 0
    while state[0] and (rounds is None or done < rounds):
        now = cut(_small(_large(now)))
        before, state = state, _state(now)
        if before == state:
            break
        done += 1
    roots = now.groupBy("b").agg(F.min("a").alias("root"))
    return roots.withColumnRenamed("b", "node")
