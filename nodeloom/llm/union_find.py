"""Union-find over a table of links, without a component or link on the driver.

Each task first unions its own links (in bounded chunks) and keeps a spanning forest; the
forests are then contracted across tasks by large-star and small-star rounds until every
node hangs from the smallest id of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

CHUNK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def flush() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
        if len(parent) > CHUNK:
            yield flush()
    yield flush()


def _settled(edges: DataFrame) -> bool:
    """Each child has one parent, and no parent is a child."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("child")).unionAll(edges.select("b", F.lit(0)))
    seen = ends.groupBy("x").agg(F.sum("child").alias("up"), F.min("child").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node that ``links`` (a, b: long) names; component is the smallest id.

    Self-links and repeats do no harm; rows with a null end are left out; without links the
    result is empty.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = cut(links.mapInArrow(_forest, "a long, b long").distinct())  # a > b: child, parent
    while not _settled(edges):
        # Large star: each node's larger neighbours move to its smallest neighbour.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: each node's smaller neighbours, and itself, move to the smallest.
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        drop_cut(edges)
        edges = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", F.col("b")).distinct())
