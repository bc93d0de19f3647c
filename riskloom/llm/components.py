"""Connected components of links by distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


#: Links that one task holds at a time; their number sets the number of tasks.
HELD = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task, HELD at a time: each node with the smallest of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    def trees() -> Iterator[pa.RecordBatch]:
        rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= HELD:
            yield from trees()
    yield from trees()


def _forests(links: DataFrame, n: int) -> DataFrame:
    parts = -(-n // HELD) or 1
    return written(links.select("a", "b").coalesce(parts).mapInArrow(_forest, "a long, b long").distinct().coalesce(parts), "links")


def _is_done(edges: DataFrame) -> bool:
    """Whether the links are a star for each component: one for each node, to a node without any."""
    n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
    if n != nodes:
        return False
    return not edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in `links` (a, b); component is the smallest node reachable.

    Trees of single tasks first; then rounds in which every node points its
    neighbours at its smallest neighbour (with partial aggregation, so a node
    with very many links costs one row per task), until each component is a star.
    Each round is written to the shared folder.
    """
    edges = _forests(links, links.count())
    while not _is_done(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # each node and its larger neighbours point at the smallest one known to the node
        up = edges.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small"))
        hook = up.join(low.withColumnRenamed("a", "small"), "small").select(F.col("big").alias("a"), F.col("low").alias("b"))
        hook = hook.union(low.select("a", F.col("low").alias("b"))).where("a <> b")
        edges = _forests(hook, edges.count())
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
