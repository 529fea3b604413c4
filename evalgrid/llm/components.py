"""Connected components: few edges in one task, more by alternating stars in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Up to so many edges (16 bytes each) are settled in one task; rounds of joins cost more than these take.
ONE_TASK = 1 << 20


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of the partition: roots hang on lesser ones until no edge joins two."""
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if not parts:
        return
    ends = np.stack([np.concatenate(x) for x in zip(*parts, strict=True)])
    names, which = np.unique(ends, return_inverse=True)
    a, b = which.reshape(2, -1)
    root = np.arange(names.size)
    while a.size:
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((above := root[root]) != root).any():
            root = above
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    for i in range(0, names.size, 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(names[i : i + (1 << 16)]), pa.array(names[root[i : i + (1 << 16)]])], ["node", "root"])


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Up to ONE_TASK edges go to one task, whose work that bounds. With more, each round is a large star (every neighbour above a node is hung on the smallest neighbour)
    and a small star (the same for neighbours below). Rounds stop when the edges no longer
    change; then they are stars around the roots. Minima are combined before the shuffle and
    written, a row a node: the joins back broadcast them when small, and otherwise have a plain
    exchange on both sides, in which Spark splits a node with very many links.
    Loops, nulls and repeated edges are ignored.
    """
    a, b = F.col("a"), F.col("b")
    edges = edges if hasattr(edges, "_evalgrid_scratch") else scratch.write(edges.select("a", "b"))
    kept = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    if kept.count() <= ONE_TASK:
        return scratch.write(kept.coalesce(1).mapInArrow(_settled, "node long, root long"))
    kept, before = scratch.write(kept.distinct()), None
    for _ in range(max_rounds):
        state = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return kept.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                kept.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
        both = kept.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(kept.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.write(both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        below = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(below, "a")
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).distinct()
        following = scratch.write(small)
        scratch.drop(kept, least, large, below)
        kept = following
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
