"""Connected components of a distributed edge list.

Edges are first contracted by union-find inside bounded blocks; what is left is solved by
alternating large-star and small-star rounds, each written to the shared folder. No edge list
or labelling is ever brought to the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

BLOCK_EDGES = 1_000_000


def union_find(pairs, parent=None, flat: bool = True) -> dict:
    """Roots (the smallest member) of every node that occurs in `pairs`; not `flat`: some ancestor."""
    parent = {} if parent is None else parent

    def root(x):
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = root(a), root(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    return {x: root(x) for x in list(parent)} if flat else parent


def _contract(most: float):
    """The forest of the partition's edges, let go whenever it holds `most` nodes."""

    def forest(parent):
        pairs = [(x, r) for x, r in union_find((), parent).items() if x != r]
        hi, lo = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["hi", "lo"])

    def run(batches):
        parent: dict = {}
        for batch in batches:
            union_find(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), parent, flat=False)
            if len(parent) >= most:
                yield forest(parent)
                parent.clear()
        if parent:
            yield forest(parent)

    return run


def _labels(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def components(spark: SparkSession, edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    `edges` has two bigint columns. Null ends and self-loops are ignored, repeated edges are fine.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    pairs = edges.select(a.alias("hi"), b.alias("lo")).where("hi <> lo")
    box = Scratch(spark, "components")
    e = box.save(pairs.mapInArrow(_contract(block_edges), "hi bigint, lo bigint"))
    n = e.count()
    blocks = -(-n // block_edges)
    if blocks <= 1:
        return _labels(box.save(e.repartition(1).mapInArrow(_contract(float("inf")), "hi bigint, lo bigint")))
    before = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = box.save(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct())
        after = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        box.drop(e)
        e = new
        if after == before:
            return _labels(e)
        before = after
