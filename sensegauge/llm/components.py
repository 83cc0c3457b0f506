"""Connected components: by alternating large-star and small-star steps (Kiveris et al. 2014) on DataFrames, or, where
edges are few by count, by union-find in one task, which spares the many small shuffles of the former."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensegauge.llm.kernels import map_arrow
from sensegauge.llm.shared import cut


#: Edges that one task takes; some hundred bytes each.
FEW_EDGES = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root for the ends of edges (a, b): root is the smallest node of the component. No edges, no rows.

    Each step only takes minima by node and joins them back, so a node with many neighbours is never gathered.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= FEW_EDGES:
        kind = edges.schema["a"].dataType.simpleString()
        return cut(map_arrow(edges.coalesce(1), _union_find, f"node {kind}, root {kind}"))
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u")).select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = cut(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        last, state = state, _state(edges)
        if state == last:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _union_find(batches):
    """Rows (node, root) of the edges of one task."""
    parent: dict = {}
    kind = None

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 10_000):
        part = nodes[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(x) for x in part], kind)], ["node", "root"])
