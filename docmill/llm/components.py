"""Connected components of an edge list by alternating large-star and small-star.

Large-star links a node's larger neighbours to the least of its neighbourhood;
small-star links a node and its smaller neighbours to the least of those. Both use
only a minimum per node (combined before the shuffle) and a join that Spark may
split at a node with very many edges; no neighbourhood is ever gathered. Each
step is written to the shared folder, so lost executors cost one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import discard, materialize


def united(batches):
    """Arrow batches of edges (u, v) reduced to one edge per node, to the least node it reaches in them."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while up.setdefault(r, r) != r:
            r = up[r]
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def out():
        pairs = [(x, root(x)) for x in list(up)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = root(u), root(v)
            if a != c:
                up[max(a, c)] = min(a, c)
        if len(up) > 1_000_000:  # bounded memory: what is known so far goes on as edges
            yield out()
            up.clear()
    yield out()


def forest(edges: DataFrame) -> DataFrame:
    """Within each partition, edges (u, v) reduced to one edge per node, to the least node it reaches there."""
    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(united, "u bigint, v bigint")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return materialize(out.where("u <> v").distinct(), "cc-edges")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges`` (u, v) the least node it reaches. Nulls and loops are ignored."""
    now = materialize(forest(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")).distinct(), "cc-edges")
    mark = _mark(now)
    while mark[0]:
        wide = _star(now, True)
        small = _star(wide, False)
        discard(wide)
        discard(now)
        now, before = small, mark
        if (mark := _mark(now)) == before:
            break
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
