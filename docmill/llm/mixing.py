"""Mixing sources to target weights by a splitting tree over source block quotas.

1. Targets. Every source's share of the whole size follows its weight, but no
   target exceeds ``cap`` times the source's size; what is over is shared again
   by weight. Sorting sources by cap/weight gives the fixed point directly.
2. Blocks. A hash deals the documents of a source into F * F blocks (F a power
   of two chosen from the source's number of documents), which an odd affine
   map on both digits permutes. A source with target = (c + f) * size takes
   every block c times and of one more permuted pass the first blocks until the
   fraction f is filled: whole first digits, then whole second digits, then
   documents of one last block in hash order, each that still fits.
3. Splitting tree. The block quotas of all sources form one urn. At every node
   the left child gets half of the node's block copies, drawn without
   replacement (so the split of the sources is multivariate hypergeometric),
   down to the output shards. Quotas are exact: they add up over the shards.
4. Draws. A source's permuted block copies are dealt to the shards as disjoint
   runs whose lengths are the quotas; ``mixed_rows`` gives every shard a partition of
   its own and shuffles within it.

A node's draw for a source of up to ``ONE_BY_ONE`` copies goes copy by copy; of more it is taken
from the normal law of the hypergeometric's mean and variance, within its bounds, so that a
node costs the same however large its quotas are.

Only per-source rows (targets, urns) meet in one place. Documents meet them by
a broadcast join while there are at most ``BROADCAST_SOURCES`` sources, and by a
salted join beyond, so a source with a third of the rows is shared out.

Edge cases: a null text has size 0; a null source is a source of its own, last
in order; sources without words get target 0 and take nothing; equal rows of
one source are taken or left together; an empty table gives an empty result;
other columns of the input are not read (``mixed_rows`` returns them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import WORD, discard, materialize, partition_keys, table

WEIGHTS = (1, 2, 3)
#: At most so many source rows are broadcast (about 1 KB each).
BROADCAST_SOURCES = 20_000
SALTS = 32
ONE_BY_ONE = 64


def _joined(docs: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """docs with the columns of their source, whatever the skew."""
    if n_sources <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(sources), "skey")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["skey", "salt"]).drop("salt")


def source_targets(sources: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, skey, docs, source_size) with idx and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    limit = F.col("source_size") * F.lit(float(cap))
    ranked = sources.withColumn("idx", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("idx") % len(weights) + 1).cast("double"))
    by_ratio = Window.orderBy(limit / F.col("weight"), "idx")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return ranked.withColumn("level", level).withColumn("target", F.least(limit, F.max("level").over(everything) * F.col("weight"))).drop("level")


def _cell(name: str, odd: int) -> F.Column:
    """A digit's place in the permuted order."""
    return F.pmod(F.col(name) * F.lit(odd) + F.pmod("salt0", F.col("fan")), F.col("fan"))


def _boundary(cells: DataFrame, place: str, need: str) -> DataFrame:
    """Per source the first permuted cell that does not fit whole, and what is left to take there."""
    w = Window.partitionBy("skey").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    over = cells.withColumn("upto", F.sum("size").over(w)).where(F.col("upto") > F.col(need))
    return over.groupBy("skey").agg(F.min(F.struct(place, (F.col(need) - (F.col("upto") - F.col("size"))).alias("left"))).alias("b")).select("skey", F.col("b")[place].alias(f"{place}_end"), F.col("b.left").alias(f"{place}_left"))


def shard_offsets(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(skey, offsets): where each shard's run of the source's permuted block copies begins.

    ``shards`` is a power of two. Each tree level halves every node's urn: the copies of
    each source in turn go left by the conditional law (left still to fill / copies still to
    deal), which draws the multivariate hypergeometric split.
    """
    urn = sources.groupBy().agg(F.array_sort(F.collect_list(F.struct("idx", "skey", F.col("blocks").alias("q")))).alias("urn")).select(F.lit(0).alias("node"), "urn")
    for level in range(shards.bit_length() - 1):
        draw = lambda i: f"(pmod(xxhash64({seed}, {level}, node, s.idx, {i}), 1000000007L) + 0.5D) / 1000000007D"
        # rest copies are still to deal, free of them go left; s.q are of this source
        one_by_one = f"""aggregate(sequence(1L, s.q), struct(a.rest AS rest, a.free AS free),
            (b, i) -> struct(b.rest - 1L AS rest, b.free - if({draw("i")} * b.rest < b.free, 1L, 0L) AS free), b -> a.free - b.free)"""
        share = "(a.free / a.rest)"
        spread = f"sqrt(s.q * {share} * (1 - {share}) * (a.rest - s.q) / greatest(a.rest - 1, 1))"
        normal = f"cast(round(s.q * {share} + {spread} * sqrt(-2 * ln({draw(0)})) * cos(2 * pi() * {draw(1)})) AS bigint)"
        at_once = f"least(least(s.q, a.free), greatest(greatest(0L, a.free - (a.rest - s.q)), {normal}))"
        drawn = f"CASE WHEN s.q = 0 OR a.free = 0 THEN 0L WHEN s.q <= {ONE_BY_ONE} THEN {one_by_one} ELSE {at_once} END"
        left = f"""aggregate(urn,
            struct(aggregate(urn, 0L, (a, s) -> a + s.q) AS rest, aggregate(urn, 0L, (a, s) -> a + s.q) div 2 AS free, cast(array() AS array<bigint>) AS took),
            (a, s) -> transform(array({drawn}), x -> struct(a.rest - s.q AS rest, a.free - x AS free, array_append(a.took, x) AS took))[0]).took"""
        split = urn.selectExpr("node", "urn", f"{left} AS took")
        child = lambda q: f"zip_with(urn, took, (s, t) -> struct(s.idx AS idx, s.skey AS skey, {q} AS q))"
        urn = split.select("node", F.inline(F.array(*[F.struct(F.lit(side).alias("side"), F.expr(child(q)).alias("part")) for side, q in ((0, "t"), (1, "s.q - t"))]))).selectExpr("node * 2 + side AS node", "part AS urn")
    runs = urn.select("node", F.inline("urn"))
    before = Window.partitionBy("skey").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("start", F.coalesce(F.sum("q").over(before), F.lit(0).cast("long"))).groupBy("skey").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "start"))), lambda x: x["start"]).alias("offsets"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, docs_per_block: int = 256, shards: int = 64, seed: int = 5) -> DataFrame:
    """(id, source, size, key, source_size, target, copies, taken, shards) for every row of ``docs``.

    ``copies``: how often the mix holds the document; ``shards``: the output shard of each copy.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("size")).withColumns(
        {"key": F.xxhash64(F.lit(seed), "id", "size", "source"), "skey": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))})
    base = materialize(base, "mix-sizes")
    sized = base.groupBy("skey", "source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    digits = F.ceil(F.log2(F.greatest(F.col("docs") / F.lit(docs_per_block), F.lit(1.0))) / 2)
    sources = source_targets(sized, cap).withColumns({
        "fan": F.pow(F.lit(2.0), digits).cast("long"), "salt0": F.xxhash64(F.lit(seed), "skey"),
        "full": F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.lit(int(cap)))).otherwise(0).cast("long"),
    }).withColumn("need", F.greatest(F.col("target") - F.col("full") * F.col("source_size"), F.lit(0.0)))
    sources = materialize(sources, "mix-sources")
    n = sources.count()
    placed = _joined(base, sources.drop("source", "docs"), n).withColumns({"c1": F.pmod(F.shiftright("key", 8), F.lit(1 << 20)), "c2": F.pmod(F.shiftright("key", 36), F.lit(1 << 20))}).withColumns({"p1": _cell("c1", 0x9E3779B1), "p2": _cell("c2", 0x85EBCA77)})
    placed = placed.drop("c1", "c2")
    # one level of blocks at a time: whole first digits, whole second digits, then documents
    first = _boundary(placed.groupBy("skey", "p1").agg(F.sum("size").alias("size"), F.first("need").alias("need")), "p1", "need")
    ends = materialize(first, "mix-first")
    inside = _joined(placed, ends, n).where("p1 = p1_end")
    second = _boundary(inside.groupBy("skey", "p2").agg(F.sum("size").alias("size"), F.first("p1_left").alias("p1_left")), "p2", "p1_left")
    ends = materialize(ends.join(second, "skey", "left"), "mix-second")
    last = _joined(placed, ends, n).where("p1 = p1_end AND p2 = p2_end").groupBy("skey", "key").agg(F.sum("size").alias("size"), F.first("p2_left").alias("p2_left"))
    fill = """aggregate(array_sort(units), struct(left AS left, cast(array() AS array<bigint>) AS keys),
        (a, u) -> if(u.size <= a.left, struct(a.left - u.size AS left, array_append(a.keys, u.key) AS keys), a)).keys"""
    chosen = last.groupBy("skey").agg(F.collect_list(F.struct("key", "size")).alias("units"), F.first("p2_left").alias("left")).selectExpr("skey", f"{fill} AS chosen")
    blocks = F.col("full") * F.col("fan") * F.col("fan") + F.coalesce(F.col("p1_end") * F.col("fan") + F.coalesce(F.col("p2_end"), F.lit(0)) + 1, F.lit(0))
    cut = sources.select("skey", "idx", "fan", "full").join(ends.drop("p1_left", "p2_left"), "skey", "left").join(chosen, "skey", "left").withColumn("blocks", F.when(F.col("full") + F.coalesce(F.col("p1_end"), F.lit(-1)) >= 0, blocks).otherwise(0))
    written, cut = ends, materialize(cut, "mix-cut")
    discard(written)
    cut = cut.drop("idx", "fan", "full", "blocks").join(shard_offsets(cut, shards, seed), "skey", "left")
    more = F.expr("CASE WHEN p1_end IS NULL THEN false WHEN p1 < p1_end THEN true WHEN p1 > p1_end THEN false WHEN p2 < p2_end THEN true WHEN p2 > p2_end THEN false ELSE array_contains(coalesce(chosen, cast(array() AS array<bigint>)), key) END")
    out = _joined(placed, cut, n).withColumn("copies", F.col("full") + F.coalesce(more, F.lit(False)).cast("long"))
    place = "c * fan * fan + p1 * fan + p2"
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "key", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.expr(f"transform(if(copies > 0, sequence(0L, copies - 1), cast(array() AS array<bigint>)), c -> size(filter(offsets, o -> o <= {place})) - 1)").alias("shards"),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5, shards: int = 64, shard_col: str | None = None, **options) -> DataFrame:
    """The mix itself: each document of ``docs`` once per copy, dealt to its shards and shuffled within them.

    Every shard is one partition, and so one file if written as it is. The columns are those of ``docs``, and the shard's
    number where ``shard_col`` names a column for it. Rows that agree in id, source and size are mixed alike.
    """
    free = "_mix"
    while any(c.startswith(free) for c in docs.columns):
        free = "_" + free
    key, copy, shard = (f"{free}_{x}" for x in ("key", "copy", "shard"))
    plan = mix(docs, id_col, text_col, source_col, seed=seed, shards=shards, **options).where("copies > 0").groupBy("key").agg(F.first("shards").alias(f"{shard}s")).withColumnRenamed("key", key)
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), size, F.col(f"`{source_col}`"))).join(plan, key)
    dealt = keyed.select(*columns, key, F.posexplode(f"{shard}s").alias(copy, shard))
    apart = F.get(F.array(*[F.lit(k) for k in partition_keys(docs.sparkSession, shards)]), F.col(shard)).cast("long")
    shuffled = dealt.repartition(shards, apart).sortWithinPartitions(shard, F.xxhash64(F.lit(seed + 1), key, copy))
    return shuffled.select(*columns, *([F.col(shard).alias(shard_col)] if shard_col else []))


def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")
