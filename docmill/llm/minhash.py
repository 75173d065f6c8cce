"""Near-duplicate documents by MinHash, exact in what it links.

1. Sets. A document's set is its distinct 5-word shingles as 64-bit hashes. Equal
   sets are one node from here on (copies never meet as pairs).
2. Banding. ``HASHES`` universal hash minima in ``BANDS`` bands of ``ROWS``. Two
   sets of similarity 0.85 miss all bands with a chance of 1e-6.
3. Stars. In each bucket every set is compared with the least one, the leader: first
   by signature, then on full sets. Similar ones (A) are linked to the leader. By
   the triangle inequality of the Jaccard distance a set under ``2 * 0.85 - 1`` (C)
   cannot be linked with any of A; those between (B) can.
4. Rest, exactly. B meets A and B of its leader in blocks that compare
   differences from the leader (small, and enough to know any two sets' similarity).
   C meets B and C of its bucket in blocks that compare signatures and, where those
   leave a pair open, full sets. Blocks hold about ``CHUNK`` sets to a side and
   return forests, so neither a bucket nor all its pairs are ever in one place.
5. Components by large-star and small-star.

Signatures only rule pairs out where their estimate is at least four standard
deviations below the threshold.

Edge cases: null texts and texts without words have the empty set, are linked with
nothing and kept; texts under five words have one shingle, the whole sequence;
ids may be of any type that has an order; sets are numbered by a 64-bit hash of what they hold, so rows that repeat
an id are documents of their own; a null id is linked with nothing; words longer
than ``LONG`` bytes stand in sets as digests; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import discard, materialize, sliced, small_batches, table, worker_store
from docmill.llm.components import connected_components, united

SHINGLE = 5
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
SEED = 10
LONG, WINDOW = 256, 4000
CHUNK = 64
#: Ids up to this count (16 MB) are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def ruled_out_below(similarity: float) -> float:
    """Estimates under this (four standard deviations below) rule the similarity out."""
    return similarity - 4 * (similarity * (1 - similarity) / HASHES) ** 0.5


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, long enough for a window."""
    store = worker_store("minhash")
    if "minhash-powers" not in store:
        n, base = WINDOW * (LONG + 1) + 1, 0x9E3779B97F4A7C15
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        store["minhash-powers"] = tuple(out)
    return store["minhash-powers"]


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish, so that hashes spread over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text in UTF-8."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    words = [w if len(w) <= LONG else b"\0" + hashlib.blake2b(w, digest_size=16).hexdigest().encode() for w in words] if max(map(len, words)) > LONG else words
    power, inverse = _powers()
    k, out = min(SHINGLE, len(words)), []
    for at in range(0, max(1, len(words) - k + 1), WINDOW - SHINGLE):
        joined = b" ".join(words[at : at + WINDOW])
        raw = np.frombuffer(joined, np.uint8)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
        spaces = np.flatnonzero(raw == 32)
        starts = np.concatenate([[0], spaces + 1])
        ends = np.concatenate([spaces, [len(raw)]])
        if len(starts) >= k:
            starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
            out.append(_mixed((sums[ends] - sums[starts]) * inverse[starts]))
    return np.unique(np.concatenate(out))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each universal hash over the set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[at : at + 1024, None] * a + b).min(0), out=least)
    return least


def number(found: np.ndarray) -> int:
    """A set's number: what identifies it wherever sets are compared."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "big", signed=True)


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, node, bands, signature): no node for the empty set and for null ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        a, b = _multipliers()
        weights = np.random.default_rng(SEED + 1).integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, node, bands, signatures = [], [], [], []
                for known, text in zip(part.column(0).is_valid().to_pylist(), part.column(1).to_pylist()):
                    found = shingles(text)
                    n.append(len(found))
                    if not len(found) or not known:
                        node.append(None), bands.append(None), signatures.append(None)
                        continue
                    least = minima(found, a, b)
                    node.append(number(found))
                    bands.append(_mixed((least.reshape(BANDS, ROWS) * weights).sum(1, dtype=np.uint64)).view(np.int64))
                    signatures.append((least >> np.uint64(32)).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], names=["id", "n_shingles", "node", "bands", "signature"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, n_shingles bigint, node bigint, bands array<bigint>, signature binary")


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hashes) for the sets of ``nodes`` (node, rep) only, from the texts of the rows that stand for them."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part in sliced(b):
                found = [(node, x) for node, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if number(x := shingles(t)) == node]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["id", "hashes"])

    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    texts = docs.select(F.col(f"`{id_col}`").alias("rep"), F.col(f"`{text_col}`").cast("binary").alias("text")).join(wanted, "rep")
    return texts.select("node", "text").mapInArrow(run, "id bigint, hashes binary").dropDuplicates(["id"])


def _similar(inter, union, percent):
    return 100 * inter >= percent * union


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (x, y) with status A (linked), B (may be linked with what y links) or C, and for A and B what x differs in from y."""
    joined = pairs.join(sets.select(F.col("id").alias("x"), F.col("hashes").alias("hx")), "x").join(sets.select(F.col("id").alias("y"), F.col("hashes").alias("hy")), "y")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                status, sizes, deltas = [], [], []
                for hx, hy in zip(part.column(2), part.column(3)):
                    x, y = (np.frombuffer(h.as_buffer(), np.uint64) for h in (hx, hy))
                    delta = np.setxor1d(x, y, assume_unique=True)
                    inter, union = (len(x) + len(y) - len(delta)) // 2, (len(x) + len(y) + len(delta)) // 2
                    kind = "A" if _similar(inter, union, percent) else "B" if _similar(inter, union, 2 * percent - 100) else "C"
                    status.append(kind), sizes.append(len(x)), deltas.append(None if kind == "C" else delta.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(status, pa.string()), pa.array(sizes, pa.int64()), pa.array(deltas, pa.binary())], names=["x", "y", "status", "n", "delta"])

    return joined.select("x", "y", "hx", "hy").mapInArrow(run, "x bigint, y bigint, status string, n bigint, delta binary")


def _estimated(pairs: DataFrame, signatures: DataFrame, at_least: float) -> DataFrame:
    """pairs (x, y, may): whether the signatures leave open a similarity that an estimate below ``at_least`` rules out."""
    joined = pairs.join(signatures.select(F.col("id").alias("x"), F.col("signature").alias("sx")), "x").join(signatures.select(F.col("id").alias("y"), F.col("signature").alias("sy")), "y")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            s = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((s[0] == s[1]).mean(1) >= at_least, pa.bool_())], names=["x", "y", "may"])

    return joined.select("x", "y", "sx", "sy").mapInArrow(run, "x bigint, y bigint, may boolean")


def _blocks(rows: DataFrame, keys: list[str], left: str, right: str, payload: list[str]) -> DataFrame:
    """Rows dealt to blocks (i, j) of their group: those of ``left`` to all j of one i, those of ``right`` to all i of one j."""
    counts = rows.groupBy(*keys).agg(F.count_if(F.expr(left)).alias("lefts"), F.count_if(F.expr(right)).alias("rights")).where("lefts > 0 AND lefts + rights > 2")
    sized = rows.join(counts, keys).withColumns({"ni": F.ceil(F.col("lefts") / CHUNK).cast("int"), "nj": F.ceil(F.col("rights") / CHUNK).cast("int")})
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = sized.where(left).select(*keys, deal("ni", 1).alias("i"), every("nj").alias("j"), F.lit(True).alias("left"), "id", *payload)
    b = sized.where(right).select(*keys, every("ni").alias("i"), deal("nj", 2).alias("j"), F.lit(False).alias("left"), "id", *payload)
    return a.unionByName(b)


def _united(u, v):
    """A block's edges as a forest: one for each node at most."""
    import pyarrow as pa

    return pa.Table.from_batches(list(united([pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])])))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets in ``a`` with sets in ``b``."""
    left, right = (np.concatenate([*x, np.empty(0, np.uint64)]) for x in (a, b))
    shared = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), np.int64)
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    held = [np.isin(x, shared) for x in (left, right)]
    place = [np.searchsorted(shared, x[k]) for x, k in zip((left, right), held)]
    owner = [o[k] for o, k in zip(owner, held)]
    for at in range(0, len(shared), 1 << 14):  # a bounded stretch of them at a time
        dense = []
        for x, p, o in zip((a, b), place, owner):
            here = (p >= at) & (p < at + (1 << 14))
            m = np.zeros((len(x), min(1 << 14, len(shared) - at)), np.float32)
            m[o[here], p[here] - at] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _linked_by_difference(stars: DataFrame, percent: int) -> DataFrame:
    """Edges between sets of B and sets of A or B of one leader, from their differences to it."""
    rows = stars.where("status <> 'C'").select(F.col("y").alias("leader"), F.col("x").alias("id"), "status", "n", "delta")
    blocks = _blocks(rows, ["leader"], "status = 'B'", "status <> 'C'", ["n", "delta"])

    def run(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        side = [t.filter(pc.equal(t["left"], flag)) for flag in (True, False)]
        ids = [s["id"].to_numpy() for s in side]
        n = [s["n"].to_numpy() for s in side]
        deltas = [[np.frombuffer(d, np.uint64) for d in s["delta"].to_pylist()] for s in side]
        apart = np.array([len(d) for d in deltas[0]])[:, None] + np.array([len(d) for d in deltas[1]])[None, :] - 2 * _common(*deltas)
        total = n[0][:, None] + n[1][None, :]
        i, j = np.nonzero(_similar(total - apart, total + apart, percent) & (ids[0][:, None] != ids[1][None, :]))
        return _united(ids[0][i], ids[1][j])

    return blocks.groupBy("leader", "i", "j").applyInArrow(run, "u bigint, v bigint")


def _linked_in_rest(rest: DataFrame, percent: int) -> DataFrame:
    """Edges between a C and a B or C of one bucket: signatures first, then full sets, within blocks."""
    blocks = _blocks(rest, ["band", "key"], "status = 'C'", "status <> 'A'", ["signature", "hashes"])

    def run(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        side = [t.filter(pc.equal(t["left"], flag)) for flag in (True, False)]
        ids = [s["id"].to_numpy() for s in side]
        s = [np.frombuffer(b"".join(x["signature"].to_pylist()), np.uint32).reshape(-1, HASHES) for x in side]
        sets = [[np.frombuffer(h, np.uint64) for h in x["hashes"].to_pylist()] for x in side]
        size = [np.array([len(x) for x in y]) for y in sets]
        near = (s[0][:, None, :] == s[1][None, :, :]).mean(2) >= ruled_out_below(percent / 100)
        near &= _similar(np.minimum(size[0][:, None], size[1][None, :]), np.maximum(size[0][:, None], size[1][None, :]), percent)
        found = []
        for i, j in zip(*np.nonzero(near & (ids[0][:, None] != ids[1][None, :]))):
            inter = len(np.intersect1d(sets[0][i], sets[1][j], assume_unique=True))
            if _similar(inter, size[0][i] + size[1][j] - inter, percent):
                found.append((ids[0][i], ids[1][j]))
        return _united(*([f[n] for f in found] for n in (0, 1)))

    return blocks.groupBy("band", "key", "i", "j").applyInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``; ``percent`` (0 to 100) is the least similarity that links."""
    small_batches(docs.sparkSession)
    found = materialize(features(docs, id_col, text_col), "mh-features")
    texts = found.where("node IS NOT NULL")
    same = materialize(texts.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "mh-same")
    nodes = materialize(texts.groupBy("node").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature")).withColumnRenamed("node", "id"), "mh-nodes")
    banded = nodes.select("id", F.posexplode("bands").alias("band", "key"))
    lead = banded.groupBy("band", "key").agg(F.min("id").alias("leader"), F.max("id").alias("most")).where("leader <> most").drop("most")
    member = materialize(banded.join(lead, ["band", "key"]).where("id <> leader"), "mh-members")
    pairs = member.select(F.col("id").alias("x"), F.col("leader").alias("y")).distinct()
    signatures = nodes.select("id", "signature")
    estimate = materialize(_estimated(pairs, signatures, ruled_out_below(2 * percent / 100 - 1)), "mh-estimates")
    may = estimate.where("may").select("x", "y")
    standing = lambda ids: ids.distinct().join(same.select("node", "rep"), "node")
    sets = materialize(full_sets(docs, standing(may.select(F.explode(F.array("x", "y")).alias("node"))), id_col, text_col), "mh-sets")
    stars = materialize(verified(may, sets, percent), "mh-stars")
    status = estimate.join(stars.select("x", "y", "status"), ["x", "y"], "left").select(F.col("x").alias("id"), F.col("y").alias("leader"), F.coalesce("status", F.lit("C")).alias("status"))
    judged = materialize(member.join(status, ["id", "leader"]).where("status <> 'A'"), "mh-placed")
    busy = judged.groupBy("band", "key").agg(F.count_if(F.col("status") == "C").alias("c"), F.count("*").alias("all")).where("c > 0 AND all > 1").select("band", "key")
    rest = materialize(judged.join(busy, ["band", "key"]), "mh-rest")
    others = materialize(full_sets(docs, standing(rest.select(F.col("id").alias("node"))), id_col, text_col), "mh-sets")
    late = _linked_in_rest(rest.join(signatures, "id").join(others, "id"), percent)
    star_edges = stars.where("status = 'A'").select(F.col("x").alias("u"), F.col("y").alias("v"))
    # written first, so that a task holds one Python process at a time
    edges = materialize(star_edges.unionByName(_linked_by_difference(stars, percent)).unionByName(late), "mh-edges")
    parts = connected_components(edges)
    linked = materialize(same.join(parts, "node", "left").where("copies > 1 OR component IS NOT NULL").select("node", "rep", F.coalesce("component", "node").alias("component")), "mh-components")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = linked.join(least, "component").select("node", "component_id")
    placed = found.select("id", "n_shingles", "node").join(known, "node", "left")
    for used in (nodes, member, estimate, sets, stars, judged, rest, others, edges):
        discard(used)
    return placed.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id."""
    free = "_kept"
    while any(c.startswith(free) for c in docs.columns):
        free = "_" + free
    kept = near_duplicates(docs, id_col, text_col, percent).where("kept").select(F.col(f"`{id_col}`").alias(f"{free}_id"), F.lit(True).alias(free)).distinct()
    keep = docs.join(kept, F.col(f"`{id_col}`") == F.col(f"{free}_id"), "left").where(F.col(free) | F.col(f"`{id_col}`").isNull())
    return keep.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
