"""Near-duplicate embeddings by sorted projection passes.

Each pass orders the vectors of a label lexicographically by ``BITS`` concatenated
random hashes (sides of random hyperplanes) and compares every vector with the
``WINDOW`` that follow. Pairs of cosine ``COARSE`` or more join their vectors to coarse
clusters, united across all passes. Only short records travel for that: the key, a code of
one byte for each component (which tells the cosine to about 0.001) and the id. Links are exact
within clusters: blocks of about ``CHUNK`` vectors to a side compare all of a cluster in double
precision and count and keep pairs of the threshold or more. So a window only has
to show that a neighbourhood exists, not to hold every pair of it; components
then come from links alone.

Hashes see each vector less the mean of its label (and length), so that a direction that all
vectors of a label share does not crowd them on one side of the planes. The number of passes
(``PASSES`` at least) follows from the rows of a label and from how far its vectors share a direction.

Vectors that agree in every component are one node; next to each other in a pass, they take one place of a window.

Edge cases: null labels, null or zero vectors and vectors with null or non-finite
components are linked with nothing; vectors of different lengths are not compared;
a null id keeps its row without links; ids may be of any type that has an order, vectors are numbered by
a 64-bit hash of what they hold; rows that repeat an id count as vectors of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import discard, materialize, shuffle_parts, small_batches, table
from docmill.llm.components import connected_components, united

PASSES, BITS, WINDOW, CHUNK, SEED = 6, 64, 64, 256, 8
COARSE = 0.94
MISS = 1e-3  # chance to miss a lone pair
#: Clustered ids up to this count (16 MB) are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _planes(size: int, number: int) -> np.ndarray:
    return np.random.default_rng([SEED, number, size]).standard_normal((BITS, size))


def _able(label, vector):
    """(rows, spaces, vectors) of a batch's rows that can link, by length of the vector; a space is length and label."""
    import pyarrow.compute as pc

    n = pc.fill_null(pc.list_value_length(vector), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vector.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null components become NaN
    starts, names = np.cumsum(n) - n, label.to_pylist()
    for size in np.unique(n[n > 0]):
        at = np.flatnonzero(n == size)
        x = flat[starts[at][:, None] + np.arange(size)]
        good = np.isfinite(x).all(1) & x.any(1) & np.array([names[k] is not None for k in at])
        yield at[good], [f"{size}:{names[k]}" for k in at[good]], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, without overflow or underflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _numbers(spaces: list[str], x: np.ndarray) -> list[int]:
    """A number for each vector, by a hash of its space and components."""
    return [int.from_bytes(hashlib.blake2b(s.encode() + b":" + v.tobytes(), digest_size=8).digest(), "big", signed=True) for s, v in zip(spaces, x)]


def marked(rows: DataFrame) -> DataFrame:
    """(id, node) of (id, label, v): equal vectors of a label are one node; null where a vector cannot link."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            node = [None] * b.num_rows
            for at, spaces, x in _able(b.column(1), b.column(2)):
                for k, number in zip(at, _numbers(spaces, x)):
                    node[k] = number
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64())], names=["id", "node"])

    return rows.select("id", "label", "v").mapInArrow(run, f"id {kind}, node bigint")


def _breadth(rows: int, shared: float, threshold: float) -> tuple[int, int]:
    """(passes, window) by which a lone pair of a label is met but for a chance of ``MISS``.

    Unrelated vectors of the label have a cosine of about ``shared``, the square of the mean's
    length; less the mean, a pair at ``threshold`` has cosine (threshold - shared) / (1 - shared).
    """
    cosine = min(max((threshold - shared) / max(1 - shared, 1e-9), 0.5), 1.0)
    met = (1 - math.acos(cosine) / math.pi) ** max(math.log2(max(rows, 1) / WINDOW), 0)
    return max(PASSES, math.ceil(math.log(MISS) / math.log1p(-min(met, 1 - 1e-12)))), WINDOW


def _means(rows: DataFrame, threshold: float) -> DataFrame:
    """(space, mean, passes): the mean vector of every label, summed by task, and the passes it asks for."""

    def run(batches):
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            for _, spaces, x in _able(b.column(0), b.column(1)):
                names, place = np.unique(spaces, return_inverse=True)
                total = np.zeros((len(names), x.shape[1]))
                np.add.at(total, place, unit(x))
                for s, t, n in zip(names.tolist(), total, np.bincount(place, minlength=len(names))):
                    held = sums.setdefault(s, [0, 0])
                    held[0], held[1] = held[0] + t, held[1] + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], names=["space", "sum", "n"])

    def add(t):
        import pyarrow as pa

        total = sum(np.frombuffer(x, np.float64) for x in t["sum"].to_pylist())
        n = sum(t["n"].to_pylist())
        # rounded, so that the order of the sum does not move a plane's side
        mean = np.round(np.asarray(total) / n, 9)
        return pa.table({"space": t["space"][:1], "mean": pa.array([mean.tobytes()], pa.binary()), "passes": pa.array([_breadth(n, float(mean @ mean), threshold)[0]], pa.int32())})

    return materialize(rows.select("label", "v").mapInArrow(run, "space string, sum binary, n bigint").groupBy("space").applyInArrow(add, "space string, mean binary, passes int"), "vec-means")


def _records(rows: DataFrame, means: DataFrame, passes: int) -> DataFrame:
    """(r): for each pass and vector its pass, a hash of its space, key, code and node, as bytes that sort in this order."""

    def run(batches):
        import pyarrow as pa

        held: dict = {}
        for b in batches:
            means_of = b.column(2).to_pylist()
            for at, spaces, x in _able(b.column(0), b.column(1)):
                if (planes := held.get(x.shape[1])) is None:
                    planes = held[x.shape[1]] = np.vstack([_planes(x.shape[1], p) for p in range(passes)])
                u = unit(x)
                mean = np.frombuffer(b"".join(means_of[k] for k in at), np.float64).reshape(u.shape)
                keys = np.packbits(((u - mean) @ planes.T > 0).reshape(len(u), passes, BITS), axis=2)
                codes = np.rint(u * (127 / np.abs(u).max(1, keepdims=True))).astype(np.int8)
                out = []
                for s, key, code, number in zip(spaces, keys, codes, _numbers(spaces, x)):
                    space, rest = hashlib.blake2b(s.encode(), digest_size=8).digest(), code.tobytes() + number.to_bytes(8, "big", signed=True)
                    out.extend(p.to_bytes(2, "big") + space + k.tobytes() + rest for p, k in enumerate(key))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["r"])

    spaced = rows.where("label IS NOT NULL AND size(v) > 0").withColumn("space", F.concat_ws(":", F.size("v"), "label"))
    return spaced.join(means.select("space", "mean"), "space").select("label", "v", "mean").mapInArrow(run, "r binary")


_GROUP, _KEY, _ID = 10, 18, 8  # bytes of pass and space, with the key, and of the node


def _neighbours(raw: np.ndarray):
    """Edges (u, v) among consecutive records of one group and length, given as rows of bytes."""
    ids = raw[:, -_ID:].copy().view(">i8").ravel().astype(np.int64)
    fresh = np.ones(len(raw), bool)
    fresh[1:] = (raw[1:, :-_ID] != raw[:-1, :-_ID]).any(1)
    first = np.flatnonzero(fresh)
    if not fresh.all():  # vectors of one code stand together and take one place
        at = first[np.cumsum(fresh) - 1]
        other = ids != ids[at]
        yield ids[other], ids[at[other]]
    x = raw[first, _KEY:-_ID].view(np.int8).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = ids[first]
    for at in range(0, len(x), WINDOW):
        near = x[at : at + WINDOW] @ x[at : at + 2 * WINDOW].T >= COARSE
        i, j = np.nonzero(near)
        ahead = (j > i) & (j - i <= WINDOW)
        yield ids[at + j[ahead]], ids[at + i[ahead]]


def _coarse_edges(rows: DataFrame, parts: int, threshold: float) -> DataFrame:
    """Pairs of ``COARSE`` or more among neighbours in the order of each pass, as a forest by task."""
    means = _means(rows, threshold)
    passes = means.agg(F.max("passes")).first()[0] or PASSES

    def run(batches):
        import pyarrow as pa

        held: list[bytes] = []
        for b in batches:
            found, at = held + b.column(0).to_pylist(), 0
            u, v, last = [], [], 0
            while at < len(found):
                group, size, end = found[at][:_GROUP], len(found[at]), at
                while end < len(found) and len(found[end]) == size and found[end].startswith(group):
                    end += 1
                for a, c in _neighbours(np.frombuffer(b"".join(found[at:end]), np.uint8).reshape(end - at, size)):
                    u.append(a), v.append(c)
                last, at = at, end
            # what the next batch may still meet: one record for each of the last codes of a window
            held = []
            for r in reversed(found[last:]):
                if held and r[:-_ID] == held[-1][:-_ID]:
                    held[-1] = r
                elif len(held) == WINDOW:
                    break
                else:
                    held.append(r)
            held.reverse()
            join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
            yield pa.RecordBatch.from_arrays([pa.array(join(u)), pa.array(join(v))], names=["u", "v"])

    ordered = _records(rows, means, passes).repartitionByRange(parts, "r").sortWithinPartitions("r")
    return ordered.mapInArrow(lambda batches: united(run(batches)), "u bigint, v bigint")  # one Python process a task


def _members(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, node, copies, v): the distinct vectors of every coarse cluster, as bytes of doubles."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for _, spaces, x in _able(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(_numbers(spaces, x), pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())], names=["node", "v"])

    wanted = F.broadcast(clusters) if clusters.count() <= BROADCAST_IDS else clusters
    found = rows.select("label", "v").mapInArrow(run, "node bigint, v binary").join(wanted, "node")
    return found.groupBy("cluster", "node").agg(F.count("*").alias("copies"), F.first("v").alias("v"))


def _compared(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links, to): for each block a node is in, its links there by number of vectors, and the least node it reaches there."""
    sized = members.groupBy("cluster").agg(F.count("*").alias("m")).where("m > 1")
    rows = members.join(sized, "cluster").withColumn("n", F.ceil(F.col("m") / CHUNK).cast("int")).withColumn("c", F.pmod(F.xxhash64("id"), F.col("n").cast("long")).cast("int"))
    # every pair of chunks once: a chunk meets itself and each of the others
    blocks = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("cluster", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "id", "v", "copies")

    def run(t):
        import pyarrow as pa

        none, most = pa.array([], pa.int64()), np.iinfo(np.int64).max
        ids, chunk, copies = (t[k].to_numpy() for k in ("id", "c", "copies"))
        x = unit(np.frombuffer(b"".join(t["v"].to_pylist()), np.float64).reshape(t.num_rows, -1))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        if not len(left) or not len(right):
            return pa.table({"id": none, "links": none, "to": none})
        linked = x[left] @ x[right].T >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
        a, b = ids[left].copy(), ids[right].copy()
        while True:  # the least node that each reaches within the block
            wider = np.minimum(b, np.where(linked, a[:, None], most).min(0))
            low = np.minimum(a, np.where(linked, wider[None, :], most).min(1))
            if (wider == b).all() and (low == a).all():
                break
            a, b = low, wider
        met = [(left, linked.any(1), linked @ copies[right], a)] + ([] if i == j else [(right, linked.any(0), copies[left] @ linked, b)])
        return pa.table({"id": pa.array(np.concatenate([ids[s][k] for s, k, _, _ in met])), "links": pa.array(np.concatenate([n[k] for _, k, n, _ in met]).astype(np.int64)), "to": pa.array(np.concatenate([to[k] for _, k, _, to in met]))})

    return blocks.groupBy("cluster", "i", "j").applyInArrow(run, "id bigint, links bigint, to bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.when(F.col(f"`{id_col}`").isNotNull(), F.col(f"`{label_col}`").cast("string")).alias("label"), F.col(f"`{vector_col}`").alias("v"))
    marks = materialize(marked(rows), "vec-marks")
    clusters = materialize(connected_components(_coarse_edges(rows, shuffle_parts(spark), threshold)).select("node", F.col("component").alias("cluster")), "vec-clusters")
    members = materialize(_members(rows, clusters), "vec-members")
    met = materialize(_compared(members.select("cluster", F.col("node").alias("id"), "v", "copies"), threshold), "vec-links")
    links = met.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    parts = connected_components(met.select(F.col("id").alias("u"), F.col("to").alias("v")))
    nodes = marks.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least")).join(links, "node", "left").join(parts, "node", "left")
    known = materialize(nodes.select("node", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "vec-known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = marks.join(known.join(least, "component").select("node", "n_links", "component_id"), "node", "left")
    for used in (clusters, members, met):
        discard(used)
    return placed.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
