"""Document fingerprints by winnowing, in DataFrame functions only.

Every ``K`` consecutive code points of a text have a Karp-Rabin hash: a polynomial in
``BASE`` modulo the prime ``PRIME``. Of each window of ``W`` consecutive hashes the
smallest is selected, the rightmost of equal ones, with its position. Any two texts
that share ``W + K - 1`` code points in a row share a selected hash, whatever
surrounds them.

How it is computed. Spark has no running fold that gives out its steps, so the
polynomials roll by doubling: the value of 2m code points follows from the two values
of m within it, for all positions at once. Windows are walked from right to left, so that
the first of equal hashes is the rightmost in the text, and texts are taken in
segments of ``SEGMENT`` hashes that overlap by ``W - 1``, so arrays stay short.
A text joined from two others takes over the marks that no window over the seam
can change; only the stretches around the seam and the end are winnowed anew.

Edge cases: a null text counts as empty and has no fingerprint; texts under K code
points are one gram; texts with fewer than W grams are one window; of equal ids the
order is by text; the only row is its own next; likeness of two empty
fingerprints is 1; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import partition_keys, shuffle_parts, table

K, W = 16, 64
BASE, PRIME = 1_000_003, (1 << 30) - 35
SEGMENT = 2048
MARKS = "array<struct<p:int,h:int>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def rolled(points: str, body: str) -> str:
    """SQL of ``body`` with ``v``: from right to left the hashes of every K consecutive ones of the code point array ``points`` (of all, if there are fewer).

    The body is innermost: Spark copies a value that leaves a let, and marks are fewer than hashes.
    """
    names = [f"{points}{m}" for m in (1, 2, 4, 8, 16)]
    few = f"array(aggregate({points}1, 0L, (a, x) -> (a * {BASE}L + x) % {PRIME}L))"
    # values that would need code points past the end are null
    out = _let(f"if(size({points}1) < {K}, {few}, reverse(array_compact({names[4]})))", "v", body)
    for k in (3, 2, 1, 0):
        m, now = 1 << k, names[k]
        zipped = f"zip_with({now}, slice({now}, {m + 1}, size({now})), (x, y) -> %s)"
        value = f"x * {pow(BASE, m, PRIME)}L + y"
        pairs = zipped % f"({value}) % {PRIME}L"
        if m == 1:  # of small code points the value is below the prime as it is
            pairs = f"if(array_max({now}) < {PRIME // (BASE + 1)}L, {zipped % value}, {pairs})"
        out = _let(pairs, names[k + 1], out)
    return _let(points, names[0], out)


def selected(v: str) -> str:
    """SQL of the places in ``v`` that some window selects, the first of equal ones, in order.

    A walk from mark to mark: the next one is the first smaller hash that enters while the mark is still in the
    window, or else the smallest of the window that no longer holds it.
    """
    first = f"cast(array_position({v}, array_min(slice({v}, 1, {W}))) - 1 AS int)"
    entered = f"CASE WHEN m < y THEN array_position(t, filter(t, x -> x < y)[0]) WHEN a.p + {W} < size({v}) THEN array_position(t, m) END"
    following = _let(f"slice({v}, a.p + 2, {W})", "t", _let("array_min(t)", "m", _let(f"{v}[a.p]", "y", f"coalesce(cast(a.p + {entered} AS int), -1)")))
    step = f"if(a.p < 0, a, {_let(following, 'q', 'struct(q AS p, if(q < 0, a.found, array_append(a.found, q)) AS found)')})"
    walk = lambda steps, start: f"aggregate(sequence(1, {steps}), {start}, (a, i) -> {step})"
    begun = _let(first, "f", "struct(f AS p, array(f) AS found)")
    # about 2 in W places are marks: few texts have more than 1 in 24
    return _let(walk(f"size({v}) div 24 + 2", begun), "w", f"if(w.p < 0, w, {walk(f'size({v})', 'w')}).found")


def segments(text: str) -> str:
    """SQL of array<array<struct<p, h>>>: for each segment of the string column ``text`` the marks, with places within the segment."""
    last = f"cast(greatest(length({text}) - {K - 1 + W}, 0) div {SEGMENT} AS int)"
    # to cut a string, Spark walks it from its start: first into about as many stretches as a stretch has segments
    stretch = f"substring({text}, g * {SEGMENT} + 1, r * {SEGMENT} + {W - 1 + K - 1})"
    points = f"transform(split(substring(stretch, k * {SEGMENT} + 1, {SEGMENT + W - 1 + K - 1}), ''), c -> cast(ascii(c) AS bigint))"
    marks = _let(points, "c", rolled("c", f"transform(reverse({selected('v')}), i -> struct(size(v) - 1 - i AS p, cast(v[i] AS int) AS h))"))
    stretches = f"transform(sequence(0, last, r), g -> {_let(stretch, 'stretch', f'transform(sequence(0, least(r - 1, last - g)), k -> {marks})')})"
    return f"if(length({text}) = 0, cast(array() AS array<{MARKS}>), flatten({_let(last, 'last', _let('cast(ceil(sqrt(last + 1)) AS int)', 'r', stretches))}))"


def winnow(text: str) -> str:
    """SQL of array<struct<p, h>>: positions and hashes selected from the string column ``text``, in order."""
    return _let(segments(text), "gs", placed("gs"))


def placed(gs: str) -> str:
    """SQL of the marks of all segments by position in the text."""
    return once(f"flatten(transform({gs}, (g, k) -> transform(g, x -> struct(cast(x.p + k * {SEGMENT} AS int) AS p, x.h AS h))))")


def once(marks: str) -> str:
    """SQL of ordered marks, each once: the last window of a segment and the first of the next may select the same."""
    return _let(marks, "e", "filter(e, (x, i) -> i = 0 OR x.p <> get(e, i - 1).p)")


def winnow_joined(joined: str, keep: str, taken: str, first: str, second: str) -> str:
    """SQL of the marks of ``joined``: ``keep`` characters of a text with marks ``first``, then ``taken`` of one with marks ``second``."""
    shifted = lambda marks, by: f"transform({marks}, x -> struct(cast(x.p + ({by}) AS int) AS p, x.h AS h))"
    reach = 2 * W + K
    seam = f"greatest({keep} - {reach - 1}, 0)"
    end = f"greatest({keep} + {taken} - {reach - 1}, 0)"
    piece = lambda start, n: _let(f"substring({joined}, {start} + 1, {n})", "piece", winnow("piece"))
    # every window of the second text that ends before what is cut off is one of the joined text: its marks stand from the start
    parts = f"""concat(filter({first}, x -> x.p <= {keep} - {K + W}), {shifted(piece(seam, reach + W + K), seam)},
        {shifted(f"filter({second}, x -> x.p <= {taken} - {K + W})", keep)}, {shifted(piece(end, reach), end)})"""
    return f"if({keep} < {reach} OR {taken} < {reach} OR {keep} + {taken} < {4 * reach}, {winnow(joined)}, {once(f'array_sort({parts})')})"


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all hashes of two fingerprints (arrays of distinct hashes)."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, marks): the selected hashes and positions of every row."""
    return docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")).select(F.col(f"`{id_col}`"), F.expr(winnow("_text")).alias("marks"))


def _bucket(cuts: list, kind: str) -> Column:
    """The number of the last of the sorted ``cuts`` that is at most the id, found in two steps."""
    step = max(1, int(len(cuts) ** 0.5))
    every = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{kind}>")
    coarse = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[::step]]).cast(f"array<{kind}>"), lambda c: c <= F.col("id"))) - 1
    at = F.greatest(coarse, F.lit(0)) * step
    return F.when(F.col("id").isNull(), F.lit(0)).otherwise(at + F.size(F.filter(F.slice(every, at + 1, F.lit(step)), lambda c: c <= F.col("id"))) - 1)


def in_order(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """``rows`` (id, text, ...) with bucket and mirrored: buckets hold runs of ascending ids, nulls first.

    The first row of each bucket stands once more, mirrored, at the end of the one before (of the first bucket: at the
    end of the last), so that every row finds its next one within its bucket. There are twice as many buckets as
    shuffle partitions: they grow only where partitions do.
    """
    ids = rows.select("id")
    kind = rows.schema["id"].dataType.simpleString()
    # Spark's range partitioner cuts the ids into even runs; only ids move for that, and one row of each run comes back
    runs = ids.where("id IS NOT NULL").repartitionByRange(buckets or 2 * shuffle_parts(rows.sparkSession), "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("first")).select("first")
    cuts = sorted({r["first"] for r in runs.collect()})
    if not cuts:
        return rows.withColumns({"bucket": F.lit(0), "mirrored": F.explode(F.array(F.lit(False), F.lit(True)))})
    nulls = not ids.where("id IS NULL").isEmpty()
    dealt = rows.withColumn("bucket", _bucket(cuts, kind))
    # every cut is the least id of its bucket; before those of the first one stand the nulls
    firsts = F.array(*[F.lit(None if nulls and not i else c) for i, c in enumerate(cuts)]).cast(f"array<{kind}>")
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("m"))
    back = F.struct(F.when(F.col("bucket") == 0, F.lit(len(cuts) - 1)).otherwise(F.col("bucket") - 1).alias("b"), F.lit(True).alias("m"))
    places = F.when(F.col("id").eqNullSafe(F.get(firsts, F.col("bucket"))), F.array(own, back)).otherwise(F.array(own))
    return dealt.withColumn("place", F.explode(places)).withColumns({"bucket": F.col("place.b"), "mirrored": F.col("place.m")}).drop("place")


def op1_winnowing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    hashes = lambda c: F.array_distinct(F.transform(c, lambda x: x["h"]))
    digest = lambda c: F.sha2(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["p"], x["h"])), ","), 256)
    # places within segments and hashes travel as narrow as they are: 2 and 4 bytes a mark
    own = docs.select("id", "text", F.expr(segments("text")).alias("gs")).select(
        "id", "text", F.unhex(digest(F.expr(placed("gs")))).alias("fingerprint"), F.expr("transform(gs, g -> transform(g, x -> cast(x.p AS smallint)))").alias("p"), F.expr("flatten(transform(gs, g -> transform(g, x -> x.h)))").alias("h"))
    order = Window.partitionBy("bucket").orderBy("mirrored", F.col("id").asc_nulls_first(), "text")
    # twice as many buckets as partitions, dealt so that every partition gets two
    parts = shuffle_parts(spark)
    keys = F.array(*[F.lit(k) for k in partition_keys(spark, parts, 2)]).cast("array<bigint>")
    dealt = in_order(own, 2 * parts).withColumn("bucket", F.get(keys, F.col("bucket")))
    lead = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "p", "h")]).where("NOT mirrored")
    marks = lambda p, h: once(f"zip_with(flatten(transform({p}, (g, k) -> transform(g, x -> cast(x + k * {SEGMENT} AS int)))), {h}, (p, h) -> struct(p AS p, h AS h))")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = lead.select(
        "id", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.length("text").alias("n"), (F.length("text") - half).alias("keep"), F.least(half, F.length("next_text")).alias("taken"),
        F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)).alias("edited"), F.expr(marks("p", "h")).alias("first"), F.expr(marks("next_p", "next_h")).alias("second"))
    marked = edited.select("id", "n", "fingerprint", F.sha2(F.col("edited"), 256).alias("edited_sha256"), hashes(F.col("first")).alias("own"), hashes(F.col("second")).alias("others"), F.expr(winnow_joined("edited", "keep", "taken", "first", "second")).alias("marks"))
    return marked.select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", digest(F.col("marks")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes(F.col("marks"))).alias("near_edited"), likeness(F.col("own"), F.col("others")).alias("near_next"))
