"""Blocks of Markdown lines: segmentation, heading paths, classification, patches, gates, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T

TARGET, LONGEST = 1200, 3500
#: Characters besides white space up to which a call to action stands alone.
SQUEEZED = 80
PROTECTED_TYPES = ("code", "table", "image", "formula")


def line_kinds(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, s, kind, opens, prev): fences by parity, tables of two rows or more, short lines with an image.

    A table begins at the first line of a run of ``|`` lines that holds a second ``|``; one blank line does not end a quote.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto, above = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    s, line = F.col("s"), F.col("line")
    plain = F.when(s == "", "blank").when(F.startswith(line, F.lit("#")) & F.rlike(line, F.lit(r"^#{1,6}\s+\S")), "section_heading").when(
        F.contains(s, F.lit("![")) & F.rlike(s, F.lit(T.IMAGE)) & (F.length(s) < 200), "image_evidence").when(s.startswith(">"), "quote").otherwise("text")
    bar = s.startswith("|")
    base = lines.withColumn("s", T.trimmed(line)).select("doc_id", "line_no", "line", "s", s.startswith("```").alias("fence"), bar.alias("bar"), (bar & F.contains(F.substring(s, 2, 1 << 30), F.lit("|"))).alias("second"), plain.alias("plain"))
    counted = base.withColumn("fences", F.sum(F.col("fence").cast("int")).over(upto))
    in_code = (F.col("fences") % 2 == 1) | F.col("fence")
    runs = counted.withColumn("pipe", F.col("bar") & ~in_code)
    # where the run of | lines began, and where it held a second | last, up to a line and before it: all in the order of lines
    second = F.when(F.col("pipe") & F.col("second"), F.col("line_no"))
    piped = runs.withColumns({"ended": F.max(F.when(~F.col("pipe"), F.col("line_no"))).over(upto), "seen": F.max(second).over(upto), "seen_above": F.max(second).over(above), "goes_on": F.lead("pipe", 1, False).over(order)})
    within = lambda c: F.col(c).isNotNull() & (F.col("ended").isNull() | (F.col(c) > F.col("ended")))
    table = F.col("pipe") & within("seen") & (F.col("goes_on") | within("seen_above"))
    kinds = piped.withColumn("kind", F.when(in_code, "code").when(table, "table").otherwise(F.col("plain"))).withColumns({"k_two": F.lag("kind", 2).over(order), "k_before": F.lag("kind").over(order), "k_after": F.lead("kind").over(order)})
    joined = (F.col("kind") == "blank") & (F.col("k_before") == "quote") & (F.col("k_after").isNull() | (F.col("k_after") == "quote"))
    joined_before = (F.col("k_before") == "blank") & (F.col("k_two") == "quote") & (F.col("kind") == "quote")
    return kinds.select("doc_id", "line_no", "line", "s", F.when(joined, "quote").otherwise(F.col("kind")).alias("kind"), (F.col("fence") & (F.col("fences") % 2 == 1)).alias("opens"), F.when(joined_before, "quote").otherwise(F.col("k_before")).alias("prev"))


def blockify(lines: DataFrame) -> DataFrame:
    """(doc_id, block_idx, type, text, line_start, line_end, protected, heading_path)."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    k = line_kinds(lines)
    starts = (F.col("kind") != "blank") & (F.col("opens") | F.col("kind").isin("section_heading", "image_evidence") | F.col("prev").isNull() | (F.col("prev") != F.col("kind")))
    level = F.when(F.col("kind") == "section_heading", F.length(F.regexp_extract("line", "^(#+)", 1)))
    title = F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1)
    k = k.withColumns({"level": level, "starts": starts})
    # a block has the path of its first line, as no heading stands within one; a level is on the path if its last heading comes after the last of every higher level
    last = [F.max(F.when(F.col("level") == n, F.struct("line_no", T.stripped(title).alias("title")))).over(upto).alias(f"h{n}") for n in range(1, 7)]
    k = k.select("*", (F.sum(F.col("starts").cast("int")).over(upto) - 1).alias("block_idx"), *last)
    path = F.array_compact(F.array(*[F.when(F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"h{m}.line_no"), F.lit(-1)) for m in range(1, n)]) < F.coalesce(F.col(f"h{n}.line_no"), F.lit(-1)), F.col(f"h{n}.title")) for n in range(1, 7)]))
    body = k.where("kind <> 'blank'").groupBy("doc_id", "block_idx").agg(
        F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.min("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"), F.max(F.when(F.col("starts"), F.array_join(path, " > "))).alias("heading_path"))
    b = body.withColumn("joined", F.array_join(F.transform("l", lambda x: x["line"]), "\n")).withColumn("text", T.trimmed(F.col("joined")))
    kind = F.when(F.col("kind") != "text", F.col("kind")).when(F.col("text").startswith("|"), "table").when(T.step_line(F.col("text")), "operation_step").otherwise("paragraph")
    return b.select("doc_id", F.col("block_idx").cast("long"), kind.alias("type"), "text", F.col("line_start").cast("long"), F.col("line_end").cast("long"), F.col("kind").isin("code", "table").alias("protected"), "heading_path")


def _any_match(c: F.Column | T.Read, patterns: list[str], head: str = "") -> F.Column:
    """Whether a pattern matches; ``head`` stands before all, as an anchor that is then tried once for all."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return T.matches(c, f"{head}(?:{joined})" if head else joined)


def wrapper_type(t: T.Read, squeezed: T.Read, searched: T.Read) -> F.Column:
    """marketing_cta, back_matter, marketing_wrapper or null: packaging that sells instead of teaching.

    A tutorial term near a business term needs no test of its own: a business term anywhere is a method signal.
    """
    cta = (F.length(squeezed.text) <= SQUEEZED) & T.contains_any(squeezed, [x.replace(" ", "") for x in T.CTA]) & ~T.holds_any(squeezed, T.TUTORIAL) & ~T.knowledge_signal(squeezed)
    step = ~t.text.startswith("```") & ~t.text.startswith("|") & ~F.contains(t.low, F.lit("<table")) & T.matches(t, T.PROTECTED[0][1], "iuUm")
    method = step | T.holds_any(searched, T.BUSINESS) | T.knowledge_signal(searched)
    return F.when(T.matches(t, T.REFUND), F.lit(None).cast("string")).when(cta, "marketing_cta").when(
        T.holds_any(searched, T.WRAPPER_HEADING) & ~method, F.when(T.holds_any(searched, T.BACK_MATTER), "back_matter").otherwise("marketing_wrapper")).when(_any_match(t, T.WRAPPER_LINE) & ~method, "marketing_wrapper")


def classify(blocks: DataFrame) -> DataFrame:
    """Blocks with type, status, protected, confidence and reason by the first rule that fits."""
    text, kind = F.col("text"), F.col("type")
    path = F.replace(F.coalesce(F.col("heading_path"), F.lit("")), F.lit(" > "), F.lit(" "))
    told, t = T.read(blocks.withColumn("heading", path), "text")
    told, heading = T.read(told, "heading", "heading_")
    # white space is taken out of texts that can be short without it
    tight = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    short = (F.length(text) <= SQUEEZED) | (F.length(tight(F.substring(text, 1, 2 * SQUEEZED))) <= SQUEEZED)
    told = told.withColumns({"squeezed": F.when(short, tight(text)), "searched": F.concat("heading", F.lit("\n"), text), "searched_wide": t.wide | heading.wide}).withColumn("squeezed_low", F.lower("squeezed"))
    squeezed, searched = T.Read(F.col("squeezed"), F.col("squeezed_low"), t.wide), T.Read(F.col("searched"), F.lower("searched"), F.col("searched_wide"))
    told = told.withColumns({"wrapper": wrapper_type(t, squeezed, searched), "sells": T.contains_any(t, T.CTA)})
    cta, wrapper = F.col("sells"), F.col("wrapper")
    lesson = T.holds_any(t, T.TUTORIAL) | T.knowledge_signal(t) | T.holds_any(heading, T.BUSINESS) | T.knowledge_signal(heading)
    case = lambda status, new, safe, confidence, reason: F.struct(F.lit(status).alias("status"), (new if isinstance(new, F.Column) else F.lit(new)).alias("type"), (safe if isinstance(safe, F.Column) else F.lit(safe)).alias("protected"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
    rules = [
        (text == "", case("discard", "empty", False, 0.95, "empty")),
        (wrapper.isNotNull(), case("discard", wrapper, False, 0.96, "marketing_wrapper")),
        (kind.isin("code", "table"), case("keep", kind, True, 0.90, "structural")),
        (kind.isin("section_heading", "quote"), case("keep", kind, F.col("protected"), 0.90, "structural")),
        (kind == "image_evidence", case("unclassified", kind, False, 0.0, "image")),
        (kind == "operation_step", case("keep", kind, True, 0.90, "protected_type")),
        (text.startswith("```"), case("keep", "code", True, 0.90, "protected_pattern")),
        (text.startswith("|") | F.contains(t.low, F.lit("<table")), case("keep", "table", True, 0.90, "protected_pattern")),
        *[(T.matches(t, p, "iuUm"), case("keep", label, True, 0.90, "protected_pattern")) for label, p in T.PROTECTED],
        (cta & lesson, case("keep", "case_step", True, 0.88, "contextual_cta")),
        (_any_match(t, [*T.FILLER, *T.FILLER_MORE], "^"), case("discard", "transcript_filler", False, 0.95, "filler")),
        (cta, case("discard", "marketing_cta", False, 0.95, "cta")),
        (T.matches(t, T.REFUND), case("discard", "refund_policy", False, 0.95, "refund")),
        (T.matches(t, T.FOOTER), case("discard", "footer", False, 0.95, "footer")),
        *[(T.matches(t, p), case("evidence", label, False, 0.85, "evidence")) for label, p in T.EVIDENCE],
        ((F.length(text) >= 20) & T.is_unusual(text) & ((T.count(text, "�") >= 3) | (T.garbled_count(text) / F.length(text) > 0.15)), case("discard", "garbled_text", F.col("protected"), 0.80, "garbled")),
    ]
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, value)
    done = told.withColumn("c", chain.otherwise(case("keep", kind, F.col("protected"), 0.70, "default")))
    return done.select("doc_id", "block_idx", F.col("c.type").alias("type"), F.col("c.status").alias("status"), F.col("c.protected").alias("protected"), F.col("c.confidence").alias("confidence"), F.col("c.reason").alias("reason"), "text", F.col("type").alias("source_type"), "heading_path")


def promotional_rule(line: F.Column) -> F.Column:
    """The first base rule that a line matches, unless it speaks of the subject itself."""
    found = F
    for name, pattern in T.PROMO:
        found = found.when(T.matches(line, pattern), F.lit(name))
    return F.when(~T.contains_any(line, T.KNOWLEDGE), found.otherwise(F.lit(None).cast("string")))


def patches(before: DataFrame) -> DataFrame:
    """CDC of the promotional-line rules over kept blocks: one row for each block that they change."""
    kept = before.where("status NOT IN ('discard', 'evidence')").withColumn("rule_id", promotional_rule(F.col("text"))).where("rule_id IS NOT NULL AND NOT protected")
    return kept.select("doc_id", "block_idx", "rule_id", F.lit("status_update").alias("change_type"), F.col("status").alias("before_status"), F.lit("discard").alias("after_status"), "type")


def gate(patched: DataFrame, blocks: DataFrame, active: list[str]) -> DataFrame:
    """Patches with the reason of rejection, null where accepted."""
    known = blocks.select("doc_id", "block_idx", F.col("type").alias("before_type"), F.col("protected").alias("before_protected"))
    met = patched.join(known, ["doc_id", "block_idx"], "left")
    reason = F.when(F.col("before_type").isNull(), "missing_target_node").when(~F.col("rule_id").isin(active), "rule_not_in_policy_snapshot").when(
        F.col("before_protected") | F.col("before_type").isin(*PROTECTED_TYPES), "protected_structure_change").when((F.col("before_type") == "section_heading") & (F.col("after_status") == "discard"), "whole_section_deletion")
    return met.select("doc_id", "block_idx", "rule_id", "change_type", reason.alias("rejected"))


def kept_blocks(blocks: DataFrame, row: F.Column, *more: F.Column) -> DataFrame:
    """(doc_id, b, ...): the kept blocks of each document that keeps any, in order.

    Kept ones are picked within the aggregate: as a filter the rules would sink below it and each evaluate the block's text anew.
    """
    kept = (F.col("status") == "keep") & (F.col("text") != "")
    return blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(kept, row))).alias("b"), *more).where("size(b) > 0")


def over_target(g: F.Column, x: F.Column) -> F.Column:
    return g["n"] + 2 + x["n"] > TARGET


def chunk_generic(blocks: DataFrame) -> DataFrame:
    """(doc_id, chunk, blocks, char_count): kept blocks packed in order, closed before they pass the target."""
    from docmill.operators.packing import pack

    return pack(blocks, over_target, lambda g, x: F.lit(False))


def generic_sizes() -> F.Column:
    """The sizes of a document's generic chunks, as an aggregate over its blocks: for what is summed up of the same blocks anyway."""
    from docmill.operators.packing import groups

    kept = (F.col("status") == "keep") & (F.col("text") != "")
    b = F.array_sort(F.collect_list(F.when(kept, F.struct("block_idx", F.length("text").alias("n")))))
    return F.transform(groups(b, over_target, lambda g, x: F.lit(False)), lambda g: g["n"])
