"""Cleaning rules over blocks, the patches they make, and the gate that takes unsafe ones back.

Blocks are (doc_id, block_idx, block_id, type, status, protected, text, heading_path, risk_tags, rule_id, rule_source).
Rules compile into one expression in their order of precedence; lines that move out of a block become rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T

PROTECTED_TYPES = ("code", "table", "image", "formula")
#: Tags of rules that may take a heading away.
HEADING_TAGS = ("report_author_byline_heading", "report_source_wrapper_heading")
FIELDS = ("status", "type", "protected", "risk_tags", "rule_id", "rule_source")
RULE = "struct<id:string,action:string,risk_tag:string,source:string>"
#: Ends of lines, as a text splits into lines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@dataclass(frozen=True)
class Rule:
    """A promotional-line rule: what it matches, and whether it discards, protects or asks for review."""

    id: str
    pattern: str
    action: str = "discard"
    match: str = "regex"
    risk_tag: str = "promotional_line"
    source: str = "rules/base"

    @property
    def confirmed(self) -> bool:
        return self.risk_tag.startswith(("user_feedback_", "learned_feedback_"))


BASE = [Rule(f"base.promotional_line.{name}", pattern) for name, pattern in T.PROMO]


def rule_fits(rule: Rule, line: Column | T.Read) -> Column:
    """Literal rules look for their words in any case, others for their pattern."""
    return F.contains(line.low if isinstance(line, T.Read) else F.lower(line), F.lit(rule.pattern.lower())) if rule.match == "literal" else T.matches(line, rule.pattern)


def in_precedence(rules: list[Rule]) -> tuple[list[Rule], list[Rule]]:
    """Rules that hold anywhere (protecting ones, then those that feedback confirmed), and those that knowledge terms stop."""
    return [r for r in rules if r.action == "protect"] + [r for r in rules if r.action != "protect" and r.confirmed], [r for r in rules if r.action != "protect" and not r.confirmed]


def matched_rule(line: Column | T.Read, rules: list[Rule], knows: Column) -> Column:
    """struct(id, action, risk_tag, source) of the rule that decides about a line, or null; ``knows``: whether it holds a knowledge term."""
    none = F.lit(None).cast(RULE)
    value = lambda r: F.struct(*[F.lit(x).alias(n) for n, x in (("id", r.id), ("action", r.action), ("risk_tag", r.risk_tag), ("source", r.source))]).cast(RULE)
    first, rest = in_precedence(rules)
    chain = F
    for r in first:
        chain = chain.when(rule_fits(r, line), value(r))
    chain = chain.when(knows, none)
    for r in rest:
        chain = chain.when(rule_fits(r, line), value(r))
    return chain.otherwise(none)


def tutorial_context(t: T.Read, heading_path: Column, knows: Column) -> Column:
    """Whether a call to action stands in teaching text: under such a heading, beside steps, code or knowledge, or in a long block."""
    text, heading = t.text, F.lower(F.replace(F.coalesce(heading_path, F.lit("")), F.lit(" > "), F.lit(" ")))
    step = T.matches(text, T.STEP_LINE, "Um") | T.matches(t, T.EN_STEP_LINE, "iuUm")
    return T.one_of(heading, T.TUTORIAL, True) | step | F.contains(text, F.lit("```")) | F.contains(text, F.lit("$ ")) | knows | (F.length(text) > 200) | T.one_of(text, [*T.TUTORIAL, *T.KNOWLEDGE], True)


def node_id(block_idx: Column) -> Column:
    return F.format_string("n_%06d", block_idx + 1)


def ruled(blocks: DataFrame, rules: list[Rule], target_nodes: list[str] | None = None) -> DataFrame:
    """Every block with ``made``, what the rules make of it: the block itself first, then the lines that they take out of it."""
    tags = "array<string>"
    active = ~F.col("status").isin("discard", "evidence")
    if target_nodes:
        active = active & node_id(F.col("block_idx")).isin(target_nodes)
    lines = F.transform(F.split("text", LINE_END, -1), lambda x: F.struct(x.alias("line"), T.stripped(x).alias("s")))
    judged_lines = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["s"].alias("s"), matched_rule(x["s"], rules, T.one_of(x["s"], T.KNOWLEDGE)).alias("rule")))
    told = blocks.withColumn("active", active).withColumn("lines", F.when(F.col("active") & F.contains("text", F.lit("\n")), judged_lines))
    gone = lambda x: (x["s"] != "") & F.coalesce(x["rule"]["action"] == "discard", F.lit(False))
    split = told.withColumn("promo", F.coalesce(F.filter("lines", gone), F.array().cast(f"array<struct<line:string,s:string,rule:{RULE}>>")))
    left = T.stripped(F.array_join(F.transform(F.filter("lines", lambda x: ~gone(x) & (x["s"] != "")), lambda x: x["line"]), "\n"))
    some = F.size("promo") > 0
    changed = split.withColumns({"new_text": F.when(some, left).otherwise(F.col("text")), "new_tags": F.when(some, F.array_union("risk_tags", F.array(F.lit("promo_line_removed")))).otherwise(F.col("risk_tags"))})
    read, body = T.read(changed.withColumn("body", T.trimmed(F.col("new_text"))), "body", "body_")
    judged = read.withColumn("knows", T.holds_any(body, T.KNOWLEDGE)).withColumn("m", F.when(F.col("active"), matched_rule(body, rules, F.col("knows"))))
    heading = F.col("type") == "section_heading"
    applies = F.when(heading, (F.col("m.action") != "protect") & F.col("m.risk_tag").isin(*HEADING_TAGS)).otherwise(F.col("m.id").isNotNull())
    asks = ~heading & T.contains_any(body, T.CTA) & ~tutorial_context(body, F.col("heading_path"), F.col("knows"))
    kind = F.when(~F.col("active"), "none").when(some & (body.text == ""), "all").when(F.col("protected"), "protected").when(F.coalesce(applies, F.lit(False)), F.col("m.action")).when(asks, "cta").when(F.col("type") == "duplicate", "duplicate").otherwise("none")
    done = judged.withColumn("k", kind)
    by_rule = F.col("k").isin("discard", "protect", "review")
    whole = F.struct(
        F.col("block_id").alias("block_id"),
        F.when(F.col("k").isin("all", "discard"), "marketing_cta").otherwise(F.col("type")).alias("type"),
        F.when(F.col("k").isin("all", "discard", "duplicate"), "discard").when(F.col("k").isin("protected", "protect"), "keep").when(F.col("k").isin("review", "cta"), "review").otherwise(F.col("status")).alias("status"),
        ((F.col("k") == "protect") | F.col("protected")).alias("protected"), F.col("new_text").alias("text"),
        F.when(by_rule, F.array_union("new_tags", F.array("m.risk_tag"))).when(F.col("k") == "cta", F.array_union("new_tags", F.array(F.lit("possible_cta")))).otherwise(F.col("new_tags")).cast(tags).alias("risk_tags"),
        F.when(by_rule, F.col("m.id")).otherwise(F.col("rule_id")).alias("rule_id"), F.when(by_rule, F.col("m.source")).otherwise(F.col("rule_source")).alias("rule_source"))
    derived = F.transform("promo", lambda x, n: F.struct(
        F.format_string("%s_promo_%03d", F.col("block_id"), n + 1).alias("block_id"), F.lit("marketing_cta").alias("type"), F.lit("discard").alias("status"), F.lit(False).alias("protected"), x["s"].alias("text"),
        F.array(x["rule"]["risk_tag"]).cast(tags).alias("risk_tags"), x["rule"]["id"].alias("rule_id"), x["rule"]["source"].alias("rule_source")))
    return done.select(*blocks.columns, F.concat(F.array(whole), derived).alias("made"))


def apply_rules(blocks: DataFrame, rules: list[Rule], target_nodes: list[str] | None = None) -> DataFrame:
    """Blocks after the rules; lines that a discarding rule takes out of a longer block are derived blocks.

    With ``target_nodes`` only the blocks of these node ids are looked at.
    """
    each = ruled(blocks, rules, target_nodes).select("doc_id", "block_idx", "heading_path", F.explode_outer("made").alias("x"))
    return each.select("doc_id", "block_idx", "x.block_id", "x.type", "x.status", "x.protected", "x.text", "heading_path", "x.risk_tags", "x.rule_id", "x.rule_source")


def parent_of(block_id: Column) -> Column:
    return F.regexp_replace(block_id, r"_promo_\d+$", "")


def _change(met: DataFrame, policy: str) -> DataFrame:
    """``met`` (block_id, before, after, was_text, now_text) with change_type, null where nothing changes, and what identifies the patch."""
    differs = lambda names: ~F.struct(*[F.col(f"before.{n}") for n in names]).eqNullSafe(F.struct(*[F.col(f"after.{n}") for n in names]))
    text_changed = ~F.coalesce("was_text", F.lit("")).eqNullSafe(F.col("now_text"))
    told = met.withColumn("text_changed", text_changed)
    change = F.when(F.col("before").isNull(), "derived_block").when(differs(["status", "type", "protected", "rule_id", "rule_source"]), "status_update").when(F.col("text_changed"), "content_update").when(differs(list(FIELDS)), "metadata_update")
    found = told.withColumns({"change_type": change, "rule": F.coalesce("after.rule_id", F.lit(""))})
    shown = lambda c: F.concat_ws("|", *[F.col(f"{c}.{n}").cast("string") if n != "risk_tags" else F.array_join(f"{c}.{n}", ",") for n in FIELDS])
    key = F.sha2(F.concat_ws("\n", F.lit(policy), "block_id", "change_type", "rule", shown("before"), shown("after"), F.col("text_changed").cast("string")), 256)
    return found.withColumns({"parent_block_id": F.when(F.col("change_type") == "derived_block", parent_of(F.col("block_id"))).otherwise(""), "patch_id": F.when(F.col("change_type").isNotNull(), F.substring(key, 1, 16))})


PATCH = ("doc_id", "block_id", "change_type", "rule_id", "before", "after", "text_changed", "parent_block_id", "patch_id")


def build_patches(before: DataFrame, after: DataFrame, policy: str = "") -> DataFrame:
    """One row for each block that differs after cleaning, without any of its text; new blocks are derived ones."""
    was = before.select("doc_id", "block_id", F.struct(*FIELDS).alias("before"), F.col("text").alias("was_text"))
    now = after.select("doc_id", "block_id", F.struct(*FIELDS).alias("after"), F.col("text").alias("now_text"))
    return _change(now.join(was, ["doc_id", "block_id"], "left"), policy).withColumnRenamed("rule", "rule_id").where("change_type IS NOT NULL").select(*PATCH)


def judged(blocks: DataFrame, rules: list[Rule], active: list[str], policy: str = "", target_nodes: list[str] | None = None) -> DataFrame:
    """Blocks after the rules with their patches and why they may not stand, all in one pass over blocks with ids of their own.

    (doc_id, block_idx, heading_path, derived, was_text, now_text, and the columns of a patch and ``rejected``): change_type is null
    where nothing changes. What :func:`build_patches` and :func:`gate_patches` look up in other rows is at hand in the block that they
    come from: the block as it was, the parent of a derived one, and whether a derived one backs a change of text.
    """
    made = ruled(blocks, rules, target_nodes)
    backed = F.exists(F.slice("made", 2, 1 << 30), lambda x: F.coalesce(x["rule_id"].isin(active), F.lit(False)))
    # outer: else a filter on the array is pushed below what makes it and evaluates all of that anew
    each = made.select("doc_id", "block_idx", "heading_path", "text", F.struct(*FIELDS).alias("own"), backed.alias("backed"), F.posexplode_outer("made").alias("n", "x"))
    met = each.select("doc_id", "block_idx", "heading_path", "own", "backed", (F.col("n") > 0).alias("derived"), F.when(F.col("n") == 0, F.col("text")).alias("was_text"), F.when(F.col("n") == 0, F.col("own")).alias("before"), F.struct(*[F.col(f"x.{n}").alias(n) for n in FIELDS]).alias("after"), F.col("x.block_id").alias("block_id"), F.col("x.text").alias("now_text"))
    told = _change(met, policy).withColumnRenamed("rule", "rule_id")
    none, kind, safe = F.lit(None), F.col("own.type"), F.col("own.protected")
    own = lambda c, derived: F.when(F.col("derived") == derived, c).otherwise(none)
    reason = _fault(F.lit(True), F.col("backed"), own(kind, False), own(safe, False), own(kind, True), own(safe, True), active)
    return told.withColumn("rejected", F.when(F.col("change_type").isNotNull(), reason)).select("block_idx", "heading_path", "derived", "was_text", "now_text", *PATCH, "rejected")


def restored(judged_blocks: DataFrame) -> DataFrame:
    """Blocks of :func:`judged` with every rejected change undone."""
    back = F.col("rejected").isNotNull()
    pick = lambda n: F.when(back, F.col(f"before.{n}")).otherwise(F.col(f"after.{n}")).alias(n)
    return judged_blocks.where("rejected IS NULL OR NOT derived").select("doc_id", "block_idx", "block_id", pick("type"), pick("status"), pick("protected"), F.when(back, F.col("was_text")).otherwise(F.col("now_text")).alias("text"), "heading_path", pick("risk_tags"), pick("rule_id"), pick("rule_source"))


def _fault(cleaned: Column, backed: Column, b_type: Column, b_protected: Column, p_type: Column, p_protected: Column, active: list[str]) -> Column:
    """Why a patch may not stand: ``b_``: the block as it was, ``p_``: the parent of a derived one; null where they are not there."""
    allowed = F.col("rule_id").isin(active)
    derived = F.col("change_type") == "derived_block"
    evidence = F.when(F.col("rule_id") != "", allowed).when(F.col("change_type") == "metadata_update", True).when(
        (F.col("change_type") == "status_update") & (F.col("after.status") == "review"), F.array_contains("after.risk_tags", "possible_cta")).when(
        F.col("change_type") == "content_update", F.array_contains("after.risk_tags", "promo_line_removed") & F.coalesce(backed, F.lit(False))).otherwise(False)
    guarded = lambda safe, kind: F.coalesce(safe | kind.isin(*PROTECTED_TYPES), F.lit(False))
    changed = F.col("text_changed") | (F.col("after.status") != "keep") | (F.col("after.type") != b_type) | (b_protected & ~F.col("after.protected"))
    return F.when(F.col("patch_id").isNull() | (F.col("patch_id") == ""), "missing_evidence").when(cleaned.isNull() | (~derived & b_type.isNull()), "missing_target_node").when(~F.coalesce(evidence, F.lit(False)), "rule_not_in_policy_snapshot").when(
        derived & guarded(p_protected, p_type), "protected_structure_change").when(guarded(b_protected, b_type) & changed, "protected_structure_change").when((b_type == "section_heading") & (F.col("after.status") == "discard"), "whole_section_deletion")


def gate_patches(patches: DataFrame, before: DataFrame, cleaned: DataFrame, active: list[str]) -> DataFrame:
    """Patches with the reason why they may not stand, null where they may."""
    allowed = F.col("rule_id").isin(active)
    was = before.select("doc_id", "block_id", F.col("type").alias("b_type"), F.col("protected").alias("b_protected"))
    parents = was.select("doc_id", F.col("block_id").alias("parent_block_id"), F.col("b_type").alias("p_type"), F.col("b_protected").alias("p_protected"))
    backed = patches.where((F.col("change_type") == "derived_block") & allowed).select("doc_id", F.col("parent_block_id").alias("block_id"), F.lit(True).alias("backed")).distinct()
    known = cleaned.select("doc_id", "block_id", F.lit(True).alias("cleaned")).distinct()
    met = patches.join(known, ["doc_id", "block_id"], "left").join(was, ["doc_id", "block_id"], "left").join(backed, ["doc_id", "block_id"], "left").join(parents, ["doc_id", "parent_block_id"], "left")
    reason = _fault(F.col("cleaned"), F.col("backed"), F.col("b_type"), F.col("b_protected"), F.col("p_type"), F.col("p_protected"), active)
    return met.select(*patches.columns, reason.alias("rejected"))


def restore(cleaned: DataFrame, before: DataFrame, gated: DataFrame) -> DataFrame:
    """Cleaned blocks with every rejected change undone: the block as it was, or none if it was not there."""
    bad = gated.where("rejected IS NOT NULL").select("doc_id", "block_id").distinct()
    return cleaned.join(bad, ["doc_id", "block_id"], "left_anti").unionByName(before.select(*cleaned.columns).join(bad, ["doc_id", "block_id"], "left_semi"))
