"""Queries over cleaning rules, patches and the patch gate.

Their input is decorated documents, all blocks kept, and one literal document whose blocks reach every outcome.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import blocks as B
from docmill.operators import cleaning as C
from docmill.plans import catalogue as base
from docmill.plans import sql
from docmill.sources import decorated as D

RULES = [
    *C.BASE, C.Rule("own.keep_this", "keep this", "protect", "literal"), C.Rule("own.junk", "learned junk", "discard", "literal", "user_feedback_discard", "private_rules"), C.Rule("own.odd", "odd off?er", "review"),
    C.Rule("own.source", r"^#+\s*source:", "discard", "regex", "report_source_wrapper_heading"), C.Rule("own.byline", r"^#+\s*by ", "review", "regex", "promotional_line"),
]
ACTIVE = [r.id for r in RULES if r.id != "base.promotional_line.english_qr_claim"]
#: (type, status, protected, text, heading_path)
CASES = [
    ("section_heading", "keep", False, "# Source: daily", "Source: daily"), ("section_heading", "keep", False, "# By someone", "By someone"), ("paragraph", "keep", False, "good line\nsign up for free today\n\nother line", "Part"),
    ("paragraph", "keep", False, "sign up for free\nclick here to claim", "Part"), ("code", "keep", True, "```\nsign up for free\n```", "Part"), ("paragraph", "keep", False, "please keep this: sign up for free", "Part"),
    ("paragraph", "keep", False, "free trial group now", "Part"), ("paragraph", "keep", False, "learned junk example", "Part"), ("paragraph", "keep", False, "an example: sign up for free", "Part"), ("paragraph", "keep", False, "an odd offer", "Part"),
    ("duplicate", "keep", False, "said twice", "Part"), ("paragraph", "keep", False, "scan the qr code to join", "Part"), ("paragraph", "discard", False, "sign up for free", "Part"), ("table", "keep", False, "free trial group here", "Part"),
    ("paragraph", "keep", False, "free trial group", "A tutorial"), ("paragraph", "keep", False, "odd offer\nclaim your free copy\nlearned junk", "Part"), ("operation_step", "keep", True, "1. sign up for free", "Part"), ("paragraph", "unclassified", False, "x $ free trial group", "Part"),
]
_SCHEMA = "doc_id long, block_idx long, block_id string, type string, status string, protected boolean, text string, heading_path string, risk_tags array<string>, rule_id string, rule_source string"
_ROWS = [(-1, i, f"b_{i:06d}", kind, status, safe, text, path, [], None, None) for i, (kind, status, safe, text, path) in enumerate(CASES)]


def before(spark, sf):
    found = B.blockify(D.decorated_lines(D.documents(spark, sf))).select(
        "doc_id", "block_idx", F.format_string("b_%06d", "block_idx").alias("block_id"), "type", F.lit("keep").alias("status"), "protected", "text", "heading_path", F.array().cast("array<string>").alias("risk_tags"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("rule_source"))
    return found.unionByName(spark.createDataFrame(_ROWS, _SCHEMA))


def _cleaned(spark, sf):
    return C.apply_rules(before(spark, sf), RULES)


def _judged(spark, sf):
    return C.judged(before(spark, sf), RULES, ACTIVE)


def _gated(spark, sf):
    return _judged(spark, sf).where("change_type IS NOT NULL")


def _shown(blocks):
    return blocks.select("doc_id", "block_id", "type", "status", "protected", F.sha2("text", 256).alias("text_sha256"), F.array_join("risk_tags", ",").alias("risk_tags"), F.coalesce("rule_id", F.lit("")).alias("rule_id"), F.coalesce("rule_source", F.lit("")).alias("rule_source"))


def clean_rules(spark, sf):
    """Blocks after the rules, with the lines split off as blocks of their own."""
    return _shown(_cleaned(spark, sf))


def clean_rules_scoped(spark, sf):
    """The same where only some nodes are asked for: what changes, by document."""
    now = C.judged(before(spark, sf), RULES, ACTIVE, target_nodes=["n_000004", "n_000012", "n_000016"])
    return now.where("change_type IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("patches"))


def clean_patches(spark, sf):
    """What cleaning changes, block by block, without texts."""
    return _gated(spark, sf).select("doc_id", "block_id", "parent_block_id", "change_type", "rule_id", "text_changed", F.col("before.status").alias("before_status"), F.col("after.status").alias("after_status"))


def clean_gate(spark, sf):
    """Patches by what the gate makes of them."""
    return _gated(spark, sf).groupBy("change_type", F.coalesce("rejected", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("patches"))


def patch_summary(spark, sf):
    """Accepted and rejected patches of each document, and its most frequent reason."""
    g = _gated(spark, sf).groupBy("doc_id", "rejected").agg(F.count("*").alias("n"))
    return g.groupBy("doc_id").agg(F.sum(F.when(F.col("rejected").isNull(), F.col("n")).otherwise(0)).alias("accepted"), F.sum(F.when(F.col("rejected").isNotNull(), F.col("n")).otherwise(0)).alias("rejected"), F.max(F.when(F.col("rejected").isNotNull(), F.struct("n", "rejected")))["rejected"].alias("top_reason"))


def restored_blocks(spark, sf):
    """Blocks after the gate: rejected changes undone."""
    return _shown(C.restored(_judged(spark, sf)))


def policy_hash(spark, sf):
    """Hash of the rules in force: sorted ids once each, by the order in which they decide."""
    first, rest = C.in_precedence(RULES)
    rows = spark.createDataFrame([(i, r.id, r.pattern, r.action, r.match) for i, r in enumerate([*first, *rest])], "place int, id string, pattern string, action string, match string")
    line = F.concat_ws("|", "id", "action", "match", "pattern")
    return rows.agg(F.count("*").alias("rules"), F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256).alias("rules_sha256"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), ","), 256).alias("order_sha256"))


_FIRST, _REST = C.in_precedence(RULES)


def _fit(rule, col: str) -> str:
    return sql.holds_lower(col, [rule.pattern]) if rule.match == "literal" else sql.matches(col, rule.pattern)


def _rule(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {_fit(r, col)} THEN '{r.id}'" for r in _FIRST) + f" WHEN {sql.holds(col, T.KNOWLEDGE)} THEN NULL " + " ".join(f"WHEN {_fit(r, col)} THEN '{r.id}'" for r in _REST) + " END"


_TUTORIAL = f"""({sql.holds_lower("replace(coalesce(heading_path, ''), ' > ', ' ')", T.TUTORIAL)} OR {sql.matches('body', T.STEP_LINE, 'm')} OR {sql.matches('body', T.EN_STEP_LINE, 'im')} OR contains(body, '```') OR contains(body, '$ ')
  OR {sql.holds('body', T.KNOWLEDGE)} OR length(body) > 200 OR {sql.holds_lower('body', [*T.TUTORIAL, *T.KNOWLEDGE])})"""


def _cleaned_sql(scope: str = "true") -> str:
    return f"""{base._BLOCKS},
rules AS (SELECT * FROM {sql.values([(r.id, r.action, r.risk_tag, r.source) for r in RULES], 'id, action, risk_tag, source')}),
was AS (SELECT doc_id, block_idx, 'b_' || lpad(block_idx::VARCHAR, 6, '0') AS block_id, type, 'keep' AS status, protected, text, heading_path FROM blocks UNION ALL SELECT doc_id, block_idx, block_id, type, status, protected, text, heading_path FROM {sql.values([r[:8] for r in _ROWS], 'doc_id, block_idx, block_id, type, status, protected, text, heading_path')}),
act AS (SELECT *, status NOT IN ('discard', 'evidence') AND ({scope}) AS active FROM was),
ln AS (SELECT doc_id, block_idx, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM act WHERE active AND contains(text, chr(10))),
ls AS (SELECT *, {sql.stripped('line')} AS s FROM ln),
lr AS (SELECT ls.*, r.id AS rid, r.risk_tag, r.source, s <> '' AND coalesce(r.action = 'discard', false) AS gone FROM (SELECT *, {_rule('s')} AS rr FROM ls) ls LEFT JOIN rules r ON r.id = rr),
sp AS (SELECT doc_id, block_idx, bool_or(gone) AS split_up, {sql.stripped("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone AND s <> ''), '')")} AS left_text FROM lr GROUP BY doc_id, block_idx),
q0 AS (SELECT act.*, coalesce(split_up, false) AS split_up, CASE WHEN split_up THEN left_text ELSE text END AS new_text FROM act LEFT JOIN sp USING (doc_id, block_idx)),
q1 AS (SELECT *, {sql.stripped('new_text')} AS body FROM q0),
q2 AS (SELECT q1.*, r.id AS mid, r.action AS mact, r.risk_tag AS mtag, r.source AS msrc FROM (SELECT *, CASE WHEN active THEN {_rule('body')} END AS rr FROM q1) q1 LEFT JOIN rules r ON r.id = rr),
q3 AS (SELECT *, CASE WHEN NOT active THEN 'none' WHEN split_up AND body = '' THEN 'all' WHEN protected THEN 'protected'
  WHEN (type = 'section_heading' AND mact <> 'protect' AND mtag IN ('report_author_byline_heading', 'report_source_wrapper_heading')) OR (type <> 'section_heading' AND mid IS NOT NULL) THEN mact
  WHEN type <> 'section_heading' AND {sql.holds_lower('body', T.CTA)} AND NOT {_TUTORIAL} THEN 'cta' WHEN type = 'duplicate' THEN 'duplicate' ELSE 'none' END AS k FROM q2),
now AS (SELECT doc_id, block_id, CASE WHEN k IN ('all', 'discard') THEN 'marketing_cta' ELSE type END AS type, CASE WHEN k IN ('all', 'discard', 'duplicate') THEN 'discard' WHEN k IN ('protected', 'protect') THEN 'keep' WHEN k IN ('review', 'cta') THEN 'review' ELSE status END AS status,
  k = 'protect' OR protected AS protected, new_text AS text, concat_ws(',', CASE WHEN split_up THEN 'promo_line_removed' END, CASE WHEN k IN ('discard', 'protect', 'review') THEN mtag WHEN k = 'cta' THEN 'possible_cta' END) AS risk_tags,
  CASE WHEN k IN ('discard', 'protect', 'review') THEN mid ELSE '' END AS rule_id, CASE WHEN k IN ('discard', 'protect', 'review') THEN msrc ELSE '' END AS rule_source FROM q3
  UNION ALL SELECT doc_id, 'b_' || lpad(block_idx::VARCHAR, 6, '0') || '_promo_' || lpad((row_number() OVER (PARTITION BY doc_id, block_idx ORDER BY n))::VARCHAR, 3, '0'), 'marketing_cta', 'discard', false, s, risk_tag, rid, source FROM lr WHERE gone),
patch AS (SELECT * FROM (SELECT n.doc_id, n.block_id, n.rule_id, n.status AS after_status, n.type AS after_type, n.protected AS after_protected, n.risk_tags, w.status AS before_status, w.type AS before_type, w.protected AS before_protected, w.block_id IS NULL AS derived, coalesce(w.text, '') <> n.text AS text_changed,
  CASE WHEN w.block_id IS NULL THEN 'derived_block' WHEN w.status <> n.status OR w.type <> n.type OR w.protected <> n.protected OR n.rule_id <> '' THEN 'status_update' WHEN w.text <> n.text THEN 'content_update' WHEN n.risk_tags <> '' THEN 'metadata_update' END AS change_type,
  CASE WHEN w.block_id IS NULL THEN regexp_replace(n.block_id, '_promo_[0-9]+$', '') ELSE '' END AS parent_block_id FROM now n LEFT JOIN was w USING (doc_id, block_id)) WHERE change_type IS NOT NULL)"""


_IDS = "(" + ", ".join(f"'{x}'" for x in ACTIVE) + ")"
_SAFE = "(protected OR type IN ('code', 'table', 'image', 'formula'))"
_GATED = f"""{_cleaned_sql()},
gate AS (SELECT p.*, CASE WHEN NOT coalesce(CASE WHEN rule_id <> '' THEN rule_id IN {_IDS} WHEN change_type = 'metadata_update' THEN true WHEN change_type = 'status_update' AND after_status = 'review' THEN contains(risk_tags, 'possible_cta')
    WHEN change_type = 'content_update' THEN contains(risk_tags, 'promo_line_removed') AND EXISTS (SELECT 1 FROM patch d WHERE d.doc_id = p.doc_id AND d.parent_block_id = p.block_id AND d.rule_id IN {_IDS}) ELSE false END, false) THEN 'rule_not_in_policy_snapshot'
  WHEN derived AND EXISTS (SELECT 1 FROM was w WHERE w.doc_id = p.doc_id AND w.block_id = p.parent_block_id AND {_SAFE}) THEN 'protected_structure_change'
  WHEN NOT derived AND (before_protected OR before_type IN ('code', 'table', 'image', 'formula')) AND (text_changed OR after_status <> 'keep' OR after_type <> before_type OR (before_protected AND NOT after_protected)) THEN 'protected_structure_change'
  WHEN before_type = 'section_heading' AND after_status = 'discard' THEN 'whole_section_deletion' END AS rejected FROM patch p)"""
_SHOWN = "doc_id, block_id, type, status, protected, sha256(text) AS text_sha256, risk_tags, rule_id, rule_source"
SQL = {
    "clean_rules": f"WITH {_cleaned_sql()} SELECT {_SHOWN} FROM now",
    "clean_rules_scoped": f"WITH {_cleaned_sql('block_idx IN (3, 11, 15)')} SELECT doc_id, count(*) AS patches FROM patch GROUP BY doc_id",
    "clean_patches": f"WITH {_cleaned_sql()} SELECT doc_id, block_id, parent_block_id, change_type, rule_id, text_changed, before_status, after_status FROM patch",
    "clean_gate": f"WITH {_GATED} SELECT change_type, coalesce(rejected, 'accepted') AS outcome, count(*) AS patches FROM gate GROUP BY 1, 2",
    "restored_blocks": f"WITH {_GATED}, bad AS (SELECT DISTINCT doc_id, block_id FROM gate WHERE rejected IS NOT NULL) SELECT {_SHOWN} FROM now ANTI JOIN bad USING (doc_id, block_id) UNION ALL SELECT doc_id, block_id, type, status, protected, sha256(text), '', '', '' FROM was SEMI JOIN bad USING (doc_id, block_id)",
    "policy_hash": f"""SELECT count(*) AS rules, sha256(string_agg(DISTINCT l, chr(10) ORDER BY l)) AS rules_sha256, sha256(string_agg(id, ',' ORDER BY place)) AS order_sha256 FROM (SELECT place, id, id || '|' || action || '|' || match || '|' || pattern AS l FROM {sql.values([(i, r.id, r.action, r.match, r.pattern) for i, r in enumerate([*_FIRST, *_REST])], 'place, id, action, match, pattern')})""",
}
SQL["patch_summary"] = f"""WITH {_GATED}, r AS (SELECT doc_id, rejected, count(*) AS n FROM gate GROUP BY doc_id, rejected)
SELECT doc_id, coalesce(sum(n) FILTER (rejected IS NULL), 0)::BIGINT AS accepted, coalesce(sum(n) FILTER (rejected IS NOT NULL), 0)::BIGINT AS rejected, arg_max(rejected, (n, rejected)) FILTER (rejected IS NOT NULL) AS top_reason FROM r GROUP BY doc_id"""


def queries():
    return {f.__name__: f for f in (clean_rules, clean_rules_scoped, clean_patches, clean_gate, patch_summary, restored_blocks, policy_hash)}
