"""Queries over the checks of cleaned documents (decorated ones), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import signals as S
from docmill.functions import text as T
from docmill.operators import blocks as B
from docmill.operators import quality as Q
from docmill.plans import catalogue as base
from docmill.plans import sql
from docmill.sources import decorated as D

TYPES = ["pdf_like", "markdown_note", "generic_block", "other"]


def _measured(spark, sf):
    return Q.measures(base._classified(spark, sf))


def _findings(spark, sf):
    return Q.findings(_measured(spark, sf), F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 4 + 1).cast("int")))


def qa_findings(spark, sf):
    """Findings of every document; source types, which set the coverage asked for, are dealt out by id."""
    return _findings(spark, sf).select("doc_id", "code", "gate", "strict", "amount")


def qa_gates(spark, sf):
    """Gates by status and by what to do next; every third document counts as reviewed."""
    found = _findings(spark, sf)
    documents = D.documents(spark, sf).select("doc_id")
    return Q.gates(documents, found, F.col("doc_id") % 3 == 0).groupBy("gate", "status", F.coalesce("action", F.lit("none")).alias("action")).agg(F.count("*").alias("docs"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))


def quality_loop(spark, sf):
    """State of each document's cleaning loop and its first finding."""
    found = _findings(spark, sf).groupBy("doc_id").agg(F.count_if("strict").alias("errors"), F.min_by("code", "place").alias("first_issue"))
    met = D.documents(spark, sf).select("doc_id").join(found, "doc_id", "left").fillna(0, ["errors"])
    return met.select("doc_id", Q.loop_state(F.col("errors"), F.col("doc_id") % 4 + 1, F.lit(3)).alias("state"), "errors", "first_issue")


def detail_retention(spark, sf):
    """Blocks that hold each kind of detail, by what became of them."""
    each, t = T.read(base._classified(spark, sf), "text")
    b = each.select("status", F.explode(Q.detail_categories(t, F.col("type"))).alias("category"))
    return b.groupBy("category").agg(F.count("*").alias("blocks"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("keep", "kept"), ("evidence", "evidence"), ("review", "review"), ("discard", "discarded"))])


def output_retention(spark, sf):
    """Code, tables and parameters of kept blocks that a rendered text lacks; every 17th block is left out of it, so that the check has something to find."""
    return Q.output_retention(base._classified(spark, sf), F.col("block_idx") % 17 != 3)


def missing_headings(spark, sf):
    """Headings that were lost on the way, where every seventh block was."""
    b = base._blocks(spark, sf).where("type = 'section_heading'")
    return Q.missing_headings(b, b.where("block_idx % 7 <> 0"))


def image_classify(spark, sf):
    """What images are for, from the lines about every reference to them and their headings."""
    lines = D.decorated_lines(D.documents(spark, sf))
    contexts = Q.image_contexts(lines)
    images = B.blockify(lines).where("type = 'image_evidence'").withColumn("src", F.regexp_extract("text", T.IMAGE, 2))
    heading = F.replace(F.coalesce("heading_path", F.lit("")), F.lit(" > "), F.lit(" "))
    said = F.concat(F.col("text"), F.lit(" "), F.coalesce("context", F.lit("")), F.lit(" "), heading)
    return images.join(contexts, ["doc_id", "src"], "left").select("doc_id", "block_idx", Q.image_class(said, heading).alias("c"), F.length(said).cast("long").alias("chars")).select("doc_id", "block_idx", "c.status", "c.kind", "chars")


_TYPE = "[" + ", ".join(f"'{x}'" for x in TYPES) + "][doc_id % 4 + 1]"
_IMAGE_ONLY = f"(regexp_matches(text, {sql.quoted(T.IMAGE)}) AND {sql.stripped(f'regexp_replace(text, {sql.quoted(T.IMAGE)}, {chr(39) * 2}, {chr(39)}g{chr(39)})')} = '')"
_COUNTED = f"(NOT {base._EXEMPT} AND NOT (type IN ('image_evidence', 'image_operation', 'diagram') AND {_IMAGE_ONLY}))"
_CATEGORY = {n: "(" + " OR ".join([*[f"type = '{t}'" for t, m in S.DETAIL_TYPES.items() if m == n], *([sql.matches("text", T.STEP_LINE, ""), sql.matches("text", T.EN_STEP_LINE)] if n == "operation_step" else []), *([sql.matches("text", S.DETAILS[n], "im")] if n in S.DETAILS else [])]) + ")" for n in [*S.DETAILS, "operation_step"]}
_STRICT = "(" + " OR ".join(_CATEGORY[n] for n in S.STRICT_DETAILS) + ")"
_POLLUTED = f"({sql.holds_lower('text', T.CTA)} OR {sql.matches('text', '|'.join(f'(?:{p})' for _, p in T.PROMO))})"
_ALLOWED = f"(protected OR type IN ('operation_step', 'case_step', 'tool_instruction', 'prompt', 'code', 'table') OR {sql.holds('text', T.KNOWLEDGE)})"
_LEVEL = lambda k: "CASE " + " ".join(f"WHEN st = '{n}' THEN {v[k]}" for n, v in S.COVERAGE.items()) + f" ELSE {S.COVERAGE_OTHER[k]} END"
_FINDINGS = f"""{base._CLASSIFIED}, {base._CHUNKS},
m0 AS (SELECT doc_id, count(*) FILTER (status = 'discard' AND protected) AS x0, count(*) FILTER (status = 'discard' AND type = 'operation_step') AS x1, count(*) FILTER (status = 'discard' AND type = 'code') AS x2, count(*) FILTER (status = 'discard' AND type = 'table') AS x3,
  count(*) FILTER (status = 'keep' AND {_POLLUTED} AND NOT {_ALLOWED}) AS x4, count(*) FILTER (status = 'keep' AND {sql.matches('text', r'!\[.*\]\(.*(?:qr|qrcode|二维码).*\)')}) AS x5, count(*) FILTER ({_COUNTED}) AS counted, count(*) FILTER ({_COUNTED} AND status = 'discard') AS lost,
  coalesce(sum(length(text)) FILTER ({_COUNTED} AND status = 'keep'), 0) AS kept, coalesce(sum(length(text)) FILTER ({_COUNTED}), 0) AS chars, count(*) FILTER (status = 'discard' AND {_STRICT}) AS x13 FROM classified GROUP BY doc_id),
m1 AS (SELECT m0.*, {_TYPE} AS st, lost::DOUBLE / greatest(counted, 1) AS ratio, CASE WHEN chars > 0 THEN kept::DOUBLE / chars ELSE 1 END AS cover, coalesce(sh, 0) AS x8, coalesce(lo, 0) AS x9 FROM m0 LEFT JOIN (SELECT doc_id, count(*) FILTER (char_count < 300) AS sh, count(*) FILTER (char_count > 3500) AS lo FROM chunks GROUP BY doc_id) USING (doc_id)),
f0 AS (SELECT doc_id, unnest([{', '.join(f"{{'place': {i}, 'code': '{c}', 'gate': '{g}', 'strict': {str(s).lower()}, 'amount': {a}}}" for i, ((c, g, s), a) in enumerate(zip(Q.CODES, [
    *[f"CASE WHEN x{k} > 0 THEN x{k}::DOUBLE END" for k in range(6)], "CASE WHEN ratio > 0.45 THEN ratio END", "CASE WHEN ratio > 0.25 AND ratio <= 0.45 THEN ratio END", "CASE WHEN x8 > 0 THEN x8::DOUBLE END", "CASE WHEN x9 > 0 THEN x9::DOUBLE END", "NULL::DOUBLE",
    f"CASE WHEN cover < {_LEVEL(1)} THEN cover END", f"CASE WHEN cover >= {_LEVEL(1)} AND cover < {_LEVEL(0)} THEN cover END", "CASE WHEN x13 > 0 THEN x13::DOUBLE END"])))}]) AS r FROM m1),
findings AS (SELECT doc_id, r.place, r.code, r.gate, r.strict, r.amount FROM f0 WHERE r.amount IS NOT NULL)"""
_SQUEEZE = lambda c: f"regexp_replace({c}, '\\s+', '', 'g')"
SQL = {
    "qa_findings": f"WITH RECURSIVE {_FINDINGS} SELECT doc_id, code, gate, strict, amount FROM findings",
    "qa_gates": f"""WITH RECURSIVE {_FINDINGS}, g AS (SELECT doc_id, gate, strict FROM findings UNION ALL SELECT doc_id, 'export_readiness', strict FROM findings WHERE strict AND gate <> 'export_readiness'),
e AS (SELECT d.doc_id, n.gate FROM documents d, {sql.values([(x,) for x in S.GATES], 'gate').replace(' AS v(gate)', ' AS n(gate)')}), c AS (SELECT e.doc_id, e.gate, count(*) FILTER (g.strict) AS errors, count(*) FILTER (NOT g.strict) AS warnings FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.gate = e.gate GROUP BY e.doc_id, e.gate)
SELECT gate, CASE WHEN errors > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' WHEN gate = 'review_safety' AND doc_id % 3 <> 0 THEN 'not_checked' ELSE 'pass' END AS status, CASE WHEN errors = 0 THEN 'none' {' '.join(f"WHEN gate = '{k}' THEN '{v}'" for k, v in S.NEXT_ACTIONS.items())} END AS action, count(*) AS docs, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings FROM c GROUP BY 1, 2, 3""",
    "quality_loop": f"WITH RECURSIVE {_FINDINGS}, f AS (SELECT doc_id, count(*) FILTER (strict) AS errors, arg_min(code, place) AS first_issue FROM findings GROUP BY doc_id) SELECT doc_id, CASE WHEN coalesce(errors, 0) = 0 THEN 'passed' WHEN doc_id % 4 + 1 >= 3 THEN 'iteration_limit_reached' ELSE 'needs_iteration' END AS state, coalesce(errors, 0) AS errors, first_issue FROM documents LEFT JOIN f USING (doc_id)",
    "detail_retention": f"WITH {base._CLASSIFIED}, c AS (SELECT status, unnest(list_filter([{', '.join(f'CASE WHEN {v} THEN {chr(39)}{k}{chr(39)} END' for k, v in _CATEGORY.items())}], lambda x: x IS NOT NULL)) AS category FROM classified) SELECT category, count(*) AS blocks, count(*) FILTER (status = 'keep') AS kept, count(*) FILTER (status = 'evidence') AS evidence, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'discard') AS discarded FROM c GROUP BY category",
    "output_retention": f"""WITH {base._CLASSIFIED}, r AS (SELECT doc_id, {_SQUEEZE("string_agg(text, chr(10) || chr(10) ORDER BY block_idx) FILTER (block_idx % 17 <> 3 AND status = 'keep')")} AS body FROM classified GROUP BY doc_id),
p AS (SELECT DISTINCT doc_id, lower({_SQUEEZE("regexp_replace(x, '[.,;:!?，。；：！？]+$', '')")}) AS x FROM (SELECT doc_id, unnest(regexp_extract_all(text, {sql.quoted('(?i)' + S.PARAMETER)})) AS x FROM classified WHERE status = 'keep')),
b AS (SELECT doc_id, count(*) FILTER (type = 'code') AS code, count(*) FILTER (type = 'code' AND NOT contains(coalesce(body, ''), {_SQUEEZE('text')})) AS code_missing, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (type = 'table' AND NOT contains(coalesce(body, ''), {_SQUEEZE('text')})) AS tables_missing FROM classified JOIN r USING (doc_id) WHERE status = 'keep' GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS parameters, count(*) FILTER (NOT contains(lower(coalesce(body, '')), x)) AS parameters_missing FROM p JOIN r USING (doc_id) GROUP BY doc_id)
SELECT r.doc_id, coalesce(code, 0) AS code, coalesce(code_missing, 0) AS code_missing, coalesce(tables, 0) AS tables, coalesce(tables_missing, 0) AS tables_missing, coalesce(parameters, 0) AS parameters, coalesce(parameters_missing, 0) AS parameters_missing FROM r LEFT JOIN b USING (doc_id) LEFT JOIN q USING (doc_id)""",
    "missing_headings": f"WITH {base._BLOCKS}, h AS (SELECT DISTINCT doc_id, block_idx % 7 <> 0 AS stays, lower(regexp_replace({sql.stripped("regexp_replace(text, '^#{1,6}\\s+', '')")}, '\\s+', ' ', 'g')) AS heading FROM blocks WHERE type = 'section_heading') SELECT DISTINCT doc_id, heading FROM h EXCEPT SELECT doc_id, heading FROM h WHERE stays",
    "image_classify": f"""WITH {base._BLOCKS}, near AS (SELECT doc_id, line_no, line, string_agg(nullif(s, ''), ' ') OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS said FROM k0),
ctx AS (SELECT doc_id, regexp_extract(line, {sql.quoted(T.IMAGE)}, 2) AS src, string_agg(coalesce(said, ''), ' ' ORDER BY line_no) AS context FROM near WHERE regexp_matches(line, {sql.quoted(T.IMAGE)}) GROUP BY 1, 2),
i AS (SELECT doc_id, block_idx, regexp_extract(text, {sql.quoted(T.IMAGE)}, 2) AS src, text, replace(coalesce(heading_path, ''), ' > ', ' ') AS heading FROM blocks WHERE type = 'image_evidence'), j AS (SELECT i.*, text || ' ' || coalesce(context, '') || ' ' || heading AS said FROM i LEFT JOIN ctx USING (doc_id, src)),
k AS (SELECT *, CASE WHEN {sql.stripped('said')} = '' THEN 6 WHEN {sql.matches('said', '|'.join(S.IMAGE_QR))} THEN 1 WHEN {sql.matches('said', '|'.join(S.IMAGE_PROOF))} THEN 2 WHEN {sql.matches('said', '|'.join(S.IMAGE_MARKETING))} THEN 3 WHEN {sql.matches('said', '|'.join(S.IMAGE_OPERATION))} OR {sql.matches('lower(heading)', '|'.join(S.IMAGE_EDUCATION))} THEN 4 WHEN length(said) > 100 THEN 5 ELSE 6 END AS c FROM j)
SELECT doc_id, block_idx, ['discard', 'evidence', 'evidence', 'keep', 'review', 'review'][c] AS status, ['qr_image', 'proof_screenshot', 'marketing_poster', 'operation_screenshot', 'unknown_review', 'unknown_image'][c] AS kind, length(said) AS chars FROM k""",
}


def queries():
    return {f.__name__: f for f in (qa_findings, qa_gates, quality_loop, detail_retention, output_retention, missing_headings, image_classify)}
