"""Queries over feedback, rule sets, batches and reviews, with their SQL.

Logs are derived from ``events`` and inventories from ``documents`` by fixed rules of the ids: the reference has no such tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import feedback as K
from docmill.plans import catalogue as base
from docmill.plans import sql
from docmill.sources import decorated as D

SCOPES = ["user", "document_type", "global", "source_pattern"]
_EVENTS = "event_id AS seq, 'type' || (user_id % 11) AS document_type, CASE WHEN event_id % 4 = 0 THEN 'protect' ELSE 'discard' END AS action, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'regex' END AS match, 'p' || (event_id % 13) AS pattern"
_SCOPE = f"element_at(array({', '.join(map(repr, SCOPES))}), cast(user_id % 11 % 4 + 1 AS int)) AS scope"


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def feedback_clusters(spark, sf):
    """Document types with enough accepted feedback; every ninth event rejects its pattern."""
    e = _events(spark, sf)
    return K.suggestions(e.where("event_id % 9 <> 0").selectExpr(*_split(_EVENTS), _SCOPE), e.where("event_id % 9 = 0").selectExpr(*_split(_EVENTS))).select("document_type", "scope", "items", F.col("least").cast("long").alias("least"))


def _split(columns: str) -> list[str]:
    """Columns of a list, at commas that no bracket holds."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


_HISTORY = "event_id AS seq, 'type' || (user_id % 7) AS document_type, event_id % 6 = 0 AS resolution, CASE event_id % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN NULL ELSE 'skipped' END AS status, event_id % 3 AS resolved, CASE WHEN event_id % 8 = 1 THEN 'reason ' || (event_id % 17) END AS reason"


def promotion_history(spark, sf):
    """Failed and unverified promotions by document type, and the state of the last one."""
    return K.promotions(_events(spark, sf).selectExpr(*_split(_HISTORY)))


#: (priority, place, kind, label, pattern)
RULES = [(10, 0, "word", "", "Scan"), (10, 1, "word", "", "join"), (20, 0, "word", "", "SCAN"), (20, 1, "word", "", "Free"), (25, 0, "pattern", "a", "x+"), (30, 0, "pattern", "b", "x+"), (30, 1, "pattern", "a", "x+"), (40, 0, "pattern", "a", "X+"), (40, 1, "word", "", "free"), (100, 0, "word", "", "late")]


def rule_union(spark, sf):
    """Rules of all routes, first come first kept."""
    return K.rule_union(spark.createDataFrame(RULES, "priority int, place int, kind string, label string, pattern string"))


def merge_promoted(spark, sf):
    """Rules in force and promoted ones that they lack; rules are parts by type and brand."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_type").alias("type"), F.col("p_brand").alias("pattern"), F.col("p_partkey").alias("id"))
    old = p.where("id % 3 = 0").groupBy("type", "pattern").agg(F.min("id").alias("id"))
    new = p.where("id % 3 <> 0").groupBy("type", "pattern").agg(F.min("id").alias("id"))
    return K.merged(old, new, ["type", "pattern"])


#: (id, status, scope, document_type, source_pattern)
PROPOSALS = [
    (1, "accepted", "user", None, None), (2, "rejected", "user", None, None), (3, "accepted", "document_type", "report", None), (4, "accepted", "document_type", "course", None), (5, "accepted", "source_pattern", None, "source_domain:example.org"),
    (6, "accepted", "source_pattern", None, "source_url:https://www.thering.example.org"), (7, "accepted", "source_pattern", None, ""), (8, "accepted", "document_type", None, None), (9, "accepted", "source_pattern", None, "page"), (10, "accepted", "source_pattern", None, "example.net")]


def _host(c):
    return F.regexp_extract(F.coalesce(c, F.lit("")), "^[a-zA-Z]+://([^/?#]*)", 1)


def accepted_rules(spark, sf):
    """How many pages each accepted proposal holds for; pages are reports and courses in turn, named by their number."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    identity = F.create_map(F.lit("source_url"), "url", F.lit("source_domain"), _host(F.col("url")), F.lit("source_name"), F.concat(F.lit("page-"), F.col("page_id"), F.lit(".html")))
    named = pages.select("page_id", identity.alias("identity"), F.when(F.col("page_id") % 2 == 0, "report").otherwise("course").alias("kind"))
    kinds = dict(zip(("id", "status", "scope", "document_type", "source_pattern"), ("long", "string", "string", "string", "string")))
    rules = F.array(*[F.struct(*[F.lit(v).cast(t).alias(k) for v, (k, t) in zip(r, kinds.items())]) for r in PROPOSALS])  # ten rules, typed in by a user
    held = K.accepted(named.select("page_id", "identity", "kind", F.inline(rules)), F.col("kind"), F.col("identity"))
    return held.groupBy("id").agg(F.count("*").alias("pages"))


_INVENTORY = "source AS batch, 'doc-' || doc_id || '.md' AS path, CASE WHEN doc_id % 13 = 0 THEN 'skip' ELSE 'process' END AS action"


def _items(spark, sf):
    d = D.documents(spark, sf).withColumn("source", F.coalesce("source", F.lit("none")))
    inventory = d.selectExpr(*_split(_INVENTORY))
    results = d.where("doc_id % 5 <> 0").selectExpr("source AS batch", "'doc-' || doc_id || '.md' AS path", "explode(array(0, 1)) AS seq", "doc_id").selectExpr("batch", "path", "seq", "(doc_id + seq) % 4 <> 0 AS ok", "cast(doc_id % 11 = 0 AS int) AS errors")
    failures = d.where("doc_id % 3 = 0").selectExpr("source AS batch", "'doc-' || doc_id || '.md' AS path", "0 AS seq", "'E_' || (doc_id % 4) AS reason")
    return K.manifest(inventory, results, failures)


def batch_manifest(spark, sf):
    """What became of every listed file."""
    return _items(spark, sf)


def batch_status(spark, sf):
    """State of each batch, and which files to run again."""
    return K.batch_status(_items(spark, sf))


def policy_affected(spark, sf):
    """Documents that a rerun selects: by id, by policy or by part of their identity."""
    d = D.documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("h"), F.col("doc_id") % 17).alias("policy"), F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("source"), F.coalesce("source", F.lit("")), F.lit("part"), (F.col("doc_id") % 3).cast("string")).alias("identity"))
    rows = [("7", None, None), (None, "h3", None), (None, "h99", None), (None, None, {"lang": "de", "part": "1"}), (None, None, {"lang": "de", "other": "x"}), (None, None, {})]
    return K.affected(d, spark.createDataFrame(rows, "s_id string, s_policy string, s_identity map<string,string>"))


def review_batches(spark, sf):
    """Blocks of each document in batches for review, every block twenty times its size, so that some documents need several."""
    return K.review_batches(base._blocks(spark, sf).select("doc_id", "block_idx", (F.length("text") * 20).alias("n")))


#: (op, path, value, kind of the value)
OPERATIONS = [
    ("replace", "/blocks/b_1/status", "keep", "string"), ("replace", "/blocks/b_1/status", "gone", "string"), ("remove", "/blocks/b_1/status", "", "null"), ("replace", None, "keep", "string"), ("replace", "/blocks/b_1", "keep", "string"), ("replace", "/nodes/b_1/status", "keep", "string"),
    ("replace", "/blocks/b_1/text", "x", "string"), ("add", "/blocks/b_1/risk_tags", "t", "string"), ("add", "/blocks/b_1/risk_tags", "[]", "strings"), ("replace", "/blocks/b_1/risk_tags", "[]", "strings"), ("replace", "/blocks/b_1/risk_tags", "t", "string"), ("add", "/blocks/b_1/status", "keep", "string"),
    ("replace", "/blocks/b_1/reason", "why", "string"), ("replace", "/blocks/b_1/reason", "1", "number"), ("replace", "/blocks/b_1/confidence", "0.5", "number"), ("replace", "/blocks/b_1/confidence", "1.5", "number"), ("replace", "/blocks/b_1/confidence", "0.5", "string"), ("replace", "blocks//b_1/status/", "review", "string")]


def review_operations(spark, sf):
    """Review operations with the reason why they may not stand."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(OPERATIONS)], "seq int, op string, path string, value string, kind string")
    return rows.select("seq", K.operation_fault().alias("fault"))


def apply_review(spark, sf):
    """Blocks after review: every fifth block is to be discarded, every seventh to be reviewed, some that are not there too."""
    b = base._classified(spark, sf).withColumn("block_id", F.format_string("b_%06d", "block_idx")).select("doc_id", "block_id", "block_idx", "type", "text", "protected")
    op = lambda where, seq, value, block_id="block_id": F.when(F.expr(where), F.struct(F.lit(seq).alias("seq"), F.expr(block_id).alias("block_id"), F.lit(value).alias("value")))
    said = F.array_compact(F.array(op("block_idx % 5 = 0", 0, "discard"), op("block_idx % 7 = 0", 1, "review"), op("block_idx = 0", 2, "keep", "'b_none'")))
    ops = b.select("doc_id", F.inline(said))
    return K.applied(b.drop("block_idx"), ops)


def cached_runs(spark, sf):
    """For each document the newest run of the same text, source and settings without errors; runs are documents in order of their ids."""
    d = D.documents(spark, sf).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.coalesce("source", F.lit("")).alias("source"), (F.col("doc_id") % 4 == 0).alias("errors"))
    runs = d.where("NOT errors").groupBy("h", "source").agg(F.max("doc_id").alias("run"))
    return d.join(runs, ["h", "source"], "left").select("doc_id", "run")


_KEYS = "document_type, action, coalesce(match, 'literal'), pattern"
_REACH = "CASE scope " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.REACH.items()) + " END"
_LEAST = "CASE scope " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.LEAST.items()) + " END"
_SCOPE_SQL = f"[{', '.join(map(repr, SCOPES))}][user_id % 11 % 4 + 1] AS scope"
_MANIFEST = f"""d AS (SELECT doc_id, coalesce(source, 'none') AS source FROM documents), items AS (SELECT source AS batch, 'doc-' || doc_id || '.md' AS path, CASE WHEN doc_id % 13 = 0 THEN 'skipped_unsupported' WHEN doc_id % 5 = 0 THEN 'pending' WHEN (doc_id + 1) % 4 <> 0 AND doc_id % 11 <> 0 THEN 'succeeded' ELSE 'failed' END AS status, doc_id FROM d)"""
_FAULT = f"""CASE WHEN op NOT IN ('replace', 'add') THEN 'unsupported op ' || op WHEN path IS NULL THEN 'path must be a string' WHEN len(p) <> 3 OR p[1] <> 'blocks' THEN 'invalid path ' || path WHEN p[3] NOT IN ('status', 'risk_tags', 'reason', 'confidence') THEN 'field ' || p[3] || ' is not allowed'
  WHEN p[3] = 'risk_tags' AND op = 'add' THEN CASE WHEN kind <> 'string' THEN 'risk_tags add value must be a string' END WHEN op <> 'replace' THEN 'add is not supported for field ' || p[3] WHEN p[3] = 'status' THEN CASE WHEN kind <> 'string' OR value NOT IN ('keep', 'discard', 'evidence', 'review') THEN 'invalid status ' || value END
  WHEN p[3] = 'risk_tags' THEN CASE WHEN kind <> 'strings' THEN 'risk_tags replace value must be a string array' END WHEN p[3] = 'reason' THEN CASE WHEN kind <> 'string' THEN 'reason must be a string' END ELSE CASE WHEN kind <> 'number' OR NOT coalesce(try_cast(value AS DOUBLE) BETWEEN 0 AND 1, false) THEN 'confidence must be a number between 0 and 1' END END"""
SQL = {
    "feedback_clusters": f"""WITH a AS (SELECT {_EVENTS}, {_SCOPE_SQL} FROM events WHERE event_id % 9 <> 0), r AS (SELECT DISTINCT {_KEYS} FROM (SELECT {_EVENTS} FROM events WHERE event_id % 9 = 0)),
o AS (SELECT document_type, action, m, pattern, arg_min(scope, seq) AS scope, min(seq) AS seq FROM (SELECT *, coalesce(match, 'literal') AS m FROM a WHERE action = 'discard' AND ({_KEYS}) NOT IN (SELECT * FROM r)) GROUP BY 1, 2, 3, 4),
g AS (SELECT document_type, arg_max(scope, ({_REACH}, -seq)) AS scope, count(*) AS items FROM o GROUP BY document_type) SELECT document_type, scope, items, ({_LEAST})::BIGINT AS least FROM g WHERE items >= {_LEAST}""",
    "promotion_history": f"""WITH h AS (SELECT {_HISTORY} FROM events), s AS (SELECT *, coalesce(status, 'unknown') AS st FROM h), g AS (SELECT document_type, count(*) FILTER (NOT resolution AND st = 'failed') AS failed, coalesce(sum(CASE WHEN resolved > 0 THEN resolved ELSE 1 END) FILTER (resolution AND st = 'passed'), 0) AS solved,
  count(*) FILTER (st <> 'passed' AND (resolution OR st <> 'failed')) AS unverified, arg_max(CASE WHEN resolution THEN CASE WHEN st = 'passed' THEN 'resolved' ELSE 'resolution_failed' END ELSE st END, seq) AS latest, arg_max(reason, seq) FILTER (reason IS NOT NULL) AS reason FROM s GROUP BY document_type)
SELECT document_type, greatest(failed - solved, 0)::BIGINT AS unresolved, unverified, latest, CASE WHEN latest <> 'resolved' THEN reason END AS last_reason FROM g""",
    "rule_union": f"SELECT priority, place, kind, label, pattern FROM {sql.values(RULES, 'priority, place, kind, label, pattern')} QUALIFY row_number() OVER (PARTITION BY kind, CASE WHEN kind = 'word' THEN lower(pattern) ELSE label || chr(1) || pattern END ORDER BY priority, place) = 1",
    "merge_promoted": "WITH o AS (SELECT p_type AS type, p_brand AS pattern, min(p_partkey) AS id FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2), n AS (SELECT p_type AS type, p_brand AS pattern, min(p_partkey) AS id FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2) SELECT * FROM o UNION ALL SELECT * FROM n ANTI JOIN o USING (type, pattern)",
    "accepted_rules": f"""WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS u, lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://([^/?#]*)', 1)) AS h, page_id % 2 = 0 AS report FROM pages), c AS (SELECT *, 'page-' || page_id || '.html' AS name, h = 'example.org' OR ends_with(h, '.example.org') AS d5, u = 'https://www.thering.example.org' OR (starts_with(u, 'https://www.thering.example.org') AND substr(u, 32, 1) IN ('/', '?', '#', '&')) AS d6, h = 'example.net' OR ends_with(h, '.example.net') AS d10 FROM p),
x AS (SELECT unnest([1, CASE WHEN report THEN 3 END, CASE WHEN NOT report THEN 4 END, CASE WHEN d5 THEN 5 END, CASE WHEN d6 THEN 6 END, 8, 9, CASE WHEN d10 THEN 10 END]) AS id FROM c) SELECT id::BIGINT AS id, count(*) AS pages FROM x WHERE id IS NOT NULL GROUP BY 1""",
    "batch_manifest": f"WITH {_MANIFEST} SELECT batch, path, status, CASE status WHEN 'failed' THEN CASE WHEN doc_id % 3 = 0 THEN 'E_' || (doc_id % 4) ELSE 'failed' END WHEN 'pending' THEN 'blocked_before_processing' ELSE '' END AS reason FROM items",
    "batch_status": f"""WITH {_MANIFEST}, g AS (SELECT batch, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'skipped_unsupported') AS skipped FROM items GROUP BY batch)
SELECT *, CASE WHEN failed > 0 AND succeeded = 0 THEN 'failed' WHEN failed + pending + skipped > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status, CASE WHEN failed > 0 AND pending > 0 THEN 'failed_and_pending' WHEN failed > 0 THEN 'failed_only' WHEN pending > 0 THEN 'pending_only' ELSE 'none' END AS scope FROM g""",
    "policy_affected": "SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id = 7 OR doc_id % 17 = 3 OR (lang = 'de' AND doc_id % 3 = 1)",
    "review_batches": f"""WITH RECURSIVE {base._BLOCKS}, b AS (SELECT doc_id, length(text) * 20 + 100 AS n, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS rn, CASE WHEN sum(length(text) * 20 + 100) OVER (PARTITION BY doc_id) <= 80000 THEN 4611686018427387904 ELSE 60000 END AS most FROM blocks),
p AS (SELECT doc_id, rn, n AS size, 0 AS batch FROM b WHERE rn = 1 UNION ALL SELECT b.doc_id, b.rn, CASE WHEN p.size + b.n > b.most THEN b.n ELSE p.size + b.n END, CASE WHEN p.size + b.n > b.most THEN p.batch + 1 ELSE p.batch END FROM p JOIN b ON b.doc_id = p.doc_id AND b.rn = p.rn + 1)
SELECT doc_id, batch::BIGINT AS batch, count(*) AS blocks, max(size)::BIGINT AS chars FROM p GROUP BY doc_id, batch""",
    "review_operations": f"WITH o AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM {sql.values([(i, *r) for i, r in enumerate(OPERATIONS)], 'seq, op, path, value, kind')}) SELECT seq, {_FAULT} AS fault FROM o",
    "cached_runs": "SELECT d.doc_id, max(r.doc_id) AS run FROM documents d LEFT JOIN documents r ON coalesce(r.text, '') = coalesce(d.text, '') AND coalesce(r.source, '') = coalesce(d.source, '') AND r.doc_id % 4 <> 0 GROUP BY d.doc_id",
}


def _review_sql() -> str:
    from docmill.plans import quality

    held = "(" + " OR ".join(quality._CATEGORY.values()) + ")"
    fault = f"CASE WHEN {held} THEN 'cannot discard detail-bearing block' WHEN type IN ('code', 'table', 'image', 'formula') THEN 'cannot discard protected type' WHEN protected THEN 'cannot discard protected block' END"
    return f"""WITH {base._CLASSIFIED}, b AS (SELECT doc_id, block_idx, 'b_' || lpad(block_idx::VARCHAR, 6, '0') AS block_id, {fault} AS f FROM classified),
o AS (SELECT doc_id, block_id, 0 AS seq, 'discard' AS value, f AS fault FROM b WHERE block_idx % 5 = 0 UNION ALL SELECT doc_id, block_id, 1, 'review', NULL FROM b WHERE block_idx % 7 = 0 UNION ALL SELECT doc_id, 'b_none', 2, 'keep', 'block not found' FROM b WHERE block_idx = 0)
SELECT doc_id, block_id, arg_max(value, seq) FILTER (fault IS NULL) AS new_status, count(fault) AS rejected, min(fault) AS fault FROM o GROUP BY doc_id, block_id"""


SQL["apply_review"] = _review_sql()


def queries():
    return {f.__name__: f for f in (feedback_clusters, promotion_history, rule_union, merge_promoted, accepted_rules, batch_manifest, batch_status, policy_affected, review_batches, review_operations, apply_review, cached_runs)}
