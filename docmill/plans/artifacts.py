"""Queries over clean views, gates, assets, chunk files and proposals, with their SQL; texts are those of decorated documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import artifacts as A
from docmill.operators import blocks as B
from docmill.operators import diagnosis as G
from docmill.plans import catalogue as base
from docmill.plans import cleaning, diagnosis, sql
from docmill.sources import decorated as D
from docmill.sources import intake as I


def clean_view(spark, sf):
    """Blocks in order of the nodes that they come from; every sixth node is gone."""
    b = base._blocks(spark, sf)
    nodes = b.where("block_idx % 6 <> 1").select("doc_id", F.format_string("n_%06d", F.col("block_idx") + 1).alias("node_id"), F.col("block_idx").alias("n"), "text")
    return A.clean_view(nodes, b.select("doc_id", "block_idx", "text"))


def _view_faults(spark, sf):
    b = base._blocks(spark, sf).select("doc_id", "block_idx", F.format_string("b_%06d", "block_idx").alias("block_id"))
    view = b.where("NOT (doc_id % 4 = 1 AND block_idx % 40 = 7)").unionByName(b.where("doc_id % 5 = 2 AND block_idx = 0")).unionByName(b.where("doc_id % 7 = 3 AND block_idx = 0").withColumn("block_id", F.lit("b_x")))
    return A.view_faults(view, b)


def view_coverage(spark, sf):
    """Whether views list every block once, where some blocks are left out, doubled or unknown."""
    return _view_faults(spark, sf)


def document_gate(spark, sf):
    """Whether documents may be published: by their view, their rejected patches and their text."""
    rejected = cleaning.patch_summary(spark, sf).select("doc_id", "rejected")
    rendered = D.documents(spark, sf).where("doc_id % 9 <> 4").select("doc_id")
    return A.document_gate(_view_faults(spark, sf), rejected, rendered)


def pre_clean_gate(spark, sf):
    """Whether converted texts are fit for cleaning."""
    m = diagnosis._texts(spark, sf).select("doc_id", F.length("text").cast("long").alias("chars"), G.text_measures(F.col("text"))["unreadable_text_ratio"].alias("unreadable_text_ratio"))
    return A.conversion_gate(m).select("doc_id", "chars", "status", "code")


def image_assets(spark, sf):
    """Image addresses of decorated documents and of a few literal ones against a listing."""
    lines = D.decorated_lines(D.documents(spark, sf)).where("line LIKE '%![%'").select("doc_id", F.concat("line", F.when(F.col("doc_id") % 2 == 0, "![[wiki one.png|x]] ![r](https://h/x.png) ![u](../up.png) ![s](<b c.png>)").otherwise("")).alias("text"))
    listing = spark.createDataFrame([("img/a.png",), ("wiki one.png",), ("../up.png",)], "src string")
    docs = lines.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    return A.image_assets(docs, listing)


#: addresses of videos and of other things
URLS = ["https://youtu.be/abc_DEF-1?t=3", "https://www.youtube.com/watch?v=xyz&list=1", "http://m.youtube.com/shorts/s1/x", "https://youtube.com/embed/e!1", "https://youtube.com/playlist?list=p", "https://example.org/watch?v=no", "ftp://youtu.be/x", "", "https://YOUTUBE.com/watch?a=b&v=up"]


def video_ids(spark, sf):
    """Ids in video addresses."""
    return spark.createDataFrame(list(enumerate(URLS)), "seq int, url string").select("seq", A.video_id(F.col("url")).alias("video_id"))


def chunk_files(spark, sf):
    """Kept text of documents as files with front matter, one file each."""
    kept = B.kept_blocks(base._classified(spark, sf), F.struct("block_idx", "text")).select("doc_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("body"))
    file = A.chunk_file(F.lit(1), F.col("body"), {"doc_id": F.col("doc_id"), "strategy": F.lit("generic"), "title": F.concat(F.lit('Part "'), F.col("doc_id"), F.lit('"'))})
    return kept.select("doc_id", F.length(file).cast("long").alias("chars"), F.sha2(file, 256).alias("file_sha256"))


#: (id, action, match, pattern, examples, counterexamples)
PROPOSALS = [
    (1, "discard", "literal", "join", ["join us now", "please join"], ["nothing"]), (2, "discard", "literal", "join", ["join us now", "join the group today"], ["join two tables", "how to join us now"]), (3, "discard", "literal", "x", ["no such thing"], []), (4, "discard", "regex", r"^\d+ offers?$", ["3 offers", "1 OFFER"], ["offers 3"]),
    (5, "protect", "literal", "keep", ["keep it"], ["keep"]), (6, "discard", "regex", "a.c", ["abc"], ["xaxc"]), (7, "discard", "literal", "Sale", [], ["on sale"])]


def proposal_checks(spark, sf):
    """Which proposals may be accepted, and what those that go too far could be narrowed to."""
    rows = spark.createDataFrame(PROPOSALS, "id long, action string, match string, pattern string, examples array<string>, counterexamples array<string>")
    return A.proposals(rows).select("id", "misses", "hits", "ok", "narrowed")


#: (id, action, pattern)
EFFECTS = [(1, "discard", "scan the qr code"), (2, "discard", "retry_count"), (3, "protect", "threshold"), (4, "protect", "no such words")]


def rule_effect(spark, sf):
    """Whether accepted rules had their effect on the cleaned texts."""
    texts = B.kept_blocks(base._classified(spark, sf), F.struct("block_idx", "text")).select(F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("body"))
    return A.rule_effect(spark.createDataFrame(EFFECTS, "id int, action string, pattern string"), texts)


def capability_matrix(spark, sf):
    """Every known extension with its format, route and whether this engine converts it itself."""
    rows = [(e, f, I.ROUTES.get(f, "unsupported")) for e, f in I.BY_EXTENSION.items()]
    return spark.createDataFrame(rows, "extension string, format string, route string").withColumn("status", F.when(F.col("route") == "unsupported", "unsupported").when(F.startswith("route", F.lit("external")), "external").otherwise("verified"))


def audit(spark, sf):
    """Blocks by status, and the first 50 discarded ones in order of document and block."""
    b = base._classified(spark, sf)
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("status") == "discard", F.struct("doc_id", "block_idx")))), 1, 50)
    per_doc = b.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("status") == "discard").alias("discarded"), F.count_if(F.col("status") == "evidence").alias("evidence"), first.alias("f"))
    return per_doc.select("doc_id", "blocks", "discarded", "evidence", F.array_join(F.transform("f", lambda x: x["block_idx"].cast("string")), ",").alias("first_discarded"))


_NORM = f"lower({sql.stripped("regexp_replace(regexp_replace(text, '(?m)^\\s*(?:#{1,6}|[-*+]|>)\\s+', '', 'g'), '\\s+', ' ', 'g')")})"
_VIEW = f"""{base._BLOCKS}, ids AS (SELECT doc_id, block_idx, 'b_' || lpad(block_idx::VARCHAR, 6, '0') AS block_id FROM blocks),
vw AS (SELECT doc_id, block_id FROM ids WHERE NOT (doc_id % 4 = 1 AND block_idx % 40 = 7) UNION ALL SELECT doc_id, block_id FROM ids WHERE doc_id % 5 = 2 AND block_idx = 0 UNION ALL SELECT doc_id, 'b_x' FROM ids WHERE doc_id % 7 = 3 AND block_idx = 0),
vt AS (SELECT doc_id, block_id, count(*) AS times FROM vw GROUP BY 1, 2), vf AS (SELECT doc_id, count(*) FILTER (times IS NULL) AS missing, count(*) FILTER (block_idx IS NULL) AS extra, count(*) FILTER (times > 1) AS repeated FROM vt FULL JOIN ids USING (doc_id, block_id) GROUP BY doc_id),
faults AS (SELECT doc_id, CASE WHEN repeated + missing + extra > 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN repeated > 0 THEN 'clean_view_inconsistent' WHEN missing + extra > 0 THEN 'clean_view_incomplete' ELSE 'clean_view_covers_blocks' END AS reason, missing, extra, repeated FROM vf)"""
_BODY = f"{base._CLASSIFIED}, r AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_idx) AS body FROM classified WHERE status = 'keep' AND text <> '' GROUP BY doc_id)"
SQL = {
    "clean_view": f"""WITH {base._BLOCKS}, b AS (SELECT doc_id, block_idx, {_NORM} AS norm FROM blocks), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY block_idx) AS k FROM b), n AS (SELECT doc_id, norm, block_idx AS n, row_number() OVER (PARTITION BY doc_id, norm ORDER BY block_idx) AS k FROM b WHERE block_idx % 6 <> 1 AND norm <> '')
SELECT doc_id, block_idx, CASE WHEN n IS NOT NULL THEN 'n_' || lpad((n + 1)::VARCHAR, 6, '0') END AS node_id, row_number() OVER (PARTITION BY doc_id ORDER BY n NULLS LAST, block_idx) AS ordinal FROM k LEFT JOIN n USING (doc_id, norm, k)""",
    "view_coverage": f"WITH {_VIEW} SELECT * FROM faults",
    "document_gate": f"WITH {_VIEW}, p AS ({cleaning.SQL['patch_summary']}) SELECT doc_id, s AS status, s = 'fail' AS blocks_publication FROM (SELECT f.doc_id, CASE WHEN f.status = 'fail' OR f.doc_id % 9 = 4 THEN 'fail' WHEN coalesce(p.rejected, 0) > 0 THEN 'warn' ELSE 'pass' END AS s FROM faults f LEFT JOIN p ON p.doc_id = f.doc_id)",
    "pre_clean_gate": f"WITH m AS ({diagnosis.SQL['text_measures']}), {diagnosis._TEXTS} SELECT t.doc_id, length(text) AS chars, CASE WHEN length(text) < 20 OR unreadable_text_ratio > 0.08 THEN 'fail' WHEN unreadable_text_ratio > 0.03 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN length(text) < 20 THEN 'E_CONVERTED_TEXT_TOO_SHORT' WHEN unreadable_text_ratio > 0.08 THEN 'E_CONVERTED_TEXT_UNREADABLE' WHEN unreadable_text_ratio > 0.03 THEN 'W_SOURCE_TEXT_LAYER' END AS code FROM t JOIN m ON m.doc_id = t.doc_id",
    "image_assets": f"WITH {D.LINES_SQL}, d AS (SELECT DISTINCT doc_id FROM lines WHERE contains(line, '![')) SELECT doc_id, 'img/a.png' AS src, 'copied' AS status FROM d UNION ALL SELECT doc_id, unnest(['wiki one.png', 'https://h/x.png', '../up.png', 'b']), unnest(['copied', 'remote', 'refused', 'missing']) FROM d WHERE doc_id % 2 = 0",
    "video_ids": f"""WITH u AS (SELECT seq, url, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM {sql.values(list(enumerate(URLS)), 'seq, url')})
SELECT seq, substr(regexp_replace(CASE WHEN host = 'youtu.be' THEN regexp_extract(path, '^/*([^/]*)', 1) WHEN host IN ('youtube.com', 'www.youtube.com', 'm.youtube.com') THEN CASE WHEN path = '/watch' THEN regexp_extract(url, '[?&]v=([^&#]*)', 1) ELSE regexp_extract(path, '^/(?:shorts|embed)/([^/?#]+)', 1) END ELSE '' END, '[^A-Za-z0-9_-]+', '', 'g'), 1, 64) AS video_id FROM u""",
    "chunk_files": f"""WITH {_BODY}, f AS (SELECT doc_id, '---' || chr(10) || 'chunk_id: c_0001' || chr(10) || 'doc_id: ' || doc_id || chr(10) || 'strategy: generic' || chr(10) || 'title: "Part \\"' || doc_id || '\\""' || chr(10) || '---' || chr(10) || chr(10) || body || chr(10) AS file FROM r) SELECT doc_id, length(file) AS chars, sha256(file) AS file_sha256 FROM f""",
    "proposal_checks": f"""WITH p AS (SELECT id, action, match, pattern, CAST(examples AS VARCHAR[]) AS ex, CAST(counter AS VARCHAR[]) AS cx FROM {sql.values(PROPOSALS, 'id, action, match, pattern, examples, counter')}), e AS (SELECT *, (SELECT count(*) FROM unnest(ex) AS t(x) WHERE NOT CASE WHEN match = 'literal' THEN contains(lower(x), lower(pattern)) ELSE regexp_matches(x, '(?i)' || pattern) END) AS misses, (SELECT count(*) FROM unnest(cx) AS t(x) WHERE CASE WHEN match = 'literal' THEN contains(lower(x), lower(pattern)) ELSE regexp_matches(x, '(?i)' || pattern) END) AS hits FROM p)
SELECT id, misses, hits, misses = 0 AND hits = 0 AS ok, CASE WHEN action = 'discard' AND hits > 0 AND match = 'literal' THEN (SELECT substr(arg_min(x, (length(x), x)), 1, 120) FROM unnest(ex) AS t(x) WHERE x <> pattern AND contains(lower(x), lower(pattern)) AND NOT EXISTS (SELECT 1 FROM unnest(cx) AS c(y) WHERE contains(lower(y), lower(x)))) END AS narrowed FROM e""",
    "rule_effect": f"WITH {_BODY}, e AS (SELECT * FROM {sql.values(EFFECTS, 'id, action, pattern')}), n AS (SELECT id, action, count(*) FILTER (contains(lower(body), pattern)) AS docs FROM e, r GROUP BY id, action) SELECT id, docs, CASE WHEN (action = 'discard' AND docs = 0) OR (action = 'protect' AND docs > 0) THEN 'passed' ELSE 'failed' END AS status FROM n",
    "capability_matrix": f"SELECT *, CASE WHEN route = 'unsupported' THEN 'unsupported' WHEN starts_with(route, 'external') THEN 'external' ELSE 'verified' END AS status FROM {sql.values([(e, f, I.ROUTES.get(f, 'unsupported')) for e, f in I.BY_EXTENSION.items()], 'extension, format, route')}",
    "audit": f"WITH {base._CLASSIFIED}, d AS (SELECT doc_id, block_idx, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS rn FROM classified WHERE status = 'discard'), f AS (SELECT doc_id, string_agg(block_idx, ',' ORDER BY block_idx) AS s FROM d WHERE rn <= 50 GROUP BY doc_id) SELECT c.doc_id, count(*) AS blocks, count(*) FILTER (status = 'discard') AS discarded, count(*) FILTER (status = 'evidence') AS evidence, coalesce(max(s), '') AS first_discarded FROM classified c LEFT JOIN f USING (doc_id) GROUP BY c.doc_id",
}


def queries():
    return {f.__name__: f for f in (clean_view, view_coverage, document_gate, pre_clean_gate, image_assets, video_ids, chunk_files, proposal_checks, rule_effect, capability_matrix, audit)}
