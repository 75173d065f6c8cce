"""Queries over inventories, places of pieces, chapters, ledgers, envelopes and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import records as R
from docmill.plans import catalogue as base
from docmill.plans import quality, sql
from docmill.sources import decorated as D
from docmill.sources import intake as I

FOLDERS = ["a/", "", ".git/x/", "b/Node_Modules/", "build.md/", "c d/"]
EXTENSIONS = sorted(I.BY_EXTENSION) + [".PDF", ".xyz", ""]


def inventory(spark, sf):
    """A listing of made-up files, one for each document, without ignored folders."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    files = D.documents(spark, sf).select(F.concat(F.lit("/in/"), pick(FOLDERS), F.lit("doc-"), F.col("doc_id").cast("string"), pick(EXTENSIONS)).alias("path"))
    return R.inventory(files, "/in/")


def piece_places(spark, sf):
    """Where every third block of a document stands in the joined text, searched in order; some pieces stand nowhere."""
    b = base._blocks(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "text"))).alias("b"))
    texts = b.select("doc_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"), F.transform(F.filter("b", lambda x: x["block_idx"] % 3 == 0), lambda x: F.when(x["block_idx"] % 9 == 6, F.lit("nowhere to be found")).otherwise(x["text"])).alias("items"))
    return texts.select("doc_id", F.inline(R.found_in(F.col("text"), F.col("items")))).select("doc_id", F.col("item").cast("long"), F.col("at").cast("long").alias("place"))


def chapter_titles(spark, sf):
    """The chapter of every block."""
    return R.chapter_titles(base._blocks(spark, sf))


def safe_names(spark, sf):
    """Headings of decorated documents and first lines of raw ones as names of files."""
    first = D.documents(spark, sf).select("doc_id", F.concat(F.lit("?"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), F.when(F.col("doc_id") % 3 == 0, ' / "x" ').otherwise(" ..")).alias("title"))
    return first.select("doc_id", R.safe_name(F.col("title")).alias("name"))


def ledger(spark, sf):
    """Steps of the run of each document, of which some made nothing."""
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    runs = D.documents(spark, sf).select("doc_id", F.lit("direct").alias("route"), h.alias("converted"), F.when(F.col("doc_id") % 5 != 0, F.sha2(F.concat(h, F.lit("n")), 256)).alias("nodes"), F.when(F.col("doc_id") % 7 != 0, F.sha2(F.concat(h, F.lit("s")), 256)).alias("spans"))
    return R.ledger(runs)


def envelopes(spark, sf):
    """The result of each document's run as JSON, from its findings."""
    f = quality._findings(spark, sf)
    codes = lambda strict: F.transform(F.array_sort(F.collect_list(F.when(F.col("strict") == strict, F.struct("place", "code")))), lambda x: x["code"])
    g = f.groupBy("doc_id").agg(codes(True).alias("errors"), codes(False).alias("warnings"))
    none = F.array().cast("array<string>")
    return D.documents(spark, sf).select("doc_id").join(g, "doc_id", "left").select("doc_id", R.envelope(F.coalesce("errors", none), F.coalesce("warnings", none)).alias("envelope"))


_PICK = lambda xs: "[" + ", ".join(sql.quoted(x) for x in xs) + f"][doc_id % {len(xs)} + 1]"
_FORMATS = sql.values([(e, f) for e, f in I.BY_EXTENSION.items()], "e, f")
SQL = {
    "inventory": f"""WITH k AS (SELECT * FROM {_FORMATS}), d AS (SELECT {_PICK(FOLDERS)} AS folder, 'doc-' || doc_id AS name, {_PICK(EXTENSIONS)} AS x FROM documents), m AS (SELECT folder || name || x AS relative_path, lower(x) AS extension, coalesce(f, 'unknown') AS format FROM d LEFT JOIN k ON e = lower(x) WHERE folder NOT IN ('.git/x/', 'b/Node_Modules/')),
p AS (SELECT *, format NOT IN ('unknown', 'audio', 'video', 'remote_url') AND extension <> '.mobi' AS go FROM m)
SELECT relative_path, extension, format, CASE WHEN format IN ({', '.join(map(repr, R.HEAVY))}) THEN 'heavy' ELSE 'light' END AS weight, CASE WHEN go THEN 'process' ELSE 'skip' END AS action, CASE WHEN format IN ('audio', 'video') THEN 'media_binary_not_transcribed_in_v1' WHEN NOT go THEN 'unsupported_extension:' || CASE extension WHEN '' THEN '<none>' ELSE extension END ELSE '' END AS reason FROM p""",
    "piece_places": f"""WITH RECURSIVE {base._BLOCKS}, t AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY block_idx) AS body FROM blocks GROUP BY doc_id), i AS (SELECT doc_id, block_idx // 3 AS item, substr(CASE WHEN block_idx % 9 = 6 THEN 'nowhere to be found' ELSE text END, 1, 40) AS x FROM blocks WHERE block_idx % 3 = 0),
s AS (SELECT doc_id, 0::BIGINT AS nxt, body, 1::BIGINT AS pos, NULL::BIGINT AS item, NULL::BIGINT AS place FROM t UNION ALL
  SELECT doc_id, nxt + 1, body, CASE WHEN p > 0 THEN pos + p - 1 + length(x) ELSE pos END, CASE WHEN p > 0 THEN item2 END, CASE WHEN p > 0 THEN pos + p - 1 END FROM (SELECT s.doc_id, s.nxt, s.body, s.pos, i.item AS item2, i.x, instr(substr(s.body, s.pos), i.x) AS p FROM s JOIN i ON i.doc_id = s.doc_id AND i.item = s.nxt))
SELECT doc_id, item, place FROM s WHERE item IS NOT NULL""",
    "chapter_titles": f"WITH {base._BLOCKS} SELECT doc_id, block_idx, last_value(CASE WHEN type = 'section_heading' AND regexp_matches(text, '^#{{1,2}}\\s') THEN regexp_replace(text, '^#+\\s+', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_idx) AS chapter FROM blocks",
    "safe_names": f"""WITH t AS (SELECT doc_id, '?' || string_split(coalesce(text, ''), chr(10))[1] || CASE WHEN doc_id % 3 = 0 THEN ' / "x" ' ELSE ' ..' END AS title FROM documents), c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(title, {sql.quoted(r'[<>:"/\\|?*\x00-\x1f]+')}, '-', 'g'), '^[ ._-]+|[ ._-]+$', '', 'g'), '\\s+', ' ', 'g') AS clean FROM t)
SELECT doc_id, CASE WHEN clean = '' THEN '未命名知识' ELSE regexp_replace(substr(clean, 1, 60), '\\s+$', '') END AS name FROM c""",
    "ledger": """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), r AS (SELECT doc_id, 'direct' AS route, h AS converted, CASE WHEN doc_id % 5 <> 0 THEN sha256(h || 'n') END AS nodes, CASE WHEN doc_id % 7 <> 0 THEN sha256(h || 's') END AS spans FROM h),
e AS (SELECT doc_id, unnest([{'n': 1, 'stage': 'conversion', 'c': route}, {'n': 2, 'stage': 'converted_markdown_written', 'c': converted}, {'n': 3, 'stage': 'typed_nodes_artifact_written', 'c': nodes}, {'n': 4, 'stage': 'typed_nodes_artifact_validated', 'c': nodes}, {'n': 5, 'stage': 'source_spans_artifact_written', 'c': spans}, {'n': 6, 'stage': 'source_spans_artifact_validated', 'c': spans}]) AS s FROM r)
SELECT doc_id, s.n, s.stage, s.c IS NOT NULL AS ok, sha256(s.stage || '|' || coalesce(s.c, 'none')) AS detail FROM e""",
    "envelopes": f"""WITH RECURSIVE {quality._FINDINGS}, g AS (SELECT doc_id, coalesce(string_agg('"' || code || '"', ',' ORDER BY place) FILTER (strict), '') AS errors, coalesce(string_agg('"' || code || '"', ',' ORDER BY place) FILTER (NOT strict), '') AS warnings FROM findings GROUP BY doc_id), a AS (SELECT d.doc_id, coalesce(errors, '') AS errors, coalesce(warnings, '') AS warnings FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id)
SELECT doc_id, '{{"ok":' || (errors = '')::VARCHAR || ',"status":"' || CASE WHEN errors <> '' THEN 'failed' WHEN warnings <> '' THEN 'completed_with_warnings' ELSE 'completed' END || '","errors":[' || errors || '],"warnings":[' || warnings || ']}}' AS envelope FROM a""",
}


def queries():
    return {f.__name__: f for f in (inventory, piece_places, chapter_titles, safe_names, ledger, envelopes)}
