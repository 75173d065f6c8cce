"""Queries over structure: relations, cues, chunks by layout, and the joins of nodes with what they come from; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.operators import blocks as B
from docmill.operators import joins as J
from docmill.operators import packing as P
from docmill.operators import structure as U
from docmill.plans import catalogue as base
from docmill.plans import sql
from docmill.sources import decorated as D

PAGE_LINES = 30


def node_relations(spark, sf):
    """Edges between the blocks of decorated documents, by kind."""
    b = base._blocks(spark, sf).select("doc_id", "block_idx", "type", F.length(F.regexp_extract("text", "^(#+)", 1)).alias("size"))
    edges = U.relations(b, "block_idx", "section_heading", ("image_evidence", "table"))
    return edges.groupBy("doc_id", "kind").agg(F.count("*").alias("edges"), F.sum(F.col("source") * 1000 + F.col("target")).alias("checksum"))


def typed_nodes(spark, sf):
    """Nodes of decorated documents by the Markdown grammar (no SQL: tested against literal texts)."""
    lines = D.decorated_lines(D.documents(spark, sf))
    docs = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return U.nodes(docs).select("doc_id", "node_id", "type", F.sha2("text", 256).alias("text_sha256"), "size", "line_start", "line_end")


def _subtitles(spark, sf):
    """A subtitle text for each conversation: every turn is a cue of two seconds; every third has a name, every fifth settings."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    clock = lambda s: F.format_string("%02d:%02d:%02d.000", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    body = F.concat(F.col("role"), F.lit(": "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\n\s*\n", "\n"))
    cue = F.concat(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("cue "), F.col("turn"), F.lit("\n"))).otherwise(""), clock(F.col("turn") * 2), F.lit(" --> "), clock(F.col("turn") * 2 + 2), F.when(F.col("turn") % 5 == 0, " align:start").otherwise(""), F.lit("\n"), body)
    return c.groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda x: x["cue"]), "\n\n")).alias("text"))


def cue_nodes(spark, sf):
    """Cues read back from subtitle texts."""
    found = _subtitles(spark, sf).select("conv_id", F.posexplode(U.cues(F.col("text"))).alias("n", "c"))
    return found.select("conv_id", F.col("n").cast("long").alias("n"), F.col("c.id").alias("cue_id"), "c.start", "c.end", "c.settings", F.sha2("c.text", 256).alias("text_sha256"))


def _paged(spark, sf):
    """Classified blocks with the page of their first line; a page has 30 lines."""
    lines = D.decorated_lines(D.documents(spark, sf))
    b = B.blockify(lines)
    starts = b.select(F.concat_ws("-", "doc_id", "block_idx").alias("id"), "doc_id", F.col("line_start").alias("at"))
    pages = lines.where(f"line_no % {PAGE_LINES} = 0").select("doc_id", F.col("line_no").cast("long").alias("at"), (F.floor(F.col("line_no") / PAGE_LINES) + 1).alias("page"))
    page = J.as_of_join(starts, pages, "doc_id", "at", "page")
    return B.classify(b).withColumn("id", F.concat_ws("-", "doc_id", "block_idx")).join(page, "id")


def page_map(spark, sf):
    """The page of every block: the last page that begins at or before its first line."""
    return _paged(spark, sf).select("doc_id", "block_idx", "page")


def chunk_pdf_like(spark, sf):
    return P.chunk_pdf_like(base._classified(spark, sf))


def chunk_page_order(spark, sf):
    return P.chunk_page_order(_paged(spark, sf))


def chunk_dispatch(spark, sf):
    """Every document by the strategy of its source type, which is dealt out by id."""
    return P.chunk_by(_paged(spark, sf), F.element_at(F.array(*map(F.lit, P.STRATEGIES)), (F.col("doc_id") % len(P.STRATEGIES) + 1).cast("int")))


def native_spans(spark, sf):
    """Blocks with the first page whose lines they overlap, as evidence where they come from; odd pages have none."""
    b = base._blocks(spark, sf).select("doc_id", F.format_string("n_%06d", F.col("block_idx") + 1).alias("node_id"), "type", "line_start", "line_end")
    lines = D.decorated_lines(D.documents(spark, sf)).groupBy("doc_id").agg(F.max("line_no").alias("last"))
    native = lines.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / PAGE_LINES))).alias("ord")).where("ord % 2 = 0").select("doc_id", "ord", (F.col("ord") * PAGE_LINES).alias("start"), (F.col("ord") * PAGE_LINES + PAGE_LINES - 1).alias("end"))
    return U.spans(b, native)


def ir_coverage(spark, sf):
    """How much of each document has native evidence."""
    return U.coverage(native_spans(spark, sf))


def line_changes(spark, sf):
    """Consecutive equal lines of raw documents that a reader of web pages would drop."""
    raw = D.documents(spark, sf).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line")).where("trim(line) <> ''")
    w = Window.partitionBy("doc_id").orderBy("n")
    return raw.withColumn("same", F.lag("line").over(w) == F.col("line")).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("same").alias("dropped"))


_PAGES = f"""lines30 AS (SELECT doc_id, max(line_no) AS last FROM lines GROUP BY doc_id), paged AS (SELECT c.*, line_start // {PAGE_LINES} + 1 AS page FROM classified c JOIN (SELECT doc_id, block_idx, line_start FROM blocks) USING (doc_id, block_idx))"""


def _pack(opens: str, closes: str, table: str = "classified", extra: str = "0 AS page", docs: str = "true", gap: int = 2) -> str:
    """Packing as a recursion; p is the group so far (n its size), k the block."""
    return f"""kept AS (SELECT doc_id, block_idx, type, text, {extra}, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS rn FROM {table} WHERE status = 'keep' AND text <> '' AND {docs}),
packed AS (SELECT doc_id, rn, type, page, block_idx, 0 AS chunk, n AS size FROM kept WHERE rn = 1 UNION ALL
  SELECT doc_id, rn, type, page, block_idx, CASE WHEN fresh THEN chunk + 1 ELSE chunk END, CASE WHEN fresh THEN n ELSE size + {gap} + n END FROM (
    SELECT k.doc_id, k.rn, k.type, k.page, k.block_idx, k.n, p.chunk, p.size, ({closes}) OR ({opens}) AS fresh FROM packed p JOIN kept k ON k.doc_id = p.doc_id AND k.rn = p.rn + 1))"""


_OUT = "SELECT doc_id, chunk::BIGINT AS chunk, min(block_idx) AS first_block, count(*) AS blocks, max(size)::BIGINT AS char_count FROM packed GROUP BY doc_id, chunk"
_RULES = {
    "pdf_like": ("(k.type = 'section_heading' OR p.size + 2 + k.n > 3500) AND p.size >= 300", "p.size >= 1200"),
    "page_order": ("p.page <> k.page OR p.size + 2 + k.n > 3500", "false"),
    "markdown": ("k.type = 'section_heading' AND regexp_matches(k.text, '^\\s*#{1,3}\\s+') OR p.size + 2 + k.n > 3500", "p.size >= 1200 AND p.type <> 'section_heading'"),
    "transcript": ("p.size + 2 + k.n > 3500 OR (regexp_matches(k.text, '^\\s*(?:(?:\\d{1,2}:)?\\d{1,2}:\\d{2}|[^:\\n：]{1,24}[：:]\\s+\\S)') AND p.size >= 1200)", "false"),
    "generic": ("p.size + 2 + k.n > 1200", "false"),
}
_ANY = ["CASE " + " ".join(f"WHEN k.doc_id % {len(P.STRATEGIES)} = {i} THEN ({_RULES[s][j]})" for i, s in enumerate(P.STRATEGIES)) + " END" for j in (0, 1)]
_EDGES = base.SQL["relationships"].replace("e AS (SELECT doc_id, 'next_sibling'", "r AS (SELECT doc_id, block_idx, type, lead(block_idx) OVER w AS nx, lead(type) OVER w AS nt FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)), e AS (SELECT doc_id, 'references' AS kind, block_idx AS source, nx AS target FROM r WHERE type = 'paragraph' AND nt IN ('image_evidence', 'table') UNION ALL SELECT doc_id, 'next_sibling'", 1)
_CLOCK = lambda s: f"printf('%02d:%02d:%02d.000', {s} // 3600, ({s} // 60) % 60, {s} % 60)"
SQL = {
    "node_relations": _EDGES,
    "cue_nodes": f"""WITH c AS (SELECT conv_id, turn, {sql.stripped("regexp_replace(list_aggregate(list_filter(list_transform(string_split(role || ': ' || regexp_replace(coalesce(text, ''), '\\n\\s*\\n', chr(10), 'g'), chr(10)), lambda x: " + sql.stripped('x') + "), lambda x: x <> ''), 'string_agg', ' '), '^$', '')")} AS body FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, CASE WHEN turn % 3 = 0 THEN 'cue ' || turn ELSE (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::VARCHAR END AS cue_id, {_CLOCK('(turn * 2)')} AS start, {_CLOCK('(turn * 2 + 2)')} AS end, CASE WHEN turn % 5 = 0 THEN 'align:start' ELSE '' END AS settings, sha256(body) AS text_sha256 FROM c""",
    "page_map": f"WITH {base._BLOCKS} SELECT doc_id, block_idx, line_start // {PAGE_LINES} + 1 AS page FROM blocks",
    "chunk_pdf_like": f"WITH RECURSIVE {base._CLASSIFIED}, {_pack(*_RULES['pdf_like'])} {_OUT}",
    "chunk_page_order": f"WITH RECURSIVE {base._CLASSIFIED}, {_PAGES}, {_pack(*_RULES['page_order'], 'paged', 'page')} {_OUT}",
    "chunk_dispatch": f"WITH RECURSIVE {base._CLASSIFIED}, {_PAGES}, {_pack(*_ANY, 'paged', 'page')} {_OUT.replace('SELECT doc_id,', 'SELECT doc_id, [' + ', '.join(repr(s) for s in P.STRATEGIES) + f'][doc_id % {len(P.STRATEGIES)} + 1] AS strategy,', 1)}",
    "native_spans": f"WITH {base._BLOCKS}, x AS (SELECT doc_id, block_idx, type, min(o) AS ord FROM (SELECT doc_id, block_idx, type, unnest(range(line_start // {PAGE_LINES}, line_end // {PAGE_LINES} + 1)) AS o FROM blocks) WHERE o % 2 = 0 GROUP BY 1, 2, 3) SELECT doc_id, 'n_' || lpad((block_idx + 1)::VARCHAR, 6, '0') AS node_id, b.type, CASE WHEN ord IS NULL THEN 'line' ELSE 'native' END AS precision, ord AS evidence FROM blocks b LEFT JOIN x USING (doc_id, block_idx)",
    "line_changes": "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents), k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) = line AS same FROM l WHERE trim(line) <> '') SELECT doc_id, count(*) AS lines, count(*) FILTER (same) AS dropped FROM k GROUP BY doc_id",
}
SQL["ir_coverage"] = f"SELECT doc_id, count(*) AS nodes, count(*) FILTER (precision = 'native') AS covered, count(DISTINCT type) AS types, count(*) FILTER (precision = 'native')::DOUBLE / count(*) AS ratio FROM ({SQL['native_spans']}) GROUP BY doc_id"


def queries():
    return {f.__name__: f for f in (node_relations, typed_nodes, cue_nodes, page_map, chunk_pdf_like, chunk_page_order, chunk_dispatch, native_spans, ir_coverage, line_changes)}
