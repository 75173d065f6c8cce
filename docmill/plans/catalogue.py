"""Every query of the document-preparation operators, with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import blocks as B
from docmill.operators import joins as J
from docmill.operators import packing as P
from docmill.operators import structure as U
from docmill.operators import transcripts as TR
from docmill.sources import converters as C
from docmill.sources import decorated as D
from docmill.sources import html as H


def _docs(spark, sf):
    return D.documents(spark, sf)


def _blocks(spark, sf):
    return B.blockify(D.decorated_lines(_docs(spark, sf)))


def _classified(spark, sf):
    return B.classify(_blocks(spark, sf))


def text_quality(spark, sf):
    """Character classes of the raw documents, as counts and unrounded ratios."""
    t = F.coalesce("text", F.lit(""))
    n = F.length(t)
    share = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    return _docs(spark, sf).select("doc_id", n.cast("long").alias("total_chars"), share(T.count(t, T.CJK)).alias("chinese_ratio"), share(T.count(t, "[a-zA-Z0-9]")).alias("alnum_ratio"), share(T.count(t, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}]")).alias("control_ratio"), T.count(t, "�").alias("replacement_chars"), T.contains_any(t, T.CTA).alias("has_cta_text"))


def language_hint(spark, sf):
    """ch where at least 3 CJK characters make up a fifth of CJK and Latin letters, else en."""
    t = F.coalesce("text", F.lit(""))
    cjk, latin = T.count(t, T.CJK), T.count(t, "[A-Za-z]")
    return _docs(spark, sf).select("doc_id", F.when((cjk >= 3) & (cjk / (cjk + latin) >= 0.2), "ch").otherwise("en").alias("language"))


def language_mix(spark, sf):
    """Share of CJK among letters by stated language."""
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, sf).groupBy("lang").agg(F.sum(T.count(t, T.CJK)).alias("cjk"), F.sum(T.count(t, r"\p{L}")).alias("letters")).select("lang", "cjk", "letters", F.when(F.col("letters") == 0, "other").when(F.col("cjk") / F.col("letters") >= 0.2, "zh").when(F.col("cjk") / F.col("letters") <= 0.05, "en").otherwise("mixed").alias("mix"))


def lines(spark, sf):
    return D.decorated_lines(_docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(T.stripped(F.col("line")) == "").alias("blank"), F.max(F.length("line")).cast("long").alias("longest"))


def structure_counts(spark, sf):
    k = B.line_kinds(D.decorated_lines(_docs(spark, sf)))
    return k.groupBy("doc_id").agg(F.count_if(F.col("kind") == "section_heading").alias("headings"), F.count_if(F.col("opens")).alias("fences"), F.count_if(F.col("kind") == "image_evidence").alias("images"), F.count_if(F.col("kind") == "table").alias("table_lines"))


def blockify(spark, sf):
    return _blocks(spark, sf).select("doc_id", "block_idx", "type", "line_start", "line_end", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


def heading_path(spark, sf):
    return _blocks(spark, sf).select("doc_id", "block_idx", "heading_path")


def classify_blocks(spark, sf):
    return _classified(spark, sf).select("doc_id", "block_idx", "type", "status", "protected", "confidence", "reason")


def block_status_counts(spark, sf):
    return _classified(spark, sf).groupBy("status", "type").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


def _losses(spark, sf, *more):
    """Body loss per document, with further aggregates over its blocks."""
    b = _classified(spark, sf)
    body = ~((F.col("status") == "discard") & F.col("type").isin(T.DISCARD_EXEMPT))
    return b.groupBy("doc_id").agg(F.count_if(body).alias("counted"), F.count_if(body & (F.col("status") == "discard")).alias("discarded"), F.count_if((F.col("status") == "discard") & ~body).alias("pollution"), F.coalesce(F.sum(F.when(body & (F.col("status") != "discard"), F.length("text"))) / F.sum(F.when(body, F.length("text"))), F.lit(1.0)).alias("coverage"), *more).withColumn(
        "gate", F.when(F.col("discarded") / F.greatest("counted", F.lit(1)) > 0.45, "fail").when(F.col("discarded") / F.greatest("counted", F.lit(1)) > 0.25, "warn").otherwise("pass"))


def discard_ratio(spark, sf):
    """Body loss per document: warn above 0.25, strict above 0.45; known pollution does not count."""
    return _losses(spark, sf)


def rule_matches(spark, sf):
    found = D.decorated_lines(_docs(spark, sf)).withColumn("rule_id", B.promotional_rule(F.col("line"))).where("rule_id IS NOT NULL")
    return found.groupBy("rule_id").agg(F.count("*").alias("lines"), F.count_distinct("doc_id").alias("docs"))


def _before(spark, sf):
    """Blocks as segmented, all kept: what the promotional-line rules then change."""
    return _blocks(spark, sf).withColumn("status", F.lit("keep"))


def patch_build(spark, sf):
    return B.patches(_before(spark, sf))


def patch_gate(spark, sf):
    before = _before(spark, sf)
    return B.gate(B.patches(before), before, ["english_signup"]).groupBy(F.coalesce("rejected", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("patches"))


def relationships(spark, sf):
    """next_sibling by document order; contains from a heading to what follows it up to the next heading of its level or above."""
    b = _blocks(spark, sf).select("doc_id", "block_idx", "type", F.length(F.regexp_extract("text", "^(#+)", 1)).alias("size"))
    edges = U.relations(b, "block_idx", "section_heading", ())
    return edges.groupBy("doc_id", "kind").agg(F.count("*").alias("edges"), F.sum(F.col("source") * 1000 + F.col("target")).alias("checksum"))


def annotations(spark, sf):
    """Headings that nothing follows before the next one, and paragraphs under 20 characters."""
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    b = _blocks(spark, sf).withColumn("next", F.lead("type").over(order))
    empty = (F.col("type") == "section_heading") & (F.col("next").isNull() | (F.col("next") == "section_heading"))
    code = F.when(empty, "empty_heading").when((F.col("type") == "paragraph") & (F.length("text") < 20), "short_paragraph")
    return b.select("doc_id", "block_idx", code.alias("code")).where("code IS NOT NULL")


def chunk_generic(spark, sf):
    return B.chunk_generic(_classified(spark, sf))


def quality_gates(spark, sf):
    """Documents by gate and status, from chunk sizes and body loss."""
    found = _losses(spark, sf, B.generic_sizes().alias("sizes"))
    most, least = F.array_max("sizes"), F.array_min("sizes")
    split = F.when(F.size("sizes") > 0, F.struct(F.lit("splitting_integrity").alias("gate"), F.when(most > B.LONGEST, "fail").when(least < 300, "warn").otherwise("pass").alias("status")))
    rows = F.array_compact(F.array(F.struct(F.lit("cleanup_safety").alias("gate"), F.col("gate").alias("status")), split))
    return found.select(F.inline(rows)).groupBy("gate", "status").agg(F.count("*").alias("docs"))


def review_pack(spark, sf):
    low = (F.col("status") == "review") | (F.col("confidence") < 0.76)
    return _classified(spark, sf).groupBy("doc_id").agg(F.count_if(low).alias("blocks"), F.min(F.when(low, F.col("block_idx"))).alias("first_block")).where("blocks > 0")


def render_cleaned(spark, sf):
    kept = B.kept_blocks(_classified(spark, sf), F.struct("block_idx", "text"))
    md = F.array_join(F.transform("b", lambda x: x["text"]), "\n\n")
    return kept.select("doc_id", F.length(md).cast("long").alias("chars"), F.sha2(md, 256).alias("cleaned_sha256"))


def transcript_turns(spark, sf):
    return TR.turns(spark.read.parquet(f"{sf}/conversations.parquet"))


def rolling_dedupe(spark, sf):
    return TR.without_echo(spark.read.parquet(f"{sf}/conversations.parquet"))


def url_domain(spark, sf):
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")
    return spark.read.parquet(f"{sf}/pages.parquet").select(host.alias("domain")).groupBy("domain").agg(F.count("*").alias("pages"))


def source_pattern(spark, sf):
    """Pages whose address begins with a pattern at a boundary (end, /, ?, #)."""
    p = "https://www.thering.example.org"
    u = F.coalesce("url", F.lit(""))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", ((u == p) | (u.startswith(p) & F.substring(u, len(p) + 1, 1).isin("/", "?", "#"))).alias("matches"))


def html_to_markdown(spark, sf):
    return H.to_markdown(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", F.length("markdown").cast("long").alias("chars"), F.sha2("markdown", 256).alias("markdown_sha256"))


def latest_run(spark, sf):
    """Newest event of each user and type, ties by the larger id."""
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def keep_newest_runs(spark, sf):
    """The three newest events of each user stay, older ones are due for removal."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.when(F.row_number().over(w) <= 3, "keep").otherwise("remove").alias("action")).groupBy("action").agg(F.count("*").alias("events"), F.sum("event_id").alias("checksum"))


def as_of_page_map(spark, sf):
    return J.as_of(spark, sf)


def interval_span(spark, sf):
    return J.overlaps(spark, sf)


def first_wins_dedupe(spark, sf):
    """The first part of each name, compared without case, in key order."""
    w = Window.partitionBy(F.lower("p_name")).orderBy("p_partkey")
    return spark.read.parquet(f"{sf}/part.parquet").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("p_partkey", F.lower("p_name").alias("name"))


def manifest_left_join(spark, sf):
    """Inventory with results: each customer with the number of orders, and a status."""
    c, o = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders"))
    done = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))
    met = c.select("c_custkey").join(done, "c_custkey", "left")
    return met.select("c_custkey", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"), F.when(F.col("orders").isNull(), "pending").when(F.col("failed") == F.col("orders"), "failed").when(F.col("failed") > 0, "completed_with_warnings").otherwise("succeeded").alias("status"))


def batch_summary(spark, sf):
    return manifest_left_join(spark, sf).groupBy("status").agg(F.count("*").alias("items"), F.sum("orders").alias("orders"))


def id_difference(spark, sf):
    """Customers without orders and order keys without lines: differences both ways, with none left over expected on either side."""
    c, o = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders"))
    left = c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.lit("missing").alias("side"), F.col("c_custkey").alias("id"))
    right = o.join(c, c.c_custkey == o.o_custkey, "left_anti").select(F.lit("extra").alias("side"), F.col("o_custkey").alias("id")).distinct()
    return left.unionByName(right)


def chunk_markdown(spark, sf):
    return P.chunk_markdown(_classified(spark, sf))


def chunk_transcript(spark, sf):
    return P.chunk_transcript(_classified(spark, sf))


def parts(spark, sf):
    return P.parts(_classified(spark, sf))


def text_shape(spark, sf):
    """Line counts that tell text profiles apart, on the raw documents."""
    t = F.coalesce("text", F.lit(""))
    n = lambda p: T.count(t, "(?dm)" + p)
    return _docs(spark, sf).select("doc_id", F.length(t).cast("long").alias("char_count"), n(r"^#{1,6}[ \t]+").alias("heading_count"), n(r"^[ \t]*\d+[.)][ \t]+").alias("numbered_step_count"), n(r"^[ \t]*(?:\d{1,2}:)?\d{1,2}:\d{2}").alias("timestamp_line_count"), n(r"^\|.+\|$").alias("table_row_count"))


def code_to_markdown(spark, sf):
    md = C.code_block(F.coalesce("text", F.lit("")), F.lit("text"))
    return _docs(spark, sf).select("doc_id", F.length(md).cast("long").alias("chars"), F.sha2(md, 256).alias("markdown_sha256"))


def json_to_markdown(spark, sf):
    return C.converted(spark.read.parquet(f"{sf}/events.parquet"), "event_id", "props", C.json_block)


def image_context(spark, sf):
    """Five lines before and three after each image line, without itself."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    k = B.line_kinds(D.decorated_lines(_docs(spark, sf)))
    near = k.select("doc_id", "line_no", "kind", F.concat(F.collect_list("line").over(w.rowsBetween(-5, -1)), F.collect_list("line").over(w.rowsBetween(1, 3))).alias("near"))
    return near.where("kind = 'image_evidence'").select("doc_id", F.col("line_no").cast("long"), F.sha2(F.array_join("near", "\n"), 256).alias("context_sha256"))


def run_identity(spark, sf):
    """Content and configuration hash of each document: equal texts of one source are processed once."""
    key = F.sha2(F.concat_ws(":", F.sha2(F.coalesce("text", F.lit("")), 256), "source", F.lit("standard")), 256)
    return _docs(spark, sf).groupBy(key.alias("run_key")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("docs"))


def rerun_scope(spark, sf):
    """Users whose last event failed are due for a rerun."""
    last = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.groupBy("last").agg(F.count("*").alias("users"))


def sample_pages(spark, sf):
    """Pages looked at by a diagnosis, with lines standing in for pages: all up to 80, else the first 5, the last 5 and every tenth."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    picked = F.expr("filter(sequence(0, n - 1), i -> n <= 80 OR i < 5 OR i >= n - 5 OR i % 10 = 0)")
    return _docs(spark, sf).select("doc_id", n.alias("n")).select("doc_id", F.col("n").cast("long").alias("pages"), F.size(picked).cast("long").alias("sampled"), F.aggregate(picked, F.lit(0).cast("long"), lambda a, i: a + i).alias("checksum"))


def bounded_strings(spark, sf):
    """The first 16 distinct lines of each document, cut to 96 characters, in order."""
    kept = F.slice(F.array_distinct(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.substring(x, 1, 96)), lambda x: x != "")), 1, 16)
    return _docs(spark, sf).select("doc_id", F.size(kept).cast("long").alias("strings"), F.sha2(F.array_join(kept, "\n"), 256).alias("strings_sha256"))


def promo_split(spark, sf):
    """Blocks of several lines of which some are promotional: what stays, and the lines that become blocks of their own."""
    raw = D.decorated_lines(_docs(spark, sf)).where("line <> ''").groupBy("doc_id", F.floor(F.col("line_no") / 12).alias("block")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    lines_ = raw.select("doc_id", "block", F.inline("l")).withColumn("rule_id", B.promotional_rule(F.col("line")))
    return lines_.groupBy("doc_id", "block").agg(F.count_if(F.col("rule_id").isNotNull()).alias("derived"), F.count_if(F.col("rule_id").isNull()).alias("left_lines"), F.coalesce(F.sum(F.when(F.col("rule_id").isNull(), F.length("line"))), F.lit(0)).alias("left_chars")).where("derived > 0")


def run_status(spark, sf):
    """failed, completed_with_warnings or completed for each document, from its gates."""
    g = discard_ratio(spark, sf)
    return g.groupBy(F.when(F.col("gate") == "fail", "failed").when(F.col("gate") == "warn", "completed_with_warnings").otherwise("completed").alias("status")).agg(F.count("*").alias("docs"))


def _re(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _RE2(p: str) -> str:
    """Escapes of code points as DuckDB's engine writes them."""
    import re

    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", p)


def _holds(col: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {_re(t)})" for t in terms) + ")"


def _knows(col: str) -> str:
    """One knowledge term of three characters or of ASCII, or two of any."""
    short = [t for t in T.KNOWLEDGE if len(t) < 3 and not t.isascii()]
    return f"({_holds(col, [t for t in T.KNOWLEDGE if t not in short])} OR {' + '.join(f'contains({col}, {_re(t)})::INT' for t in short)} >= 2)"


def _matches(col: str, patterns: list[str], flags: str = "i") -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {_re(f'(?{flags})' + p)})" for p in patterns) + ")"


def _any(col: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {_re(t.lower())})" for t in terms) + ")"


_CJK = "'[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{20000}-\\x{2a6df}]'"
_CNT = lambda t, p: f"len(regexp_extract_all({t}, {p}))"
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_KINDS = f"""
k0 AS (SELECT *, {_STRIP('line')} AS s FROM lines),
k1 AS (SELECT *, starts_with(s, '```') AS fence, sum(starts_with(s, '```')::INT) OVER w AS fences FROM k0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
k2 AS (SELECT *, starts_with(s, '|') AND NOT fence AND fences % 2 = 0 AS pipe FROM k1),
k3 AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, pipe ORDER BY line_no) AS run FROM k2),
k4 AS (SELECT *, min(line_no) FILTER (contains(substr(s, 2), '|')) OVER (PARTITION BY doc_id, pipe, run) AS rows_from, max(line_no) OVER (PARTITION BY doc_id, pipe, run) AS rows_to FROM k3),
k5 AS (SELECT doc_id, line_no, line, s, fence AND fences % 2 = 1 AS opens, CASE WHEN fence OR fences % 2 = 1 THEN 'code' WHEN s = '' THEN 'blank' WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN 'section_heading'
  WHEN pipe AND line_no >= rows_from AND rows_to > rows_from THEN 'table' WHEN regexp_matches(s, {_re(T.IMAGE)}) AND length(s) < 200 THEN 'image_evidence' WHEN starts_with(s, '>') THEN 'quote' ELSE 'text' END AS kind FROM k4),
kinds AS (SELECT * REPLACE (CASE WHEN kind = 'blank' AND lag(kind) OVER w = 'quote' AND coalesce(lead(kind) OVER w, 'quote') = 'quote' THEN 'quote' ELSE kind END AS kind) FROM k5 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""
_PATH = ", ".join(f"max(CASE WHEN level = {n} THEN line_no END) OVER w AS h{n}" for n in range(1, 7))
_ON = lambda n: " AND ".join([f"h{n} IS NOT NULL", *[f"coalesce(h{m}, -1) < h{n}" for m in range(1, n)]])
_BLOCKS = f"""{D.LINES_SQL},{_KINDS},
b0 AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev, CASE WHEN kind = 'section_heading' THEN length(regexp_extract(line, '^(#+)', 1)) END AS level FROM kinds),
b1 AS (SELECT *, sum((kind <> 'blank' AND (opens OR kind IN ('section_heading', 'image_evidence') OR prev IS NULL OR prev <> kind))::INT) OVER w - 1 AS block_idx, {_PATH} FROM b0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
titles AS (SELECT doc_id, line_no, {_STRIP("regexp_extract(line, '^#{1,6}\\s+(.*)$', 1)")} AS title FROM b0 WHERE kind = 'section_heading'),
b2 AS (SELECT doc_id, block_idx, min(line_no) AS line_start, max(line_no) AS line_end, min(kind) AS kind, {_STRIP("string_agg(line, chr(10) ORDER BY line_no)")} AS text, {', '.join(f"arg_max(CASE WHEN {_ON(n)} THEN h{n} ELSE -1 END, line_no) AS h{n}" for n in range(1, 7))} FROM b1 WHERE kind <> 'blank' GROUP BY doc_id, block_idx),
blocks AS (SELECT b2.doc_id, block_idx::BIGINT AS block_idx, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end, text, CASE WHEN kind <> 'text' THEN kind WHEN starts_with(text, '|') THEN 'table' WHEN (regexp_matches(text, {_re(T.STEP_LINE)}) OR regexp_matches(text, {_re('(?i)' + _RE2(T.EN_STEP_LINE))})) THEN 'operation_step' ELSE 'paragraph' END AS type,
  kind IN ('code', 'table') AS protected, concat_ws(' > ', {', '.join(f't{n}.title' for n in range(1, 7))}) AS heading_path FROM b2 {' '.join(f'LEFT JOIN titles t{n} ON t{n}.doc_id = b2.doc_id AND t{n}.line_no = h{n}' for n in range(1, 7))})"""
_HEADS = "replace(coalesce(heading_path, ''), ' > ', ' ')"
_SEARCHED = f"({_HEADS} || chr(10) || text)"
_SQUEEZED = "regexp_replace(text, '\\s+', '', 'g')"
_METHOD = f"((NOT starts_with(text, '```') AND NOT starts_with(text, '|') AND NOT contains(lower(text), '<table') AND {_matches('text', [T.PROTECTED[0][1]], 'im')}) OR {_holds(_SEARCHED, T.BUSINESS)} OR {_knows(_SEARCHED)})"
_SQUEEZED_CTA = _any(_SQUEEZED, [t.replace(" ", "") for t in T.CTA])
_GARBLED = "greatest(len(regexp_extract_all(regexp_replace(text, '[\\n\\r\\t]', '', 'g'), '\\p{Cc}|\\p{Cf}|\\p{Co}|\\x{fffd}')), length(text) - length(regexp_replace(text, " + _re(_RE2(T.ABNORMAL)) + ", '', 'g')))"
_WRAPPER = f"""CASE WHEN {_matches('text', [T.REFUND])} THEN NULL WHEN length({_SQUEEZED}) <= 80 AND {_SQUEEZED_CTA} AND NOT {_holds(_SQUEEZED, T.TUTORIAL)} AND NOT {_knows(_SQUEEZED)} THEN 'marketing_cta'
  WHEN {_METHOD} THEN NULL WHEN {_holds(_SEARCHED, T.WRAPPER_HEADING)} THEN CASE WHEN {_holds(_SEARCHED, T.BACK_MATTER)} THEN 'back_matter' ELSE 'marketing_wrapper' END WHEN {_matches('text', T.WRAPPER_LINE)} THEN 'marketing_wrapper' END"""
_RULES = [
    ("text = ''", "discard", "'empty'", "false", 0.95, "empty"),
    (f"({_WRAPPER}) IS NOT NULL", "discard", f"({_WRAPPER})", "false", 0.96, "marketing_wrapper"),
    ("type IN ('code', 'table')", "keep", "type", "true", 0.90, "structural"), ("type IN ('section_heading', 'quote')", "keep", "type", "protected", 0.90, "structural"),
    ("type = 'image_evidence'", "unclassified", "type", "false", 0.0, "image"), ("type = 'operation_step'", "keep", "type", "true", 0.90, "protected_type"),
    ("starts_with(text, '```')", "keep", "'code'", "true", 0.90, "protected_pattern"), ("starts_with(text, '|') OR contains(lower(text), '<table')", "keep", "'table'", "true", 0.90, "protected_pattern"),
    *[(_matches("text", [p], "im"), "keep", f"'{label}'", "true", 0.90, "protected_pattern") for label, p in T.PROTECTED],
    (f"{_any('text', T.CTA)} AND ({_holds('text', T.TUTORIAL)} OR {_knows('text')} OR {_holds(_HEADS, T.BUSINESS)} OR {_knows(_HEADS)})", "keep", "'case_step'", "true", 0.88, "contextual_cta"),
    (_matches("text", [*T.FILLER, *T.FILLER_MORE]), "discard", "'transcript_filler'", "false", 0.95, "filler"),
    (_any("text", T.CTA), "discard", "'marketing_cta'", "false", 0.95, "cta"), (_matches("text", [T.REFUND]), "discard", "'refund_policy'", "false", 0.95, "refund"), (_matches("text", [T.FOOTER]), "discard", "'footer'", "false", 0.95, "footer"),
    *[(_matches("text", [p]), "evidence", f"'{label}'", "false", 0.85, "evidence") for label, p in T.EVIDENCE],
    (f"length(text) >= 20 AND (length(text) - length(replace(text, chr(65533), '')) >= 3 OR {_GARBLED}::DOUBLE / length(text) > 0.15)", "discard", "'garbled_text'", "protected", 0.80, "garbled"),
]
_CASE = lambda k, other: "CASE " + " ".join(f"WHEN {r[0]} THEN {k(r)}" for r in _RULES) + f" ELSE {other} END"
_CLASSIFIED = f"""{_BLOCKS},
classified AS (SELECT doc_id, block_idx, text, {_CASE(lambda r: r[2], 'type')} AS type, {_CASE(lambda r: f"'{r[1]}'", "'keep'")} AS status, {_CASE(lambda r: r[3], 'protected')} AS protected, {_CASE(lambda r: f"{r[4]}::DOUBLE", "0.7::DOUBLE")} AS confidence, {_CASE(lambda r: f"'{r[5]}'", "'default'")} AS reason FROM blocks)"""
_PROMO = lambda c: f"CASE WHEN NOT {_any(c, T.KNOWLEDGE)} THEN CASE " + " ".join(f"WHEN regexp_matches({c}, {_re('(?i)' + p)}) THEN '{n}'" for n, p in T.PROMO) + " END END"
_EXEMPT = "(status = 'discard' AND type IN (" + ", ".join(f"'{x}'" for x in T.DISCARD_EXEMPT) + "))"
_LOSS = f"""loss AS (SELECT doc_id, count(*) FILTER (NOT {_EXEMPT}) AS counted, count(*) FILTER (NOT {_EXEMPT} AND status = 'discard') AS discarded, count(*) FILTER ({_EXEMPT}) AS pollution,
  coalesce(sum(length(text)) FILTER (NOT {_EXEMPT} AND status <> 'discard')::DOUBLE / sum(length(text)) FILTER (NOT {_EXEMPT}), 1.0) AS coverage FROM classified GROUP BY doc_id),
gated AS (SELECT *, CASE WHEN discarded::DOUBLE / greatest(counted, 1) > 0.45 THEN 'fail' WHEN discarded::DOUBLE / greatest(counted, 1) > 0.25 THEN 'warn' ELSE 'pass' END AS gate FROM loss)"""
_CHUNKS = f"""kept AS (SELECT doc_id, block_idx, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS rn FROM classified WHERE status = 'keep' AND text <> ''),
packed AS (SELECT doc_id, rn, block_idx, n, 0 AS chunk, n AS size FROM kept WHERE rn = 1 UNION ALL
  SELECT k.doc_id, k.rn, k.block_idx, k.n, CASE WHEN p.size + 2 + k.n <= {B.TARGET} THEN p.chunk ELSE p.chunk + 1 END, CASE WHEN p.size + 2 + k.n <= {B.TARGET} THEN p.size + 2 + k.n ELSE k.n END FROM packed p JOIN kept k ON k.doc_id = p.doc_id AND k.rn = p.rn + 1),
chunks AS (SELECT doc_id, chunk::BIGINT AS chunk, min(block_idx) AS first_block, count(*) AS blocks, max(size)::BIGINT AS char_count FROM packed GROUP BY doc_id, chunk)"""
def _pack(opens: str, closes: str, gap: int, docs: str) -> str:
    """Packing as a recursion over a document's kept blocks; ``p`` is the group so far, the other names are the block's."""
    return f"""WITH RECURSIVE {_CLASSIFIED}, kept AS (SELECT doc_id, block_idx, type, text, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS rn FROM classified WHERE status = 'keep' AND text <> '' AND {docs}),
packed AS (SELECT doc_id, rn, type, block_idx, 0 AS chunk, n AS size FROM kept WHERE rn = 1 UNION ALL
  SELECT doc_id, rn, type, block_idx, CASE WHEN fresh THEN chunk + 1 ELSE chunk END, CASE WHEN fresh THEN n ELSE size + {gap} + n END FROM (
    SELECT k.doc_id, k.rn, k.type, k.block_idx, k.n, p.chunk, p.size, ({closes}) OR ({opens.replace("type =", "k.type =").replace("(text", "(k.text")}) AS fresh FROM packed p JOIN kept k ON k.doc_id = p.doc_id AND k.rn = p.rn + 1))
SELECT doc_id, chunk::BIGINT AS chunk, min(block_idx) AS first_block, count(*) AS blocks, max(size)::BIGINT AS char_count FROM packed GROUP BY doc_id, chunk"""


_PATCH = f"""patched AS (SELECT doc_id, block_idx, rule_id, 'status_update' AS change_type, 'keep' AS before_status, 'discard' AS after_status, type, protected FROM (SELECT *, {_PROMO('text')} AS rule_id FROM blocks) WHERE rule_id IS NOT NULL AND NOT protected)"""

SQL = {
    "text_quality": f"SELECT doc_id, length(t) AS total_chars, coalesce({_CNT('t', _CJK)}::DOUBLE / nullif(length(t), 0), 0) AS chinese_ratio, coalesce({_CNT('t', _re('[a-zA-Z0-9]'))}::DOUBLE / nullif(length(t), 0), 0) AS alnum_ratio, coalesce({_CNT('t', _re('[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]'))}::DOUBLE / nullif(length(t), 0), 0) AS control_ratio, length(t) - length(replace(t, chr(65533), '')) AS replacement_chars, {_any('t', T.CTA)} AS has_cta_text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "language_hint": f"SELECT doc_id, CASE WHEN c >= 3 AND c::DOUBLE / (c + a) >= 0.2 THEN 'ch' ELSE 'en' END AS language FROM (SELECT doc_id, {_CNT('t', _CJK)} AS c, {_CNT('t', _re('[A-Za-z]'))} AS a FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
    "language_mix": f"SELECT lang, cjk, letters, CASE WHEN letters = 0 THEN 'other' WHEN cjk / letters >= 0.2 THEN 'zh' WHEN cjk / letters <= 0.05 THEN 'en' ELSE 'mixed' END AS mix FROM (SELECT lang, sum({_CNT('coalesce(text, chr(32))', _CJK)})::BIGINT AS cjk, sum({_CNT('coalesce(text, chr(32))', _re(r'\\p{L}'))})::BIGINT AS letters FROM documents GROUP BY lang)".replace("\\\\p", "\\p"),
    "lines": f"WITH {D.LINES_SQL} SELECT doc_id, count(*) AS lines, count(*) FILTER ({_STRIP('line')} = '') AS blank, max(length(line)) AS longest FROM lines GROUP BY doc_id",
    "structure_counts": f"WITH {D.LINES_SQL},{_KINDS} SELECT doc_id, count(*) FILTER (kind = 'section_heading') AS headings, count(*) FILTER (opens) AS fences, count(*) FILTER (kind = 'image_evidence') AS images, count(*) FILTER (kind = 'table') AS table_lines FROM kinds GROUP BY doc_id",
    "blockify": f"WITH {_BLOCKS} SELECT doc_id, block_idx, type, line_start, line_end, length(text) AS chars, sha256(text) AS text_sha256 FROM blocks",
    "heading_path": f"WITH {_BLOCKS} SELECT doc_id, block_idx, heading_path FROM blocks",
    "classify_blocks": f"WITH {_CLASSIFIED} SELECT doc_id, block_idx, type, status, protected, confidence, reason FROM classified",
    "block_status_counts": f"WITH {_CLASSIFIED} SELECT status, type, count(*) AS blocks, sum(length(text))::BIGINT AS chars FROM classified GROUP BY status, type",
    "discard_ratio": f"WITH {_CLASSIFIED}, {_LOSS} SELECT * FROM gated",
    "rule_matches": f"WITH {D.LINES_SQL} SELECT rule_id, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, {_PROMO('line')} AS rule_id FROM lines) WHERE rule_id IS NOT NULL GROUP BY rule_id",
    "patch_build": f"WITH {_BLOCKS}, {_PATCH} SELECT doc_id, block_idx, rule_id, change_type, before_status, after_status, type FROM patched",
    "patch_gate": f"WITH {_BLOCKS}, {_PATCH} SELECT CASE WHEN rule_id <> 'english_signup' THEN 'rule_not_in_policy_snapshot' WHEN protected OR type IN ('code', 'table', 'image', 'formula') THEN 'protected_structure_change' WHEN type = 'section_heading' THEN 'whole_section_deletion' ELSE 'accepted' END AS outcome, count(*) AS patches FROM patched GROUP BY 1",
    "relationships": f"WITH {_BLOCKS}, b AS (SELECT doc_id, block_idx, CASE WHEN type = 'section_heading' THEN length(regexp_extract(text, '^(#+)', 1)) END AS level FROM blocks), e AS (SELECT doc_id, 'next_sibling' AS kind, block_idx AS source, lead(block_idx) OVER (PARTITION BY doc_id ORDER BY block_idx) AS target FROM b UNION ALL SELECT h.doc_id, 'contains', h.block_idx, t.block_idx FROM (SELECT h.*, (SELECT min(n.block_idx) FROM b n WHERE n.doc_id = h.doc_id AND n.block_idx > h.block_idx AND n.level <= h.level) AS stop FROM b h WHERE h.level IS NOT NULL) h JOIN b t ON t.doc_id = h.doc_id AND t.block_idx > h.block_idx AND (h.stop IS NULL OR t.block_idx < h.stop)) SELECT doc_id, kind, count(*) AS edges, sum(source * 1000 + target)::BIGINT AS checksum FROM e WHERE target IS NOT NULL GROUP BY doc_id, kind",
    "annotations": f"WITH {_BLOCKS}, n AS (SELECT *, lead(type) OVER (PARTITION BY doc_id ORDER BY block_idx) AS nx FROM blocks), c AS (SELECT doc_id, block_idx, CASE WHEN type = 'section_heading' AND (nx IS NULL OR nx = 'section_heading') THEN 'empty_heading' WHEN type = 'paragraph' AND length(text) < 20 THEN 'short_paragraph' END AS code FROM n) SELECT * FROM c WHERE code IS NOT NULL",
    "chunk_generic": f"WITH RECURSIVE {_CLASSIFIED}, {_CHUNKS} SELECT * FROM chunks",
    "quality_gates": f"WITH RECURSIVE {_CLASSIFIED}, {_LOSS}, {_CHUNKS}, both_ AS (SELECT doc_id, 'cleanup_safety' AS gate, gate AS status FROM gated UNION ALL SELECT doc_id, 'splitting_integrity', CASE WHEN max(char_count) > {B.LONGEST} THEN 'fail' WHEN min(char_count) < 300 THEN 'warn' ELSE 'pass' END FROM chunks GROUP BY doc_id) SELECT gate, status, count(*) AS docs FROM both_ GROUP BY gate, status",
    "chunk_markdown": _pack("type = 'section_heading' AND regexp_matches(text, '^\\s*#{1,3}\\s+') OR p.size + 2 + k.n > " + str(B.LONGEST), f"p.size >= {B.TARGET} AND p.type <> 'section_heading'", 2, "true"),
    "chunk_transcript": _pack(f"p.size + 2 + k.n > {B.LONGEST} OR (regexp_matches(text, '^\\s*(?:(?:\\d{{1,2}}:)?\\d{{1,2}}:\\d{{2}}|[^:\\n：]{{1,24}}[：:]\\s+\\S)') AND p.size >= {B.TARGET})", "false", 2, "true"),
    "parts": _pack(f"p.size >= {P.PART_LEAST} AND (type = 'section_heading' OR p.size + k.n > {P.PART_MOST})", "false", 0, f"doc_id IN (SELECT doc_id FROM classified WHERE status = 'keep' GROUP BY doc_id HAVING sum(length(text)) >= {P.PART_FROM})"),
    "text_shape": "SELECT doc_id, length(t) AS char_count, " + ", ".join(f"len(regexp_extract_all(t, {_re('(?m)' + p)})) AS {n}" for p, n in ((r"^#{1,6}[ \t]+", "heading_count"), (r"^[ \t]*\d+[.)][ \t]+", "numbered_step_count"), (r"^[ \t]*(?:\d{1,2}:)?\d{1,2}:\d{2}", "timestamp_line_count"), (r"^\|.+\|$", "table_row_count"))) + " FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "code_to_markdown": "SELECT doc_id, length(md) AS chars, sha256(md) AS markdown_sha256 FROM (SELECT doc_id, f || 'text' || chr(10) || body || chr(10) || f || chr(10) AS md FROM (SELECT doc_id, body, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(body, '`+'), lambda x: length(x))), 0))) AS f FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+$', '') AS body FROM documents)))",
    "image_context": f"WITH {D.LINES_SQL},{_KINDS}, near AS (SELECT doc_id, line_no, kind, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS c FROM kinds) SELECT doc_id, line_no, sha256(c) AS context_sha256 FROM near WHERE kind = 'image_evidence'",
    "sample_pages": "WITH d AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents), e AS (SELECT doc_id, n, unnest(range(0, n)) AS i FROM d) SELECT doc_id, n AS pages, count(*) AS sampled, sum(i)::BIGINT AS checksum FROM e WHERE n <= 80 OR i < 5 OR i >= n - 5 OR i % 10 = 0 GROUP BY doc_id, n",
    "bounded_strings": "WITH l AS (SELECT doc_id, substr(unnest(string_split(coalesce(text, ''), chr(10))), 1, 96) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents), f AS (SELECT doc_id, x, min(i) AS i FROM l WHERE x <> '' GROUP BY doc_id, x), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f), g AS (SELECT doc_id, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS s FROM r WHERE rn <= 16 GROUP BY doc_id) SELECT d.doc_id, coalesce(n, 0) AS strings, sha256(coalesce(s, '')) AS strings_sha256 FROM documents d LEFT JOIN g USING (doc_id)",
    "promo_split": f"WITH {D.LINES_SQL}, p AS (SELECT doc_id, line_no // 12 AS block, line, {_PROMO('line')} AS rule_id FROM lines WHERE line <> '') SELECT doc_id, block::BIGINT AS block, count(rule_id) AS derived, count(*) FILTER (rule_id IS NULL) AS left_lines, coalesce(sum(length(line)) FILTER (rule_id IS NULL), 0)::BIGINT AS left_chars FROM p GROUP BY doc_id, block HAVING count(rule_id) > 0",
    "run_status": f"WITH {_CLASSIFIED}, {_LOSS} SELECT CASE gate WHEN 'fail' THEN 'failed' WHEN 'warn' THEN 'completed_with_warnings' ELSE 'completed' END AS status, count(*) AS docs FROM gated GROUP BY 1",
    "run_identity": "SELECT sha256(sha256(coalesce(text, '')) || ':' || source || ':standard') AS run_key, min(doc_id) AS first_doc, count(*) AS docs FROM documents GROUP BY 1",
    "rerun_scope": "SELECT last, count(*) AS users FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id) GROUP BY last",
    "review_pack": f"WITH {_CLASSIFIED} SELECT doc_id, count(*) AS blocks, min(block_idx) AS first_block FROM classified WHERE status = 'review' OR confidence < 0.76 GROUP BY doc_id",
    "render_cleaned": f"WITH {_CLASSIFIED}, r AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_idx) AS md FROM classified WHERE status = 'keep' GROUP BY doc_id) SELECT doc_id, length(md) AS chars, sha256(md) AS cleaned_sha256 FROM r",
    "transcript_turns": TR.TURNS_SQL,
    "rolling_dedupe": TR.ECHO_SQL,
    "url_domain": "SELECT regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') AS domain, count(*) AS pages FROM pages GROUP BY 1",
    "source_pattern": "SELECT page_id, coalesce(url, '') = 'https://www.thering.example.org' OR (starts_with(coalesce(url, ''), 'https://www.thering.example.org') AND substr(url, 32, 1) IN ('/', '?', '#')) AS matches FROM pages",
    "latest_run": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "keep_newest_runs": "SELECT action, count(*) AS events, sum(event_id)::BIGINT AS checksum FROM (SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3 THEN 'keep' ELSE 'remove' END AS action FROM events) GROUP BY action",
    "as_of_page_map": J.AS_OF_SQL,
    "interval_span": J.OVERLAPS_SQL,
    "first_wins_dedupe": "SELECT p_partkey, name FROM (SELECT p_partkey, lower(p_name) AS name, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1",
    "manifest_left_join": "SELECT c_custkey, coalesce(n, 0) AS orders, CASE WHEN n IS NULL THEN 'pending' WHEN f = n THEN 'failed' WHEN f > 0 THEN 'completed_with_warnings' ELSE 'succeeded' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
    "id_difference": "SELECT 'missing' AS side, c_custkey::BIGINT AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'extra', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
}
SQL["batch_summary"] = f"SELECT status, count(*) AS items, sum(orders)::BIGINT AS orders FROM ({SQL['manifest_left_join']}) GROUP BY status"


def queries():
    return {f.__name__: f for f in (
        text_quality, language_hint, language_mix, lines, structure_counts, blockify, heading_path, classify_blocks, block_status_counts, discard_ratio, rule_matches, patch_build, patch_gate, relationships, annotations, chunk_generic, quality_gates,
        review_pack, render_cleaned, transcript_turns, rolling_dedupe, url_domain, source_pattern, html_to_markdown, latest_run, keep_newest_runs, as_of_page_map, interval_span, first_wins_dedupe, manifest_left_join, batch_summary, id_difference,
        chunk_markdown, chunk_transcript, parts, text_shape, code_to_markdown, json_to_markdown, image_context, run_identity, rerun_scope, sample_pages, bounded_strings, promo_split, run_status)}


def oracle_sql():
    return dict(SQL)
