"""Queries over raw documents and a few literal texts that reach every outcome, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import signals as S
from docmill.functions import text as T
from docmill.operators import diagnosis as G
from docmill.plans import sql
from docmill.sources import converters as C
from docmill.sources import decorated as D

#: (doc_id, text): literal texts, for what no raw document holds.
TEXTS = [
    (-1, "第一章 报告\n" + "# A\n## B\n# C\n" * 4 + "long " * 2600), (-2, "00:01 hi\n00:02 there\n1:00:03,500 end\n"), (-3, "Anna: hello you\nBen: hi\n" * 4), (-4, "Step 1: open\nstep 2. close"), (-5, "the meeting began"), (-6, "a short note"),
    (-7, "```python\nx = 1\n```\n```\ny\n```"), (-8, "| a | b |\n" * 6), (-9, "lesson 3: report on cookies"), (-10, "All in Al and Al工具 and A时代, Google Al Studio, YouTubeAl, AIlinAI"), (-11, "![a](img\\one.png) and ![b](two.png)\n```\nopen"),
    (-12, "鐩綍绔 鈥聽 姗欑毊 text"), (-13, "���� ⚀⚁ ①②③ x"), (-14, "scan this QR  code 扫码"), (-15, ""), (-16, "plain"), (-17, "# H1\n# H2\n# H3\nx"), (-18, "see [x](http://y) and https://z\nline\nline"), (-19, "def f(x):\n  return chapter"), (-20, "please claim your free copy"),
]


def _texts(spark, sf):
    raw = D.documents(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = spark.createDataFrame(TEXTS, "doc_id long, text string")
    kind = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.pmod("doc_id", F.lit(len(names))) + 1).cast("int"))
    return raw.unionByName(own).withColumns({"source_type": kind(SOURCES), "source_format": kind(FORMATS)})


SOURCES, FORMATS = ["", "pdf_like", "subtitle_transcript", ""], ["", "html", "ebook", "code", "text"]


def text_measures(spark, sf):
    """Damage and packaging signals of raw texts."""
    each, t = T.read(_texts(spark, sf), "text")
    return each.select("doc_id", *[c.alias(k) for k, c in G.text_measures(t).items()])


def text_profile(spark, sf):
    """Shape of raw texts: counts and the profile that follows."""
    counts, profile = G.text_profile(F.col("text"), F.col("source_format"))
    return _texts(spark, sf).withColumns(counts).withColumn("text_profile", profile).drop("text", "source_type", "source_format", "english_steps")


def document_type(spark, sf):
    """Document type by hints and patterns, with all candidates; source types and formats are dealt out by id."""
    return G.document_type(_texts(spark, sf)).select("doc_id", "document_type", "confidence", "usable", "candidates")


def content_form(spark, sf):
    """Dominant layout of raw texts and the counts behind it."""
    return _texts(spark, sf).withColumns(G.content_evidence(F.col("text"))).withColumn("content_form", G.content_form()).drop("text", "source_type", "source_format")


def ocr_fixes(spark, sf):
    """Texts after the OCR fixes, with the number of fixes."""
    fixed, counts = G.ocr_fixes(F.col("text"))
    return _texts(spark, sf).select("doc_id", sum(counts, F.lit(0)).cast("long").alias("fixes"), F.sha2(fixed, 256).alias("fixed_sha256"))


def fix_report(spark, sf):
    """Fixes of the form by kind: OCR, unclosed code fences, image separators; and the text after them."""
    fixed, counts = G.ocr_fixes(F.col("text"))
    staged = _texts(spark, sf).select("doc_id", sum(counts, F.lit(0)).cast("long").alias("ocr_fixes"), fixed.alias("fixed")).withColumn("closed", C.closed_fences(F.col("fixed")))
    src = F.regexp_extract_all("closed", F.lit(T.IMAGE), F.lit(2))
    told = staged.select("doc_id", "ocr_fixes", (F.col("closed") != F.col("fixed")).cast("long").alias("code_fixes"), F.size(F.filter(src, lambda s: F.contains(s, F.lit("\\")))).cast("long").alias("image_fixes"), G.image_separators(F.col("closed")).alias("out"))
    return told.select("doc_id", "ocr_fixes", "code_fixes", "image_fixes", (F.col("ocr_fixes") + F.col("code_fixes") + F.col("image_fixes")).alias("total_fixes"), F.sha2("out", 256).alias("normalized_sha256"))


def _pick(names: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + f"][((doc_id % {len(names)} + {len(names)}) % {len(names)}) + 1]"


_TEXTS = f"t0 AS (SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT * FROM {sql.values(TEXTS, 'doc_id, text')}), t AS (SELECT *, {_pick(SOURCES)} AS source_type, {_pick(FORMATS)} AS source_format FROM t0)"
_N = lambda p, flags="m": sql.count("text", f"(?{flags}){p}")
_LEN = lambda p: f"(length(text) - length(regexp_replace(text, {sql.quoted(sql.re2(p))}, '', 'g')))"
_SHARE = lambda c: f"coalesce(({c})::DOUBLE / nullif(length(text), 0), 0)"
_CC = r"[\x{80}-\x{9f}]|\p{Cf}|\p{Co}|\x{fffd}"
_GARB = f"greatest({sql.count('text', r'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|' + _CC)}, {_LEN(T.ABNORMAL)})"
_RARE = sql.count("text", _CC)
_MOJI = f"greatest({_LEN(S.MOJIBAKE_SEQUENCE)}, {sql.count('text', S.MOJIBAKE_CHARACTER)}, {_LEN('|'.join(S.MOJIBAKE_TOKENS))})"
_SAID = f"({sql.count('text', '[一-鿿㐀-䶿𠀀-𪛟]')} + {sql.count('text', '[a-zA-Z0-9]')})"
_HAS = lambda terms: sql.holds_lower("text", terms)
_SCORE = {n: " + ".join(["0", *[f"CASE WHEN source_type = '{v}' THEN {s} ELSE 0 END" for v, m, s in S.SOURCE_HINTS if m == n], *[f"CASE WHEN source_format = '{v}' THEN {s} ELSE 0 END" for v, m, s in S.FORMAT_HINTS if m == n], *[f"CASE WHEN {sql.matches('substr(text, 1, 200000)', p, f)} THEN {s} ELSE 0 END" for m, s, p, f in S.TYPE_PATTERNS if m == n]]) for n in S.DOCUMENT_TYPES}
#: look-ahead and look-behind as groups that are put back
_OCR_SQL = [
    (r"\bAll in Al\b", "All in AI"), ("Al([一-鿿])", r"AI\1"), (r"Al(工具|时代|使用|模型|编程|技术|应用|内容|创作|协作|问答|助手)", r"AI\1"), ("(^|[^a-zA-Z])A([一-鿿])", r"\1AI\2"), ("Google Al Studio", "Google AI Studio"), ("YouTubeAl", "YouTube AI"), ("AIlinAI", "AI in AI")]


def _ocr(col: str) -> tuple[str, str]:
    counts = []
    for p, new in _OCR_SQL:
        counts.append(sql.count(col, p))
        col = f"regexp_replace({col}, {sql.quoted(p)}, {sql.quoted(new)}, 'g')"
    return col, " + ".join(counts)


#: word boundaries of any script, written out
_BOUND = S.OCR_CONFUSION.replace(r"\b", "(?:^|[^a-zA-Z0-9_一-鿿])", 1).replace(r"\b", "(?:$|[^a-zA-Z0-9_一-鿿])")
_FIXED, _FIXES = _ocr("text")
_PROFILE = f"""p AS (SELECT doc_id, text, source_format, length(text) AS char_count, {_N(r'^#{1,6}\s+')} AS heading_count, {_N(T.STEP_LINE)} + {_N(T.EN_STEP_LINE, 'im')} AS numbered_step_count, {_N(T.EN_STEP_LINE, 'im')} AS en,
  {_N(r'^\s*(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?')} AS timestamp_line_count, {_N(r'^\s*[^:\n：]{1,24}[：:]\s+\S+')} AS speaker_line_count, {_N(r'^\|.+\|$')} AS table_row_count FROM t)"""
_IMG = sql.quoted(T.IMAGE)
SQL = {
    "text_measures": f"""WITH {_TEXTS} SELECT doc_id, {_GARB} AS garbled_chars, {_MOJI} AS mojibake_chars, {_SHARE(_GARB)} AS garbled_ratio, {_SHARE(_RARE)} AS non_common_unicode_ratio, {_SHARE("length(text) - length(replace(text, chr(65533), ''))")} AS replacement_char_ratio, {_SHARE(_MOJI)} AS mojibake_ratio,
  greatest({_SHARE(_GARB)}, {_SHARE(_RARE)}, {_SHARE(_MOJI)}, CASE WHEN {_SHARE(_SAID)} < 0.20 THEN {_SHARE("length(text) - length(replace(text, chr(65533), ''))")} ELSE 0 END) AS unreadable_text_ratio, {sql.count('text', _BOUND)} AS ocr_confusions,
  {sql.matches('text', '|'.join([*S.QR_MARKERS, *S.IMAGE_QR]))} AS has_qr_text, {_HAS(T.CTA)} OR {sql.matches('text', '|'.join(f'(?:{p})' for _, p in T.PROMO))} AS has_cta_text FROM t""",
    "text_profile": f"""WITH {_TEXTS}, {_PROFILE} SELECT doc_id, char_count, heading_count, numbered_step_count, timestamp_line_count, speaker_line_count, table_row_count, CASE WHEN heading_count >= 8 AND char_count > 12000 THEN 'ebook_or_long_report'
  WHEN source_format = 'subtitle_transcript' OR timestamp_line_count >= 3 OR speaker_line_count >= 8 THEN 'transcript' WHEN {_HAS(S.TUTORIAL_TERMS)} OR numbered_step_count >= 3 OR en > 0 THEN 'tutorial' WHEN {_HAS(S.MEETING_TERMS)} THEN 'meeting_or_interview'
  WHEN {_HAS(S.NOTE_TERMS)} THEN 'note' WHEN {_HAS(S.EBOOK_TERMS)} AND char_count > 12000 THEN 'ebook_or_long_report' WHEN char_count < 4000 THEN 'short_text' ELSE 'long_text' END AS text_profile FROM p""",
    "document_type": f"""WITH {_TEXTS}, s AS (SELECT doc_id, unnest([{', '.join(f"{{'name': '{n}', 'place': {i}, 'score': {_SCORE[n]}}}" for i, n in enumerate(S.DOCUMENT_TYPES))}]) AS c FROM t), g AS (SELECT doc_id, max(c.score) AS best, arg_max(c.name, (c.score, -c.place)) AS name, string_agg(c.name || ':' || c.score, ',' ORDER BY c.score DESC, c.name) AS candidates FROM s GROUP BY doc_id)
SELECT doc_id, CASE WHEN best > 0 THEN name ELSE 'unknown' END AS document_type, CASE WHEN best > 0 THEN round(least(0.95, 0.35 + best / 12.0::DOUBLE), 3) ELSE 0.1 END AS confidence, best > 0 AND round(least(0.95, 0.35 + best / 12.0::DOUBLE), 3) >= 0.5 AS usable, candidates FROM g""",
    "content_form": f"""WITH {_TEXTS}, e AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS line_count, {_N(r'^#{1,6}\s+\S+')} AS heading_count, {_N(r'\[[^\]]+\]\([^)]+\)|https?://')} AS link_count, {_N(r'^\s*\|.+\|\s*$')} AS table_row_count, {sql.count('text', '```')} // 2 AS code_fence_count, {_N(r'^\s*\d{1,2}:\d{2}\b')} AS timestamp_count FROM t)
SELECT *, CASE WHEN code_fence_count >= 2 THEN 'code' WHEN table_row_count >= 5 THEN 'table_heavy' WHEN timestamp_count >= 3 THEN 'transcript' WHEN heading_count >= 3 AND heading_count::DOUBLE / greatest(line_count, 1) >= 0.3 THEN 'outline' WHEN line_count >= 3 THEN 'prose' ELSE 'mixed' END AS content_form FROM e""",
    "ocr_fixes": f"WITH {_TEXTS} SELECT doc_id, ({_FIXES})::BIGINT AS fixes, sha256({_FIXED}) AS fixed_sha256 FROM t",
    "fix_report": f"""WITH {_TEXTS}, f AS (SELECT doc_id, ({_FIXES})::BIGINT AS ocr_fixes, {_FIXED} AS fixed FROM t), c AS (SELECT doc_id, ocr_fixes, (len(list_filter(string_split(fixed, chr(10)), lambda x: starts_with(ltrim(x), '```'))) % 2)::BIGINT AS code_fixes, fixed FROM f),
k AS (SELECT doc_id, ocr_fixes, code_fixes, CASE WHEN code_fixes = 1 THEN fixed || chr(10) || '```' ELSE fixed END AS closed FROM c),
i AS (SELECT *, len(list_filter(regexp_extract_all(closed, {_IMG}, 2), lambda x: contains(x, chr(92))))::BIGINT AS image_fixes, list_reduce(list_prepend(closed, list_filter(regexp_extract_all(closed, {_IMG}, 0), lambda x: contains(x, chr(92)))), lambda a, x: replace(a, x, replace(x, chr(92), '/'))) AS out FROM k)
SELECT doc_id, ocr_fixes, code_fixes, image_fixes, ocr_fixes + code_fixes + image_fixes AS total_fixes, sha256(out) AS normalized_sha256 FROM i""",
}


def queries():
    return {f.__name__: f for f in (text_measures, text_profile, document_type, content_form, ocr_fixes, fix_report)}
