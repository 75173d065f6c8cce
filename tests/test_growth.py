"""Large inputs: tests of texts that are ruled out by a few words, and queries that read their documents once."""

import re

import pytest
from pyspark.sql import functions as F

from docmill.functions import signals as S
from docmill.functions import text as T
from docmill.operators import blocks as B
from docmill.plans import all_queries

SF = "/root/testdata/sf0.001"
TEXTS = [
    "Scan the QR code to join", "SCAN THE QR KODE", "ſcan the qr code", "sİgn up for free", "sign up for free, für alle", "扫码体验", "长按识别 x 领取", "Page 3", "page 12", "第 3 页", "TOP 10", "top 7", "threshold", "RETRY_COUNT = 3", "THREſHOLD=1", "prompt", "a = b",
    "see www.x.org", "HTTPS://x", "| a |", "```", "`x`", "let it", "hello everyone!", "Hi guys", "thanks for watching", "see you next time", "that's all for today", "bye  bye", "大家好", "hello 大家好", "subscribe " + "x" * 40, "subscribe " + "x" * 41, "plain words", "", "  page 3", "3 天无理由退款",
    "step 3: open", "1. open", "€", "��� and more than twenty", "soft­hyphen ͸ ​ and more than twenty", "①②③④⑤⑥⑦ ①②③④⑤⑥ ab cd", "see you\n\npage 3", "![a](qr.png)", "s c a n t h e q r c o d e" + " " * 200, "x" * 400 + " scan the qr code", "All in Al", "Al编程"]


def test_words_that_every_match_holds():
    assert T.needed("scan the qr code.*(?:join|free)|名单") == {"scan the qr code", "名单"} and T.needed(r"\b(?:tool|App)\b") == {"tool", "App"}
    assert T.needed("colou?r") == {"colo"} and T.needed("(?:ab)?c*") is None and T.needed("abc|") is None and T.needed("\\u0061bc") == {"bc"} and T.needed(r"\Qa|b\E") is None and T.needed("(?x)a b") is None
    assert T.needed(r"[abc]x{2}yy") == {"yy"} and T.needed("x(?!abc)yz") == {"yz"} and T.needed("é") is None


def test_ruled_out_texts_match_nothing(spark):
    df, t = T.read(spark.createDataFrame([(x,) for x in TEXTS] + [(None,)], "text string"), "text")
    joined = "|".join(f"(?:{p})" for p in T.WRAPPER_LINE)
    patterns = [joined, *[p for _, p in T.PROTECTED], T.REFUND, T.FOOTER, *[p for _, p in T.EVIDENCE], *[p for _, p in T.PROMO], *S.DETAILS.values(), S.PARAMETER, S.OCR_CONFUSION, *T.FILLER, *T.FILLER_MORE, "|".join([*S.QR_MARKERS, *S.IMAGE_QR])]
    tests = [(T.matches(t, p), T.matches(F.col("text"), p)) for p in patterns] + [(f(t, terms), f(F.col("text"), terms)) for f in (T.contains_any, T.holds_any) for terms in (T.CTA, T.TUTORIAL, T.KNOWLEDGE, T.BUSINESS)]
    tests += [(T.knowledge_signal(t), T.knowledge_signal(F.col("text"))), (T.trimmed(F.col("text")), T.stripped(F.col("text"))), (B._any_match(F.col("text"), [*T.FILLER, *T.FILLER_MORE], "^"), B._any_match(F.col("text"), [*T.FILLER, *T.FILLER_MORE]))]
    for row in df.select("text", *[F.struct(a.alias("a"), b.alias("b")).alias(f"t{i}") for i, (a, b) in enumerate(tests)]).collect():
        assert [i for i in range(len(tests)) if row[f"t{i}"]["a"] != row[f"t{i}"]["b"]] == [], row["text"]


def test_wide_characters_are_all_that_patterns_hold(spark):
    terms = [*T.CTA, *T.TUTORIAL, *T.KNOWLEDGE, *T.BUSINESS, *T.WRAPPER_HEADING, *T.BACK_MATTER, *S.MOJIBAKE_TOKENS, *"".join(re.findall(r"\[(.*?)\]", S.MOJIBAKE_SEQUENCE + S.MOJIBAKE_CHARACTER))]
    every = spark.createDataFrame([(i, chr(i)) for i in range(128, 0x20000) if not 0xD800 <= i < 0xE000], "id int, c string")
    got = every.select("id", T.is_wide(F.col("c")).alias("wide"), F.rlike("c", F.lit("(?iuU)[a-z]")).alias("latin"), T.is_unusual(F.col("c")).alias("unusual"), F.rlike("c", F.lit(f"{T.GARBLED}|{T.ABNORMAL.removesuffix('{2,}')}")).alias("counts"))
    assert got.where("latin AND NOT wide OR counts AND NOT unusual").count() == 0
    wide = {r["id"] for r in got.where("wide").collect()}
    assert not [x for x in terms if not x.isascii() and not any(ord(c) in wide for c in x)]


@pytest.mark.parametrize("name", ["clean_gate", "patch_summary", "restored_blocks", "clean_patches", "clean_rules", "qa_findings", "qa_gates", "quality_loop", "envelopes", "quality_gates", "output_retention"])
def test_blocks_are_made_once(spark, name):
    plan = all_queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Generate posexplode\(split\(", plan)) == 1


def test_tables_in_one_order(spark):
    plan = B.line_kinds(spark.createDataFrame([(1, 0, "| a |")], "doc_id long, line_no int, line string"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[", plan)) == 1


def test_review_reads_blocks_twice(spark):
    plan = all_queries()["apply_review"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation .*parquet", plan)) <= 2


def test_measures_of_a_text_that_was_read(spark):
    from docmill.operators import diagnosis as G

    df, t = T.read(spark.createDataFrame([(x,) for x in [*TEXTS, "鐩綍 and 姗欑毊 text", "��� all in", "x\x07y", "A时代"]], "text string"), "text")
    fast, plain = G.text_measures(t), G.text_measures(F.col("text"))
    garbled = F.greatest(T.count(F.col("text"), T.GARBLED), (F.length("text") - F.length(F.regexp_replace("text", T.ABNORMAL, ""))).cast("long"))
    for r in df.select("text", F.struct(*[c.alias(k) for k, c in fast.items()]).alias("a"), F.struct(*[c.alias(k) for k, c in plain.items()]).alias("b"), garbled.alias("g")).collect():
        assert r["a"] == r["b"] and r["a"]["garbled_chars"] == r["g"], r["text"]
