"""Literal cases for blocks, chunks, patches and HTML."""

from docmill.operators import blocks as B
from docmill.operators import joins as J
from docmill.sources.html import markdown_of


def lines(spark, text, doc=1):
    return spark.createDataFrame([(doc, i, x) for i, x in enumerate(text.split("\n"))], "doc_id long, line_no int, line string")


def test_segmentation(spark):
    text = "# A\n\npara one\nstill one\n\n## B\n```\n# not a heading\n```\n| a |\n| b |\n\n1. step\n> quote\n![x](y.png)"
    got = [(r["type"], r["text"], r["heading_path"]) for r in B.blockify(lines(spark, text)).orderBy("block_idx").collect()]
    assert got == [
        ("section_heading", "# A", "A"), ("paragraph", "para one\nstill one", "A"), ("section_heading", "## B", "A > B"), ("code", "```\n# not a heading\n```", "A > B"),
        ("table", "| a |\n| b |", "A > B"), ("operation_step", "1. step", "A > B"), ("quote", "> quote", "A > B"), ("image_evidence", "![x](y.png)", "A > B")]


def test_heading_levels_pop(spark):
    got = [r["heading_path"] for r in B.blockify(lines(spark, "# A\n### C\n## B\nx")).orderBy("block_idx").collect()]
    assert got == ["A", "A > C", "A > B", "A > B"]


def test_classification_is_ordered_and_multilingual(spark):
    rows = [("扫码领取福利", "paragraph"), ("扫码案例：平台规则", "paragraph"), ("谢谢大家", "paragraph"), ("Page 3", "paragraph"), ("提示词：写一段", "paragraph"), ("plain words", "paragraph")]
    blocks = spark.createDataFrame([(1, i, k, t, i, i, False, "") for i, (t, k) in enumerate(rows)], "doc_id long, block_idx long, type string, text string, line_start long, line_end long, protected boolean, heading_path string")
    got = [(r["status"], r["type"]) for r in B.classify(blocks).orderBy("block_idx").collect()]
    assert got == [("discard", "marketing_cta"), ("keep", "case_step"), ("discard", "transcript_filler"), ("discard", "footer"), ("keep", "prompt"), ("keep", "paragraph")]


def test_chunks_hold_every_kept_block_once(spark):
    blocks = spark.createDataFrame([(1, i, "keep" if i != 3 else "discard", "x" * 500) for i in range(10)], "doc_id long, block_idx long, status string, text string")
    got = [(r["first_block"], r["blocks"], r["char_count"]) for r in B.chunk_generic(blocks).orderBy("chunk").collect()]
    assert got == [(0, 2, 1002), (2, 2, 1002), (5, 2, 1002), (7, 2, 1002), (9, 1, 500)]


def test_gate_rejects(spark):
    blocks = spark.createDataFrame([(1, 0, "section_heading", False), (1, 1, "code", True), (1, 2, "paragraph", False)], "doc_id long, block_idx long, type string, protected boolean")
    patches = spark.createDataFrame([(1, i, r, "status_update", "discard") for i, r in ((0, "a"), (1, "a"), (2, "a"), (2, "b"), (9, "a"))], "doc_id long, block_idx long, rule_id string, change_type string, after_status string")
    got = {(r["block_idx"], r["rule_id"]): r["rejected"] for r in B.gate(patches, blocks, ["a"]).collect()}
    assert got == {(0, "a"): "whole_section_deletion", (1, "a"): "protected_structure_change", (2, "a"): None, (2, "b"): "rule_not_in_policy_snapshot", (9, "a"): "missing_target_node"}


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5, 50), (1, 1, 10)], "k int, at int, id int")
    right = spark.createDataFrame([(1, 2, 7), (1, 5, 8)], "k int, at int, page int")
    assert {r["id"]: r["page"] for r in J.as_of_join(left, right, "k", "at", "page").collect()} == {50: 8, 10: None}


def test_html():
    html = "<html><nav>menu</nav><h1>T &amp; U</h1><p>a<br>b</p><ul><li>x</li><li>x</li></ul><script>no()</script><footer>f</footer></html>"
    assert markdown_of(html) == "# T & U\n\na\n\nb\n\n- x"
    assert markdown_of(None) == ""


def test_filler_and_wrapper_rules_of_the_reference(spark):
    rows = [
        ("Welcome back to my channel", "paragraph", "", "transcript_filler"), ("don't forget to subscribe!", "paragraph", "", "transcript_filler"), ("Smash the like button", "paragraph", "", "transcript_filler"),
        ("that's all for today", "paragraph", "", "transcript_filler"), ("下期见", "paragraph", "", "transcript_filler"), ("大家好", "paragraph", "", "transcript_filler"), ("点赞关注", "paragraph", "", "transcript_filler"),
        ("今天就到这里", "paragraph", "", "transcript_filler"), ("记得收藏", "paragraph", "", "transcript_filler"),
        ("作者的话", "paragraph", "书 > 写在最后", "back_matter"), ("任何内容", "quote", "核心权益", "marketing_wrapper"), ("# 致谢", "section_heading", "致谢", "back_matter"), ("7天内无理由退款", "paragraph", "", "marketing_wrapper"),
        ("添加小助手即可领取", "paragraph", "", "marketing_wrapper"), ("本书内容仅供学习与参考", "paragraph", "", "marketing_wrapper"),
        ("免责声明里的策略", "paragraph", "", None), ("3天无理由退款", "paragraph", "核心权益", "refund_policy"), ("1. 打开", "operation_step", "核心权益", None), ("扫码步骤", "paragraph", "", None), ("账号", "paragraph", "核心权益", None),
        ("plain words", "paragraph", "核心权益 > 案例", "marketing_wrapper"), ("plain words", "paragraph", "核心权益 > 底层逻辑", None),
    ]
    blocks = spark.createDataFrame([(1, i, k, t, i, i, False, h) for i, (t, k, h, _) in enumerate(rows)], "doc_id long, block_idx long, type string, text string, line_start long, line_end long, protected boolean, heading_path string")
    got = [r["type"] if r["status"] == "discard" else None for r in B.classify(blocks).orderBy("block_idx").collect()]
    assert got == [want for *_, want in rows]


def test_texts_are_built_once(spark):
    from docmill.plans import catalogue

    for name in ("chunk_generic", "chunk_markdown", "parts", "render_cleaned", "review_pack"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        # the block's text once, not once a rule; what is rendered from the blocks stands in two columns
        assert plan.count("array_join(transform(") <= (3 if name == "render_cleaned" else 1), name


def test_classification_follows_the_rules_of_the_reference(spark):
    rows = [
        ("plain ��� text that cannot be read", "paragraph", "discard", "garbled_text"), ("short ���", "paragraph", "keep", "paragraph"), ("first line\n2) second line is a step", "paragraph", "keep", "operation_step"),
        ("see <TABLE border=1>", "paragraph", "keep", "table"), ("①②③④⑤⑥⑦ ①②③④⑤⑥ ab cd", "paragraph", "discard", "garbled_text"), ("Scan the QR code", "table", "discard", "marketing_cta"),
        ("scan the qr code: a case study", "paragraph", "keep", "case_step"), ("step 3: open it", "paragraph", "keep", "operation_step"), ("7 apples", "paragraph", "keep", "operation_step"), ("", "paragraph", "discard", "empty")]
    blocks = spark.createDataFrame([(1, i, k, t, i, i, False, "") for i, (t, k, _, _) in enumerate(rows)], "doc_id long, block_idx long, type string, text string, line_start long, line_end long, protected boolean, heading_path string")
    got = [(r["status"], r["type"]) for r in B.classify(blocks).orderBy("block_idx").collect()]
    assert got == [(status, kind) for *_, status, kind in rows]


def test_tables_and_quotes(spark):
    text = "| lonely\n\n| no second\n| a | b |\n| c\n\n> one\n\n> two\n\n\n> three"
    got = [(r["type"], r["text"]) for r in B.blockify(lines(spark, text)).orderBy("block_idx").collect()]
    assert got == [("table", "| lonely"), ("table", "| no second"), ("table", "| a | b |\n| c"), ("quote", "> one\n\n> two"), ("quote", "> three")]
