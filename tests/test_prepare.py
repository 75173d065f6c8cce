"""A folder from bytes to gates."""

import json

from pyspark.sql import functions as F

from docmill import prepare
from docmill.sources import converters as C
from docmill.sources import readers
from tests.test_intake import DOCX


def test_options():
    assert prepare.options(["in", "--a", "1", "--b=2", "--c", "--d", "out", "--", "--x"]) == (["in", "--x"], {"a": "1", "b": "2", "c": True, "d": "out"})


def test_readers(spark):
    assert readers.read(".py", b"x = 1\n\n") == "```python\nx = 1\n```\n" and readers.read(".tsv", b"a\tb\n1\t2") == "| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    assert readers.read(".json", b'{"a":1}').startswith("```json") and readers.read(".html", b"<p>x") == "x\n" and readers.read(".md", "é".encode("gbk")) == "é"
    text = "WEBVTT\n\n1\n00:01.000 --> 00:02.000\nhello\n\nhello there\n\n[x] and\nmore\n" + "w" * 300 + "\n" + "v" * 300
    assert readers.transcript(text) == spark.createDataFrame([(text,)], "t string").select(C.transcript(F.col("t")).alias("m")).first()["m"]


def test_a_folder(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "sub").mkdir(parents=True)
    (src / "a.md").write_text("# Title\n\nGood words here.\n\nScan the QR code to join for free\n\nkeep me\n后续更新：soon\n\n```\ncode")
    (src / "sub" / "b.docx").write_bytes(DOCX)
    (src / "bad.docx").write_bytes(b"PK no")
    (src / "movie.mp4").write_bytes(b"\0")
    (src / "fake.pdf").write_bytes(b"text")
    (tmp_path / "rules.jsonl").write_text(json.dumps({"id": "mine", "pattern": "good words", "action": "discard", "match": "literal", "risk_tag": "user_feedback_discard", "source": "user"}) + "\n")
    assert prepare.main([str(src)]) == 2
    assert prepare.main([str(src), str(out), "--rules", str(tmp_path / "rules.jsonl")]) == 0
    t = {name: spark.read.parquet(f"{out}/{name}").toPandas() for name in prepare.TABLES}
    files = {r.path.rsplit("/", 1)[1]: (r.route, r.reason, bool(r.read)) for r in t["files"].itertuples()}
    assert files == {"a.md": ("direct", "", True), "b.docx": ("office_xml", "", True), "bad.docx": ("office_xml", "", False), "movie.mp4": ("external_speech", "", False), "fake.pdf": ("unsupported", "extension_content_mismatch", False)}
    bodies = {r.doc_id.rsplit("/", 1)[1]: r.body for r in t["cleaned"].itertuples()}
    assert bodies["a.md"] == "# Title\n\nkeep me\n\n```\ncode\n```" and bodies["b.docx"].startswith("# Title\n\n- one")
    outcome = {(r.block_id, r.change_type): r.rejected for r in t["patches"].itertuples()}
    assert outcome == {("b_000001", "status_update"): None, ("b_000003", "content_update"): None, ("b_000003_promo_001", "derived_block"): None}
    assert set(t["gates"]["gate"]) == {"conversion_integrity", "cleanup_safety", "splitting_integrity", "review_safety", "export_readiness"} and len(t["chunks"]) == 2
