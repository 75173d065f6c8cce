"""Converters, file scan, packing and the file stream."""

from pyspark.sql import functions as F

from docmill.operators import packing as P
from docmill.sources import converters as C
from docmill.streaming.arrivals import quality_stream


def test_converters(spark):
    assert C.table_of("a, b\n\n1,x|y\n2\n") == "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n| 2 |  |\n"
    assert C.table_of(None) == "" and C.table_of("a\tb", "\t") == "| a | b |\n| --- | --- |\n"
    assert C.json_block('{"a":1}') == '```json\n{\n  "a": 1\n}\n```\n' and C.json_block(" no ") == "```json\nno\n```\n"
    assert C.decoded("é".encode()) == "é" and C.decoded("中文".encode("gbk")) == "中文" and C.decoded(b"\xff") == "\xff"
    df = spark.createDataFrame([("a ```` b \n",), ("x",)], "t string")
    assert [r[0] for r in df.select(C.code_block(F.col("t"), F.lit("py"))).collect()] == ["`````py\na ```` b\n`````\n", "```py\nx\n```\n"]
    fences = spark.createDataFrame([("a\n```\nb",), ("```\n```",), ("",)], "t string")
    assert [r[0] for r in fences.select(C.closed_fences(F.col("t"))).collect()] == ["a\n```\nb\n```", "```\n```", ""]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "B.md").write_text("x"), (tmp_path / "sub" / "a.TXT").write_text("yy")
    got = [(r["path"].rsplit("/", 1)[1], r["extension"], r["size"]) for r in C.files(spark, str(tmp_path)).collect()]
    assert got == [("B.md", ".md", 1), ("a.TXT", ".txt", 2)]


def _blocks(spark, rows):
    return spark.createDataFrame([(1, i, kind, "keep", text) for i, (kind, text) in enumerate(rows)], "doc_id long, block_idx long, type string, status string, text string")


def test_packing(spark):
    p, h = ("paragraph", "x" * 1000), ("section_heading", "## h")
    got = [(r["first_block"], r["blocks"]) for r in P.chunk_markdown(_blocks(spark, [h, p, p, p, h, p])).orderBy("chunk").collect()]
    assert got == [(0, 3), (3, 1), (4, 2)]
    big = ("paragraph", "y" * 7000)
    got = [(r["first_block"], r["blocks"]) for r in P.parts(_blocks(spark, [big, h, big, big, big])).orderBy("chunk").collect()]
    assert got == [(0, 1), (1, 3), (4, 1)]
    assert P.parts(_blocks(spark, [p])).count() == 0


def test_stream_writes_each_document_once(spark, tmp_path):
    folder, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    spark.createDataFrame([(1, "扫码"), (2, None)], "doc_id long, text string").write.parquet(folder)
    quality_stream(spark, folder, out, at).awaitTermination()
    spark.createDataFrame([(3, "plain")], "doc_id long, text string").write.mode("append").parquet(folder)
    quality_stream(spark, folder, out, at).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [(1, 2, 2, True), (2, 0, 0, False), (3, 5, 0, False)]
