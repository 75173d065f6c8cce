"""Queries over formats and plain converters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.plans import sql, structure
from docmill.sources import converters as C
from docmill.sources import decorated as D
from docmill.sources import intake as I

EXTENSIONS = sorted(I.BY_EXTENSION) + [".PDF", ".xyz", ""]


def format_table(spark, sf):
    """Format, source type and route of file names: a document each, with every known extension in turn."""
    names = D.documents(spark, sf).select("doc_id", F.concat(F.lit("in/doc-"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))).alias("path"))
    known = I.formats(names)
    return known.select("doc_id", "extension", "format", "source_type", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in I.ROUTES.items() for x in pair]), F.col("format")), F.lit("none")).alias("route"))


def csv_to_markdown(spark, sf):
    """The orders of every customer as CSV, turned into a Markdown table."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", F.struct("o_orderkey", F.concat_ws(",", "o_orderkey", F.concat(F.lit('"'), "o_orderpriority", F.lit('|x"')), "o_orderstatus").alias("line")).alias("x"))
    text = o.groupBy("o_custkey").agg(F.concat(F.lit("key, priority\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")).alias("text"))
    return C.converted(text, "o_custkey", "text", C.table_of).select("o_custkey", F.length("markdown").cast("long").alias("chars"), F.sha2("markdown", 256).alias("markdown_sha256"))


def subtitle_to_markdown(spark, sf):
    """Subtitle texts of conversations as transcripts (no SQL: tested against a literal text)."""
    return structure._subtitles(spark, sf).select("conv_id", C.transcript(F.col("text")).alias("md")).select("conv_id", F.length("md").cast("long").alias("chars"), F.sha2("md", 256).alias("markdown_sha256"))


_FORMATS = sql.values([(e, f, I.SOURCE_TYPES.get(f, "generic_block"), I.ROUTES.get(f, "none")) for e, f in I.BY_EXTENSION.items()], "e, f, s, r")
SQL = {
    "format_table": f"WITH k AS (SELECT * FROM {_FORMATS}), d AS (SELECT doc_id, lower([{', '.join(map(repr, EXTENSIONS))}][doc_id % {len(EXTENSIONS)} + 1]) AS extension FROM documents) SELECT doc_id, extension, coalesce(f, 'unknown') AS format, coalesce(s, 'generic_block') AS source_type, coalesce(r, 'none') AS route FROM d LEFT JOIN k ON e = extension",
    "csv_to_markdown": r"""WITH t AS (SELECT o_custkey, '| key | priority |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderpriority || '\|x | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey) || chr(10) AS md FROM orders GROUP BY o_custkey) SELECT o_custkey, length(md) AS chars, sha256(md) AS markdown_sha256 FROM t""",
}


def queries():
    return {f.__name__: f for f in (format_table, csv_to_markdown, subtitle_to_markdown)}
