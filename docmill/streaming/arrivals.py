"""Documents as they arrive: the same per-document operators over a file stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T


def quality_stream(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Starts a query that appends text measures of every new Parquet file of documents in ``folder`` to ``out``.

    The file source and sink keep what is done in ``checkpoint``, so each document is written exactly once.
    """
    docs = spark.readStream.schema("doc_id long, text string").parquet(folder)
    t = F.coalesce("text", F.lit(""))
    measured = docs.select("doc_id", F.length(t).cast("long").alias("total_chars"), T.count(t, T.CJK).alias("cjk"), T.contains_any(t, T.CTA).alias("has_cta_text"))
    return measured.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
