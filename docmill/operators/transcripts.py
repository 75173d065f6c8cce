"""Transcripts: speaker turns and removal of rolling echoes, on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lines(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, cues, speakers, transcript_sha256): one ``role: text`` line for each turn."""
    text = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return _lines(conversations).select("conv_id", F.size("t").cast("long").alias("cues"), F.size(F.array_distinct(F.transform("t", lambda x: x["role"]))).cast("long").alias("speakers"), F.sha2(text, 256).alias("transcript_sha256"))


def without_echo(conversations: DataFrame) -> DataFrame:
    """(conv_id, kept): lines left after a line that repeats or extends the one before takes its place."""
    fold = F.aggregate(F.transform("t", lambda x: x["text"]), F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) > 0) & F.try_element_at(a, F.lit(-1)).startswith(x), a).when((F.size(a) > 0) & x.startswith(F.try_element_at(a, F.lit(-1))), F.array_append(F.slice(a, 1, F.size(a) - 1), x)).otherwise(F.array_append(a, x)))
    return _lines(conversations).select("conv_id", F.size(fold).cast("long").alias("kept"))


TURNS_SQL = """SELECT conv_id, count(*) AS cues, count(DISTINCT role) AS speakers, sha256(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS transcript_sha256 FROM conversations GROUP BY conv_id"""
ECHO_SQL = """WITH RECURSIVE t AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations),
r AS (SELECT conv_id, rn, text AS last, 1 AS kept FROM t WHERE rn = 1 UNION ALL
  SELECT t.conv_id, t.rn, CASE WHEN starts_with(r.last, t.text) THEN r.last ELSE t.text END, CASE WHEN starts_with(r.last, t.text) OR starts_with(t.text, r.last) THEN r.kept ELSE r.kept + 1 END FROM r JOIN t ON t.conv_id = r.conv_id AND t.rn = r.rn + 1)
SELECT conv_id, max(kept)::BIGINT AS kept FROM r GROUP BY conv_id"""
