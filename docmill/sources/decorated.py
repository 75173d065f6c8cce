"""Deterministic test inputs from the driver tables.

The raw documents hold no headings, fences, tables, steps or calls to action, so
queries over block operators read *decorated* documents: a fixed transform of their
lines that adds such structure. Counts over them say nothing about the raw tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (modulus, residue of doc_id * 7 + line number, lines added after that line)
ADDED = [
    (17, 5, ["Scan the QR code to join for free"]), (19, 6, ["Page 12"]), (23, 7, ["Thanks for watching!"]), (29, 8, ["TOP 10 list of channels"]),
    (31, 9, ["The retry_count threshold applies"]), (37, 10, ["![chart](img/a.png)"]), (41, 11, ["| name | value |", "|---|---|", "| a | 1 |"]),
    (43, 12, ["```python", "x = 1", "```"]), (47, 13, ["broken ����� text that cannot be read"]),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def decorated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) with line_no from 0; a blank line follows every piece."""
    raw = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "raw"))
    key = F.col("doc_id") * 7 + F.col("n")
    heading = F.when(F.col("n") % 15 == 0, F.array(F.concat(F.lit("# Part "), F.col("n").cast("string")), F.lit(""))).when(F.col("n") % 5 == 0, F.array(F.concat(F.lit("## Section "), F.col("n").cast("string")), F.lit(""))).otherwise(F.array().cast("array<string>"))
    body = F.when(key % 11 == 3, F.concat(F.lit("1. "), "raw")).when(key % 13 == 4, F.concat(F.lit("Step 2: "), "raw")).otherwise(F.col("raw"))
    parts = [heading, F.array(body, F.lit(""))]
    for modulus, residue, lines in ADDED:
        parts.append(F.when(key % modulus == residue, F.array(*[F.lit(x) for x in [*lines, ""]])).otherwise(F.array().cast("array<string>")))
    pieces = raw.select("doc_id", "n", F.concat(*parts).alias("lines"))
    joined = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "lines"))).alias("all"))
    return joined.select("doc_id", F.posexplode(F.flatten(F.transform("all", lambda x: x["lines"]))).alias("line_no", "line"))


def _sql_list(lines: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in [*lines, ""]) + "]"


LINES_SQL = f"""
raw_lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
pieces AS (SELECT doc_id, n,
    CASE WHEN n % 15 = 0 THEN ['# Part ' || n::VARCHAR, ''] WHEN n % 5 = 0 THEN ['## Section ' || n::VARCHAR, ''] ELSE []::VARCHAR[] END
    || [CASE WHEN (doc_id * 7 + n) % 11 = 3 THEN '1. ' || raw WHEN (doc_id * 7 + n) % 13 = 4 THEN 'Step 2: ' || raw ELSE raw END, '']
    {' '.join(f"|| CASE WHEN (doc_id * 7 + n) % {m} = {r} THEN {_sql_list(x)} ELSE []::VARCHAR[] END" for m, r, x in ADDED)} AS lines FROM raw_lines),
joined AS (SELECT doc_id, flatten(list(lines ORDER BY n)) AS l FROM pieces GROUP BY doc_id),
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM joined)"""
