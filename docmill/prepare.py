"""A folder of files from their bytes to cleaned text, chunks and gates, as tables.

    python -m docmill.prepare IN OUT [--rules FILE.jsonl] [--strategy generic]

Writes under OUT: files, blocks, patches, cleaned, chunks, findings, gates. A rules file has one rule a line:
{"id", "pattern", "action", "match", "risk_tag", "source"}.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import blocks as B
from docmill.operators import cleaning as C
from docmill.operators import diagnosis as G
from docmill.operators import packing as P
from docmill.operators import quality as Q
from docmill.sources import converters
from docmill.sources import intake as I
from docmill.sources import readers

TABLES = ("files", "blocks", "patches", "cleaned", "chunks", "findings", "gates")


def options(argv: list[str]) -> tuple[list[str], dict[str, str | bool]]:
    """(places, options) of ``--key value``, ``--key=value`` and ``--flag``; what follows ``--`` is a place."""
    places: list[str] = []
    found: dict[str, str | bool] = {}
    rest = list(argv)
    while rest:
        word = rest.pop(0)
        if word == "--":
            return places + rest, found
        if word.startswith("--"):
            key, eq, value = word[2:].partition("=")
            found[key] = value if eq else rest.pop(0) if rest and not rest[0].startswith("--") else True
        else:
            places.append(word)
    return places, found


def prepared(files: DataFrame, rules: list[C.Rule], strategy: str = "generic", keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> dict[str, DataFrame]:
    """The tables of files (path, size, content); the path is a document's id.

    ``keep`` writes a table that several others are made of and reads it back, so that each step runs once.
    """
    known = I.readable(I.formats(files)).where("refused IS NULL")
    routed = I.routes(known.join(I.sniffed(known), "path"))
    routed = keep(routed.drop("content"), "routed").join(files.select("path", "content"), "path")
    texts = keep(readers.converted(routed), "texts")
    fixed = G.image_separators(converters.closed_fences(G.ocr_fixes(F.col("markdown"))[0]))
    docs = texts.where("markdown IS NOT NULL").select(F.col("path").alias("doc_id"), fixed.alias("text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    none = F.lit(None).cast("string")
    before = keep(B.classify(keep(B.blockify(lines), "segmented")).select(
        "doc_id", "block_idx", F.format_string("b_%06d", "block_idx").alias("block_id"), "type", "status", "protected", "text", "heading_path", F.array().cast("array<string>").alias("risk_tags"), none.alias("rule_id"), none.alias("rule_source")), "before")
    cleaned = keep(C.apply_rules(before, rules), "ruled")
    patches = keep(C.gate_patches(C.build_patches(before, cleaned), before, cleaned, [r.id for r in rules]), "patches")
    blocks = keep(C.restore(cleaned, before, patches), "blocks")
    body = B.kept_blocks(blocks, F.struct("block_idx", "block_id", "text")).select("doc_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("body"))
    paged = blocks.withColumn("page", F.lit(1))
    chunks = keep(P.chunk_by(paged, F.lit(strategy)).drop("strategy"), "chunks")
    found = keep(Q.findings(Q.measures(blocks, chunks), F.lit("other")), "findings")
    state = routed.join(texts.select("path", F.col("markdown").isNotNull().alias("read"), "error"), "path", "left").select("path", "extension", "format", "source_type", "route", "reason", F.coalesce("read", F.lit(False)).alias("read"), "error")
    return dict(zip(TABLES, (state, blocks, patches, body, chunks, found, Q.gates(docs.select("doc_id"), found, F.lit(False)))))


def read_rules(path: str | None) -> list[C.Rule]:
    """The base rules, and those of a file."""
    if not path:
        return list(C.BASE)
    with open(path, encoding="utf-8") as f:
        return [*C.BASE, *(C.Rule(**json.loads(line)) for line in f if line.strip())]


def main(argv: list[str]) -> int:
    places, chosen = options(argv)
    if len(places) != 2 or chosen.get("strategy", "generic") not in P.STRATEGIES:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("prepare").getOrCreate()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(places[0]).select("path", F.col("length").alias("size"), "content")
    out = places[1].rstrip("/")

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{out}/{name}" if name in TABLES else f"{out}/_steps/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    for name, table in prepared(files, read_rules(chosen.get("rules") or None), str(chosen.get("strategy", "generic")), keep).items():
        if name not in ("patches", "blocks", "chunks", "findings"):
            keep(table, name)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
