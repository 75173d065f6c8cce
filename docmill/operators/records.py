"""Records about runs: inventories of folders, where pieces of a text stand, chapter titles, ledgers, envelopes, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.sources import intake as I

# Folders that are not looked into, and formats that take long to convert.
IGNORED = [".git", ".hg", ".svn", ".cache", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".venv", "venv", "env", "__pycache__", "node_modules", "dist", "build", "coverage", ".next", ".nuxt"]
HEAVY = ["pdf", "image", "doc", "ppt", "xls"]
# end of fixed values
NEEDLE = 40


def inventory(files: DataFrame, root: str) -> DataFrame:
    """(relative_path, extension, format, weight, action, reason) of files (path) under ``root``, without ignored folders.

    In order of the lower-case names of folders and files.
    """
    inside = files.where(F.startswith("path", F.lit(root.rstrip("/") + "/"))).withColumn("relative_path", F.substring("path", len(root.rstrip("/")) + 2, 1 << 20))
    folders = F.transform(F.slice(F.split("relative_path", "/"), F.lit(1), F.size(F.split("relative_path", "/")) - 1), F.lower)
    seen = I.formats(inside.where(~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED)))))
    known = F.col("format") != "unknown"
    media = F.col("format").isin("audio", "video")
    process = known & ~media & (F.col("format") != "remote_url") & (F.col("extension") != ".mobi")
    reason = F.when(media, "media_binary_not_transcribed_in_v1").when(~process, F.concat(F.lit("unsupported_extension:"), F.when(F.col("extension") == "", "<none>").otherwise(F.col("extension")))).otherwise("")
    return seen.select("relative_path", "extension", "format", F.when(F.col("format").isin(HEAVY), "heavy").otherwise("light").alias("weight"), F.when(process, "process").otherwise("skip").alias("action"), reason.alias("reason"))


def found_in(text: Column, items: Column) -> Column:
    """array<struct<item, at>>: where each of the texts begins (from 1), each looked for after the one found before; those not found are left out.

    The first ``NEEDLE`` characters of an item are looked for.
    """
    none = F.array().cast("array<struct<item:int,at:int>>")
    ranked = F.transform(items, lambda x, i: F.struct(i.alias("i"), F.substring(x, 1, NEEDLE).alias("x")))

    def step(a, r):
        at = F.when(r["x"] != "", F.call_function("locate", r["x"], text, a["from"])).otherwise(F.lit(0))
        return F.transform(F.array(at), lambda p: F.when(p > 0, F.struct((p + F.length(r["x"])).alias("from"), F.array_append(a["found"], F.struct(r["i"].alias("item"), p.alias("at"))).alias("found"))).otherwise(a))[0]

    return F.aggregate(ranked, F.struct(F.lit(1).alias("from"), none.alias("found")), step, lambda a: a["found"])


def chapter_titles(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, chapter): the last heading of level one or two at or before each block."""
    w = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when((F.col("type") == "section_heading") & F.rlike("text", F.lit(r"^#{1,2}\s")), F.regexp_replace("text", r"^#+\s+", ""))
    return blocks.select("doc_id", "block_idx", F.last(title, True).over(w).alias("chapter"))


def safe_name(title: Column) -> Column:
    """A title as the name of a file."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]+', "-"), r"^[ ._-]+|[ ._-]+$", ""), r"(?U)\s+", " ")
    short = F.regexp_replace(F.substring(clean, 1, 60), r"(?U)\s+$", "")
    return F.when(clean == "", "未命名知识").otherwise(short)


def ledger(runs: DataFrame) -> DataFrame:
    """(doc_id, n, stage, ok, detail): the six steps of every run (doc_id, route, converted, nodes, spans) with a hash of what each made.

    ``converted``, ``nodes`` and ``spans`` are digests, null where a step made nothing.
    """
    steps = [("conversion", "route"), ("converted_markdown_written", "converted"), ("typed_nodes_artifact_written", "nodes"), ("typed_nodes_artifact_validated", "nodes"), ("source_spans_artifact_written", "spans"), ("source_spans_artifact_validated", "spans")]
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(stage).alias("stage"), F.col(c).isNotNull().alias("ok"), F.sha2(F.concat_ws("|", F.lit(stage), F.coalesce(c, F.lit("none"))), 256).alias("detail")) for n, (stage, c) in enumerate(steps, 1)])
    return runs.select("doc_id", F.inline(rows))


def envelope(errors: Column, warnings: Column) -> Column:
    """The result of a run as JSON: its status and its findings."""
    status = F.when(F.size(errors) > 0, "failed").when(F.size(warnings) > 0, "completed_with_warnings").otherwise("completed")
    return F.to_json(F.struct((F.size(errors) == 0).alias("ok"), status.alias("status"), errors.alias("errors"), warnings.alias("warnings")))
