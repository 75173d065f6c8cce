"""Greedy packing of a document's kept blocks into chunks and parts, as one fold over its ordered blocks.

The sizes alone decide, so only (place, length, flags) are folded, never the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators.blocks import LONGEST, TARGET, kept_blocks

GROUP = "struct<first:bigint,blocks:int,n:int>"
PART_FROM, PART_LEAST, PART_MOST = 12_000, 6_000, 18_000
LEAST = 300
STRATEGIES = ("pdf_like", "page_order", "markdown", "transcript", "generic")
TURN = r"^\s*(?:(?:\d{1,2}:)?\d{1,2}:\d{2}|[^:\n：]{1,24}[：:]\s+\S)"


def pack(blocks: DataFrame, opens: Callable[[Column, Column], Column], closes: Callable[[Column, Column], Column], gap: int = 2, flags: dict[str, Column] | None = None, least: int = 0) -> DataFrame:
    """(doc_id, chunk, first_block, blocks, char_count).

    ``opens(group, block)``: whether a block begins a new group; ``closes(group, block)``: whether the group ends after it;
    ``least``: documents that keep fewer characters have no groups.
    """
    flags = flags or {}
    rows = kept_blocks(blocks, F.struct("block_idx", F.length("text").alias("n"), *[c.alias(k) for k, c in flags.items()]))
    if least:
        rows = rows.where(F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x["n"]) >= least)
    return rows.select("doc_id", F.posexplode(groups(F.col("b"), opens, closes, gap)).alias("chunk", "c")).select("doc_id", F.col("chunk").cast("long"), F.col("c.first").alias("first_block"), F.col("c.blocks").cast("long").alias("blocks"), F.col("c.n").cast("long").alias("char_count"))


def groups(blocks: Column, opens: Callable[[Column, Column], Column], closes: Callable[[Column, Column], Column], gap: int = 2) -> Column:
    """The groups of a document's kept blocks, an array in order: one fold."""
    none = F.lit(None).cast(GROUP)

    def step(a, x):
        joins = a["open"].isNotNull() & ~opens(a["open"], x)
        group = F.when(joins, F.struct(a["open"]["first"].alias("first"), (a["open"]["blocks"] + 1).alias("blocks"), (a["open"]["n"] + gap + x["n"]).alias("n"))).otherwise(F.struct(x["block_idx"].alias("first"), F.lit(1).alias("blocks"), x["n"].alias("n")))
        done = F.when(joins | a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"]))
        ends = closes(group, x)
        return F.struct(F.when(ends, F.array_append(done, group)).otherwise(done).alias("done"), F.when(ends, none).otherwise(group).alias("open"))

    return F.aggregate(blocks, F.struct(F.array().cast(f"array<{GROUP}>").alias("done"), none.alias("open")), step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def chunk_markdown(blocks: DataFrame) -> DataFrame:
    """A new chunk at headings of level 1 to 3 and before the longest size; closed at the target unless a heading ends it."""
    flags = {"heading": F.col("type") == "section_heading", "top": (F.col("type") == "section_heading") & F.rlike("text", F.lit(r"^\s*#{1,3}\s+"))}
    return pack(blocks, lambda g, x: x["top"] | (g["n"] + 2 + x["n"] > LONGEST), lambda g, x: (g["n"] >= TARGET) & ~x["heading"], flags=flags)


def chunk_transcript(blocks: DataFrame) -> DataFrame:
    """A new chunk before the longest size, or at a turn once the target is reached."""
    return pack(blocks, lambda g, x: (g["n"] + 2 + x["n"] > LONGEST) | (x["turn"] & (g["n"] >= TARGET)), lambda g, x: F.lit(False), flags={"turn": F.rlike("text", F.lit(TURN))})


def chunk_pdf_like(blocks: DataFrame) -> DataFrame:
    """A new chunk at a heading or before the longest size, unless the chunk is still short; closed at the target."""
    return pack(blocks, lambda g, x: (x["heading"] | (g["n"] + 2 + x["n"] > LONGEST)) & (g["n"] >= LEAST), lambda g, x: g["n"] >= TARGET, flags={"heading": F.col("type") == "section_heading"})


def turned(blocks: DataFrame) -> DataFrame:
    """``blocks`` with turns_page: whether a kept block stands on another page than the kept one before."""
    order = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    kept = (F.col("status") == "keep") & (F.col("text") != "")
    return blocks.withColumn("turns_page", F.coalesce(F.last(F.when(kept, F.col("page")), True).over(order) != F.col("page"), F.lit(False)))


def chunk_page_order(blocks: DataFrame) -> DataFrame:
    """A new chunk wherever the page changes or before the longest size; blocks have a ``page``."""
    return pack(turned(blocks), lambda g, x: x["turned"] | (g["n"] + 2 + x["n"] > LONGEST), lambda g, x: F.lit(False), flags={"turned": F.col("turns_page")})


def chunk_by(blocks: DataFrame, strategy: Column) -> DataFrame:
    """(doc_id, strategy, chunk, ...): every document packed by its own strategy, in one fold for all."""
    kinds = turned(blocks.withColumn("strategy", strategy))
    heading = F.col("type") == "section_heading"
    flags = {"s": F.col("strategy"), "heading": heading, "top": heading & F.rlike("text", F.lit(r"^\s*#{1,3}\s+")), "turn": F.rlike("text", F.lit(TURN)), "turned": F.col("turns_page")}

    def opens(g, x):
        over = g["n"] + 2 + x["n"] > LONGEST
        return F.when(x["s"] == "pdf_like", (x["heading"] | over) & (g["n"] >= LEAST)).when(x["s"] == "page_order", x["turned"] | over).when(x["s"] == "markdown", x["top"] | over).when(x["s"] == "transcript", over | (x["turn"] & (g["n"] >= TARGET))).otherwise(g["n"] + 2 + x["n"] > TARGET)

    def closes(g, x):
        return (g["n"] >= TARGET) & ((x["s"] == "pdf_like") | ((x["s"] == "markdown") & ~x["heading"]))

    return pack(kinds, opens, closes, flags=flags).withColumn("strategy", strategy)


def parts(blocks: DataFrame) -> DataFrame:
    """Parts of documents that keep 12 000 characters or more: new at headings and before 18 000, from 6 000 on."""
    return pack(blocks, lambda g, x: (g["n"] >= PART_LEAST) & (x["heading"] | (g["n"] + x["n"] > PART_MOST)), lambda g, x: F.lit(False), gap=0, flags={"heading": F.col("type") == "section_heading"}, least=PART_FROM)
