"""Structure of documents: typed nodes of Markdown, cues of transcripts, relations between nodes, where nodes come from."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T

#: A cue's timing line: start, end, settings.
TIMING = r"^((?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{1,3})(?:\s+(.*))?$"
CUE = "array<struct<id:string,start:string,end:string,text:string,settings:string>>"

_HEADING = re.compile(r"^\s{0,3}(#{1,6})\s+(.+?)\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$")
_FIGURE = re.compile(r'^\s*!\[([^\]]*)\]\(([^)\s]+)(?:\s+"([^"]*)")?\)\s*$')
_INLINE = re.compile(r"^\$([^$]+)\$$")
_RULE = re.compile(r"^:?-{3,}:?$")


def _cells(line: str) -> list[str]:
    line = line.strip()
    if "|" not in line:
        return []
    cells = line.split("|")
    cells = cells[1:] if line.startswith("|") else cells
    cells = cells[:-1] if line.endswith("|") and len(cells) > 2 else cells
    return [c.strip() for c in cells]


def _fence(line: str) -> tuple[str, int, str] | None:
    """(character, length, what follows) of a fence that is indented by three spaces at most."""
    body = line.strip()
    if len(line) - len(line.lstrip(" ")) > 3 or not body or body[0] not in "`~":
        return None
    size = len(body) - len(body.lstrip(body[0]))
    return (body[0], size, body[size:].strip()) if size >= 3 else None


def _opening(lines: list[str], i: int) -> str:
    """What kind of node begins at a line that is not blank."""
    line, body = lines[i], lines[i].strip()
    if _fence(line):
        return "code"
    if i == 0 and body == "---" and any(x.strip() == "---" for x in lines[1:]):
        return "metadata"
    if body == "$$" or (body.startswith("$$") and body.endswith("$$") and len(body) > 4) or _INLINE.match(body):
        return "formula"
    if _HEADING.match(line):
        return "heading"
    if _ITEM.match(line):
        return "list"
    if i + 1 < len(lines) and len(_cells(line)) >= 2 and len(under := _cells(lines[i + 1])) >= 2 and all(map(_RULE.match, under)):
        return "table"
    if body.startswith(">"):
        return "quote"
    return "figure" if _FIGURE.match(line) else "paragraph"


def _until(lines: list[str], i: int, ends) -> int:
    while i < len(lines) and not ends(lines[i]):
        i += 1
    return i


def typed_nodes(markdown: str | None) -> list[tuple[str, str, int, int, int]]:
    """(type, text, level or size, first line, last line) of every node, lines from 1."""
    lines, out, i = (markdown or "").splitlines(), [], 0
    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        kind, body, size = _opening(lines, i), lines[i].strip(), 0
        if kind == "code":
            mark, width, _ = _fence(lines[i])
            stop = _until(lines, i + 1, lambda x: (f := _fence(x)) is not None and f[0] == mark and f[1] >= width and not f[2])
            text, end = "\n".join(lines[i + 1 : stop]), min(stop + 1, len(lines))
        elif kind == "metadata" or (kind == "formula" and body == "$$"):
            stop = _until(lines, i + 1, lambda x, b=body: x.strip() == b)
            text, end, size = "\n".join(lines[i + 1 : stop]), min(stop + 1, len(lines)), stop - i - 1 if kind == "metadata" else 0
            text = text.strip() if kind == "formula" else text
        elif kind == "formula":
            text, end = body.strip("$").strip(), i + 1
        elif kind == "heading":
            found = _HEADING.match(lines[i])
            text, size, end = found[2].strip(), len(found[1]), i + 1
        elif kind == "figure":
            text, end = body, i + 1
        elif kind in ("list", "table", "quote"):
            ends = {"list": lambda x: not _ITEM.match(x), "table": lambda x: len(_cells(x)) < 2, "quote": lambda x: not x.lstrip().startswith(">")}[kind]
            end = _until(lines, i, ends)
            shown = {"list": lambda x: _ITEM.match(x)[1].strip(), "table": str.strip, "quote": lambda x: x.lstrip()[1:].strip()}[kind]
            text, size = "\n".join(map(shown, lines[i:end])), end - i
        else:
            end = i + 1
            while end < len(lines) and lines[end].strip() and _opening(lines, end) == "paragraph":
                end += 1
            text = "\n".join(x.strip() for x in lines[i:end])
        if text.strip() or kind in ("code", "metadata", "formula"):
            out.append((kind, text, size, i + 1, end))
        i = end
    return out


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, node_id, type, text, size, line_start, line_end) of every document, in Arrow batches."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [(d, n, *x) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for n, x in enumerate(typed_nodes(t))]
                cols = list(zip(*found)) or [()] * 7
                types = (part.column(0).type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n", "type", "text", "size", "line_start", "line_end"])

    made = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n int, type string, text string, size int, line_start int, line_end int")
    return made.withColumn("node_id", F.format_string("n_%06d", F.col("n") + 1))


def relations(typed: DataFrame, at: str = "n", heading: str = "heading", figures: tuple[str, ...] = ("figure", "table")) -> DataFrame:
    """(doc_id, kind, source, target): next siblings, what headings contain, and paragraphs that stand before a figure or table.

    ``typed`` is (doc_id, place, type, size), size being a heading's level. One window pass makes all edges.
    """
    order = Window.partitionBy("doc_id").orderBy(at)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = F.when(F.col("type") == heading, F.col("size"))
    last = [F.max(F.when(level == k, F.col(at))).over(before).alias(f"h{k}") for k in range(1, 7)]
    seen = typed.select("doc_id", at, "type", level.alias("level"), F.lead(at).over(order).alias("next"), F.lead("type").over(order).alias("next_type"), *last)
    above = lambda k: F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"h{m}"), F.lit(-1)) for m in range(1, k)])
    holds = [F.when((above(k) < F.coalesce(F.col(f"h{k}"), F.lit(-1))) & (F.col("level").isNull() | (F.col("level") > k)), F.col(f"h{k}")) for k in range(1, 7)]
    edge = lambda name, a, b: F.struct(F.lit(name).alias("kind"), a.cast("long").alias("source"), b.cast("long").alias("target"))
    own = F.array(F.when(F.col("next").isNotNull(), edge("next_sibling", F.col(at), F.col("next"))), *([F.when((F.col("type") == "paragraph") & F.col("next_type").isin(*figures), edge("references", F.col(at), F.col("next")))] if figures else []), *[F.when(h.isNotNull(), edge("contains", h, F.col(at))) for h in holds])
    return seen.select("doc_id", F.inline(F.array_compact(own)))


def cues(text: Column) -> Column:
    """array<struct<id, start, end, text, settings>>: timed cues of a subtitle text; a cue without a name of its own has its number."""
    clean = F.regexp_replace(F.regexp_replace(text, r"^\x{feff}+", ""), r"\r\n?", "\n")
    blocks = F.transform(F.split(clean, r"\n\s*\n", -1), lambda b: F.filter(F.transform(F.split(b, "\n", -1), T.stripped), lambda x: x != ""))
    at = lambda b: F.coalesce(F.array_min(F.filter(F.transform(b, lambda x, i: F.when(F.rlike(x, F.lit(TIMING)), i)), lambda i: i.isNotNull())), F.lit(-1))
    timed = F.filter(F.transform(blocks, lambda b: F.struct(b.alias("b"), at(b).alias("i"))), lambda x: x["i"] >= 0)

    def cue(x, n):
        line, name = F.get(x["b"], x["i"]), F.get(x["b"], x["i"] - 1)
        named = name.isNotNull() & ~F.contains(name, F.lit("-->")) & (F.length(name) <= 120) & ~F.rlike(F.upper(name), F.lit(r"^(?:NOTE|STYLE|REGION|WEBVTT)(?:\s|$)"))
        return F.struct(
            F.when((x["i"] > 0) & named, name).otherwise((n + 1).cast("string")).alias("id"), F.regexp_extract(line, TIMING, 1).alias("start"), F.regexp_extract(line, TIMING, 2).alias("end"),
            T.stripped(F.array_join(F.slice(x["b"], x["i"] + 2, F.size(x["b"])), " ")).alias("text"), T.stripped(F.regexp_extract(line, TIMING, 3)).alias("settings"))

    return F.transform(timed, cue).cast(CUE)


def spans(typed: DataFrame, native: DataFrame) -> DataFrame:
    """(doc_id, node_id, precision, evidence): the first native span (doc_id, ord, start, end) that each node's lines overlap."""
    met = typed.join(native, "doc_id", "left").where("ord IS NULL OR (start <= line_end AND end >= line_start)").groupBy("doc_id", "node_id").agg(F.min("ord").alias("ord"))
    told = typed.select("doc_id", "node_id", "type").join(met, ["doc_id", "node_id"], "left")
    return told.select("doc_id", "node_id", "type", F.when(F.col("ord").isNull(), "line").otherwise("native").alias("precision"), F.col("ord").alias("evidence"))


def coverage(found: DataFrame) -> DataFrame:
    """(doc_id, nodes, covered, ratio, types): how many nodes have native evidence."""
    return found.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("precision") == "native").alias("covered"), F.count_distinct("type").alias("types")).withColumn("ratio", F.col("covered") / F.col("nodes"))


def node_faults(typed: DataFrame) -> DataFrame:
    """(doc_id, code): documents whose nodes are not numbered in turn, overlap, or have lines out of order."""
    order = Window.partitionBy("doc_id").orderBy("n")
    seen = typed.withColumns({"place": F.row_number().over(order) - 1, "before": F.lag("line_end").over(order)})
    code = F.when(F.col("n") != F.col("place"), "ids_not_sequential").when(F.col("line_end") < F.col("line_start"), "lines_reversed").when(F.col("before") >= F.col("line_start"), "nodes_overlap")
    return seen.select("doc_id", code.alias("code")).where("code IS NOT NULL").distinct()
