"""Plain sources to Markdown: bytes, code, JSON, delimited text; and unclosed fences."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decoded(data: bytes) -> str:
    """Text by the first of several encodings that fits."""
    for encoding in ("utf-8", "gbk", "latin-1"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 fits everything")


def code_block(text: Column, language: Column) -> Column:
    """A fenced block whose fence is longer than any run of backticks in the text."""
    body = F.regexp_replace(text, r"(?U)\s+$", "")
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(body, F.lit("(`+)"), F.lit(1)), lambda x: F.length(x))), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))
    return F.concat(fence, language, F.lit("\n"), body, F.lit("\n"), fence, F.lit("\n"))


def closed_fences(text: Column) -> Column:
    """The text with a closing fence added where the number of fence lines is odd."""
    odd = F.size(F.filter(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+", "").startswith("```"))) % 2 == 1
    return F.when(odd, F.concat(text, F.lit("\n```"))).otherwise(text)


def subtitle_lines(text: Column) -> Column:
    """The spoken lines of a subtitle text: headers, cue numbers, timings and marks removed; an empty string stands for a break."""
    raw = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    cue = lambda x: (F.upper(x) == "WEBVTT") | F.rlike(x, F.lit(r"^\d+$")) | F.contains(x, F.lit("-->")) | F.rlike(x, F.lit("^(?:NOTE|STYLE|REGION)")) | F.rlike(x, F.lit("(?i)^(?:kind:|language:)"))

    def said(x):
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
            x = F.replace(x, F.lit(entity), F.lit(sign))
        return x

    bare = lambda x: F.regexp_replace(F.regexp_replace(F.replace(said(F.regexp_replace(x, r"<[^<>]*>", "")), F.lit(">>"), F.lit("")), r"^\[[^\]]{1,30}\]\s*", ""), r"(?U)^\s+|\s+$", "")
    kept = F.filter(F.transform(F.filter(raw, lambda x: ~cue(x)), lambda x: F.struct(x.alias("x"), F.when(x != "", bare(x)).otherwise("").alias("y"))), lambda r: (r["x"] == "") | (r["y"] != ""))
    return F.transform(kept, lambda r: r["y"])


def without_echo(lines: Column) -> Column:
    """Lines where one that repeats or continues the line said before takes its place, across breaks; breaks stand alone."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"), F.lit(0).alias("at"))

    def step(a, x):
        out, last = a["out"], a["last"]
        state = lambda o, l, i: F.struct(o.alias("out"), l.alias("last"), i.alias("at"))
        put = lambda o: F.concat(F.slice(o, F.lit(1), a["at"] - 1), F.array(x), F.slice(o, a["at"] + 1, F.size(o)))
        return F.when(x == "", F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1)) != ""), state(F.array_append(out, x), last, a["at"])).otherwise(a)).when((last == x) | ((last != "") & last.startswith(x)), a).when(
            (last != "") & x.startswith(last), state(put(out), x, a["at"])).otherwise(state(F.array_append(out, x), x, F.size(out) + 1))

    return F.aggregate(lines, start, step, lambda a: a["out"])


def paragraphs(lines: Column, most: int = 500) -> Column:
    """Lines joined to paragraphs of at most ``most`` characters, new after every break."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a, x):
        done, now = a["done"], a["now"]
        closed = F.when(now == "", done).otherwise(F.array_append(done, now))
        joined = F.when(now == "", x).otherwise(F.concat(now, F.lit(" "), x))
        return F.when(x == "", F.struct(closed.alias("done"), F.lit("").alias("now"))).when(F.length(joined) > most, F.struct(closed.alias("done"), x.alias("now"))).otherwise(F.struct(done.alias("done"), joined.alias("now")))

    return F.aggregate(lines, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def transcript(text: Column) -> Column:
    """A subtitle text as a readable transcript."""
    return F.concat(F.lit("# Transcript\n\n"), F.array_join(paragraphs(without_echo(subtitle_lines(text))), "\n\n"), F.lit("\n"))


def _joined(source) -> str:
    return "".join(map(str, source)) if isinstance(source, list) else "" if source is None else str(source)


def _fenced(text: str, language: str) -> str:
    fence = "```"
    while fence in text:
        fence += "`"
    return f"{fence}{language}\n{text}\n{fence}"


def _output(out: dict) -> str:
    kind = out.get("output_type")
    if kind == "stream":
        return _joined(out.get("text"))
    if kind in ("execute_result", "display_data"):
        return _joined(out.get("data", {}).get("text/plain"))
    if kind == "error":
        return "\n".join(map(str, out.get("traceback") or [])) or f"{out.get('ename', 'Error')}: {out.get('evalue', '')}"
    return ""


def notebook(text: str | None) -> str:
    """Cells of a notebook in order: prose as it is, code and its output fenced."""
    book = json.loads(text or "{}")
    kernel = book.get("metadata", {}).get("kernelspec", {})
    language, parts = str(kernel.get("language") or kernel.get("name") or "python").lower(), []
    for n, cell in enumerate(book.get("cells", []), 1):
        kind, source = cell.get("cell_type"), _joined(cell.get("source"))
        if kind == "code":
            shown = "\n".join(x.rstrip("\n") for x in map(_output, cell.get("outputs") or []) if x.strip())
            parts += [_fenced(source.rstrip(), language)] if source.strip() else []
            parts += [f"## Cell {n} Output\n\n" + _fenced(shown.rstrip(), "text")] if shown.strip() else []
        elif source.strip():
            parts.append(source.strip() if kind == "markdown" else f"## Cell {n} ({kind or 'unknown'})\n\n{source.strip()}")
    return "\n\n".join(parts).strip() + "\n"


def json_block(text: str | None) -> str:
    try:
        body = json.dumps(json.loads(text or ""), indent=2, ensure_ascii=False)
    except json.JSONDecodeError:
        body = (text or "").strip()
    return f"```json\n{body}\n```\n"


def table_of(text: str | None, delimiter: str = ",") -> str:
    """A Markdown table: blank rows dropped, short rows filled, the first row as head."""
    rows = [[c.strip() for c in row] for row in csv.reader(io.StringIO(text or ""), delimiter=delimiter)]
    rows = [row for row in rows if any(row)]
    if not rows:
        return ""
    width = max(map(len, rows))
    shown = ["| " + " | ".join(c.replace("|", "\\|").replace("\n", " ").strip() for c in row + [""] * (width - len(row))) + " |" for row in rows]
    return "\n".join([shown[0], "| " + " | ".join(["---"] * width) + " |", *shown[1:]]) + "\n"


def converted(rows: DataFrame, id_col: str, text_col: str, how) -> DataFrame:
    """(id, markdown) by a text → text function, in Arrow batches."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([how(x) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "markdown"])

    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, markdown string")


def files(spark, path: str) -> DataFrame:
    """(path, extension, sha256, size, content) of all files under a folder, in order of their lower-case paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content").orderBy(F.lower("path"))
