"""Files of every format that is read here, as Markdown."""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame

from docmill.sources import converters as C
from docmill.sources import intake as I
from docmill.sources import office
from docmill.sources.html import markdown_of

# Languages of code files whose extension is not their name.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".mjs": "javascript", ".cjs": "javascript", ".rs": "rust", ".cc": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".kt": "kotlin", ".kts": "kotlin", ".sh": "bash",
    ".ps1": "powershell", ".cmd": "batch", ".yml": "yaml", ".cfg": "ini"}
# end of fixed values


def transcript(text: str) -> str:
    """A subtitle text as paragraphs: what ``converters.transcript`` does for a column."""
    lines: list[str] = []
    for x in map(str.strip, re.split(r"\r\n?|\n", text)):
        if x and (x.upper() == "WEBVTT" or x.isdigit() or "-->" in x or re.match("(?:NOTE|STYLE|REGION)", x) or re.match("(?i)(?:kind:|language:)", x)):
            continue
        said = re.sub(r"^\[[^\]]{1,30}\]\s*", "", entities.unescape(re.sub(r"<[^<>]*>", "", x)).replace(">>", "")).strip()
        if said or not x:
            lines.append(said)
    out, last, at = [], "", 0
    for x in lines:
        if not x:
            out += [""] if out and out[-1] else []
        elif last and x.startswith(last):
            out[at], last = x, x
        elif not (last and last.startswith(x)):
            out.append(x)
            last, at = x, len(out) - 1
    paragraphs, now = [], ""
    for x in [*out, ""]:
        joined = f"{now} {x}".strip()
        if now and (not x or len(joined) > 500):
            paragraphs.append(now)
            now = x
        else:
            now = joined
    return "# Transcript\n\n" + "\n\n".join(paragraphs) + "\n"


def read(extension: str, data: bytes) -> str:
    """A file's content as Markdown, by its extension."""
    if extension in office.READERS:
        return office.READERS[extension](data)
    text, form = C.decoded(data), I.BY_EXTENSION.get(extension, "text")
    if extension in (".csv", ".tsv"):
        return C.table_of(text, "\t" if extension == ".tsv" else ",")
    if form == "code":
        return C._fenced(text.rstrip(), LANGUAGES.get(extension, extension[1:])) + "\n"
    return {"html": lambda t: markdown_of(t) + "\n", "json": C.json_block, "notebook": C.notebook, "subtitle_transcript": transcript}.get(form, str)(text)


def converted(files: DataFrame) -> DataFrame:
    """(path, markdown, error) of files (path, extension, route, content) that are read here; a broken file gives its error."""

    def one(extension, data):
        try:
            return read(extension, bytes(data or b"")), None
        except Exception as e:  # whatever is wrong with one file concerns that file alone
            return None, f"{type(e).__name__}: {e}"[:200]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, extension, data in zip(*(c.to_pylist() for c in b.columns)):
                text, error = one(extension, data)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["path", "markdown", "error"])

    return files.where(files["route"].isin("direct", "office_xml", "epub")).select("path", "extension", "content").mapInArrow(run, "path string, markdown string, error string")
