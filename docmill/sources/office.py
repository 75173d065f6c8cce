"""Office and e-book files to Markdown, from the XML in their archives."""

from __future__ import annotations

import posixpath
import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from docmill.sources.html import grid, markdown_of
from docmill.sources.intake import archive_of, read_entry

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def _xml(archive, name: str):
    return ElementTree.fromstring(read_entry(archive, name)) if name in archive.namelist() else None


def _links(archive, part: str) -> dict[str, str]:
    """Relation id → target of a part."""
    folder, name = posixpath.split(part)
    rels = _xml(archive, f"{folder}/_rels/{name}.rels")
    return {} if rels is None else {r.get("Id"): r.get("Target", "") for r in rels.iter(_REL)}


def _run(r) -> str:
    text = "".join("\t" if t.tag == _W + "tab" else "\n" if t.tag == _W + "br" else t.text or "" for t in r if t.tag in (_W + "t", _W + "tab", _W + "br"))
    style = r.find(_W + "rPr")
    on = lambda name: style is not None and (x := style.find(_W + name)) is not None and x.get(_W + "val") not in ("0", "false")
    if text.strip():
        for name, mark in (("strike", "~~"), ("i", "*"), ("b", "**")):
            if on(name):
                text = f"{mark}{text.strip()}{mark}"
    return text


def _paragraph(p, links: dict[str, str], ordered: dict[str, bool]) -> str:
    parts = []
    for child in p:
        if child.tag == _W + "r":
            parts.append(_run(child))
        elif child.tag == _W + "hyperlink":
            label, target = "".join(map(_run, child.iter(_W + "r"))), links.get(child.get(_R + "id"), "")
            parts.append(f"[{label}]({target})" if target and label else label)
    text = "".join(parts).strip()
    style = p.find(f"{_W}pPr/{_W}pStyle")
    level = re.fullmatch(r"(?i)heading\s*([1-6])", style.get(_W + "val", "")) if style is not None else None
    if level and text:
        return "#" * int(level[1]) + " " + text
    number = p.find(f"{_W}pPr/{_W}numPr")
    if number is not None and text:
        ident, depth = number.find(_W + "numId"), number.find(_W + "ilvl")
        mark = "1. " if ordered.get(ident.get(_W + "val") if ident is not None else "", False) else "- "
        return "  " * int(depth.get(_W + "val", "0") if depth is not None else 0) + mark + text
    return text


def _numbering(archive) -> dict[str, bool]:
    """List id → whether its items are numbered."""
    root = _xml(archive, "word/numbering.xml")
    if root is None:
        return {}
    kinds = {a.get(_W + "abstractNumId"): (f.get(_W + "val") if (f := a.find(f"{_W}lvl/{_W}numFmt")) is not None else "") for a in root.iter(_W + "abstractNum")}
    return {n.get(_W + "numId"): kinds.get(n.find(_W + "abstractNumId").get(_W + "val"), "") not in ("", "bullet", "none") for n in root.iter(_W + "num") if n.find(_W + "abstractNumId") is not None}


def merged_cells(rows: list[list[tuple[str, int, str | None]]]) -> list[list[str]]:
    """Cells (text, columns taken, vertical merge: "restart", "continue" or null) as a full grid: wide cells repeat, merged ones take the cell above."""
    out: list[list[str]] = []
    for row in rows:
        line: list[str] = []
        for text, wide, merge in row:
            for _ in range(max(wide, 1)):
                above = out[-1][len(line)] if out and len(line) < len(out[-1]) else ""
                line.append(above if merge == "continue" else text)
        out.append(line)
    return out


def docx(data: bytes) -> str:
    """Paragraphs, headings, lists, links, emphasis and tables of a text document."""
    archive = archive_of(data)
    links, ordered = _links(archive, "word/document.xml"), _numbering(archive)
    body = _xml(archive, "word/document.xml").find(_W + "body")
    parts = []
    for child in body if body is not None else ():
        if child.tag == _W + "p":
            parts.append(_paragraph(child, links, ordered))
        elif child.tag == _W + "tbl":
            rows = []
            for tr in child.iter(_W + "tr"):
                row = []
                for tc in tr.findall(_W + "tc"):
                    span, merge = tc.find(f"{_W}tcPr/{_W}gridSpan"), tc.find(f"{_W}tcPr/{_W}vMerge")
                    text = " ".join(filter(None, (_paragraph(p, links, ordered) for p in tc.findall(_W + "p")))).replace("|", "\\|").replace("\n", " ")
                    row.append((text, int(span.get(_W + "val", "1")) if span is not None else 1, None if merge is None else merge.get(_W + "val", "continue")))
                rows.append(row)
            parts.append(grid(merged_cells(rows)))
    return re.sub(r"(?m)(^\s*(?:- |1\. ).*)\n\n(?=\s*(?:- |1\. ))", r"\1\n", "\n\n".join(filter(None, parts))) + "\n"


def _shapes(root) -> list[str]:
    """Texts of the shapes, in order, each paragraph once."""
    out = []
    for shape in root.iter(_P + "sp"):
        lines = ["".join(t.text or "" for t in p.iter(_A + "t")).strip() for p in shape.iter(_A + "p")]
        if text := "\n".join(dict.fromkeys(filter(None, lines))):
            out.append(text)
    return out


def pptx(data: bytes) -> str:
    """Slides in order of the presentation: title, shapes, notes."""
    archive = archive_of(data)
    names = archive.namelist()
    links, root = _links(archive, "ppt/presentation.xml"), _xml(archive, "ppt/presentation.xml")
    order = [posixpath.normpath(f"ppt/{links[s.get(_R + 'id')]}") for s in root.iter(_P + "sldId") if s.get(_R + "id") in links] if root is not None else []
    order = order or sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    parts = []
    for n, name in enumerate(order, 1):
        shapes = _shapes(_xml(archive, name))
        parts.append(f"# Slide {n}" + (f": {shapes[0].splitlines()[0]}" if shapes else ""))
        parts += [s for s in (["\n".join(shapes[0].splitlines()[1:]), *shapes[1:]] if shapes else []) if s]
        for target in _links(archive, name).values():
            if "notesSlide" in target and (notes := _shapes(_xml(archive, posixpath.normpath(posixpath.join(posixpath.dirname(name), target))))):
                parts += ["## Notes", *notes]
    return "\n\n".join(parts) + "\n"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx(data: bytes) -> str:
    """One table for each sheet; rows without values are left out."""
    archive = archive_of(data)
    shared = _xml(archive, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in shared.iter(_S + "si")] if shared is not None else []
    links, book, parts = _links(archive, "xl/workbook.xml"), _xml(archive, "xl/workbook.xml"), []
    for sheet in book.iter(_S + "sheet"):
        root = _xml(archive, posixpath.normpath(f"xl/{links.get(sheet.get(_R + 'id'), '')}"))
        rows = []
        for row in root.iter(_S + "row") if root is not None else ():
            line: list[str] = []
            for c in row.findall(_S + "c"):
                value, kind = c.findtext(_S + "v", ""), c.get("t", "")
                text = strings[int(value)] if kind == "s" and value.isdigit() and int(value) < len(strings) else "".join(t.text or "" for t in c.iter(_S + "t")) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value
                line += [""] * (max(_column(c.get("r", "")), len(line) + 1) - len(line) - 1) + [text.strip().replace("|", "\\|").replace("\n", " ")]
            if any(line):
                rows.append(line)
        if rows:
            parts += [f"## {sheet.get('name', 'Sheet')}", grid(rows)]
    return "\n\n".join(parts) + "\n"


def epub(data: bytes) -> str:
    """Chapters in reading order; without one, all pages by name."""
    archive = archive_of(data)
    names, order = archive.namelist(), []
    container = _xml(archive, "META-INF/container.xml")
    package = next((r.get("full-path") for r in container.iter() if r.tag.endswith("}rootfile")), None) if container is not None else None
    if package in names:
        root, folder = _xml(archive, package), posixpath.dirname(package)
        items = {i.get("id"): posixpath.normpath(posixpath.join(folder, i.get("href", ""))) for i in root.iter() if i.tag.endswith("}item")}
        order = [items[r.get("idref")] for r in root.iter() if r.tag.endswith("}itemref") and items.get(r.get("idref")) in names]
    order = order or sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm")))
    chapters = [markdown_of(read_entry(archive, n).decode("utf-8", "replace")) for n in order]
    return "\n\n".join(filter(None, chapters)) + "\n"


READERS = {".docx": docx, ".pptx": pptx, ".xlsx": xlsx, ".epub": epub}


def converted(files: DataFrame) -> DataFrame:
    """(path, markdown, error) of files (path, extension, content) that a reader knows; a broken file gives its error."""

    def read(ext, data):
        try:
            return READERS[ext](data), None
        except Exception as e:  # whatever is wrong with one file concerns that file alone
            return None, f"{type(e).__name__}: {e}"[:200]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, ext, data in zip(*(c.to_pylist() for c in b.columns)):
                text, error = read(ext, data)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["path", "markdown", "error"])

    return files.where(files["extension"].isin(list(READERS))).select("path", "extension", "content").mapInArrow(run, "path string, markdown string, error string")
