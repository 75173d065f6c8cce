"""Files: formats, signatures, routes, archives, and every reader on a small file of its kind."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docmill.sources import converters as C
from docmill.sources import html as H
from docmill.sources import intake as I
from docmill.sources import office as O

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def rels(**targets):
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def p(text, style="", extra=""):
    return f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{extra}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


ITEM = '<w:numPr><w:ilvl w:val="{}"/><w:numId w:val="{}"/></w:numPr>'
DOCX = packed({
    "[Content_Types].xml": "<x/>", "word/_rels/document.xml.rels": rels(r1="http://x.y"),
    "word/numbering.xml": f'<w:numbering {NS}><w:abstractNum w:abstractNumId="0"><w:lvl><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="1"><w:lvl><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="6"><w:abstractNumId w:val="1"/></w:num></w:numbering>',
    "word/document.xml": f'<w:document {NS}><w:body>{p("Title", "Heading1")}{p("one", "", ITEM.format(0, 5))}{p("two", "", ITEM.format(1, 6))}<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> and </w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>'
    f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("wide")}</w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr>{p("tall")}</w:tc></w:tr><w:tr><w:tc>{p("a|b")}</w:tc><w:tc>{p("c")}</w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr>{p("")}</w:tc></w:tr></w:tbl></w:body></w:document>'})


def slide(*shapes):
    return f"<p:sld {NS}>" + "".join("<p:sp>" + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in s) + "</p:sp>" for s in shapes) + "</p:sld>"


PPTX = packed({
    "[Content_Types].xml": "<x/>", "ppt/presentation.xml": f'<p:presentation {NS}><p:sldId r:id="b"/><p:sldId r:id="a"/></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(a="slides/slide1.xml", b="slides/slide2.xml"),
    "ppt/slides/slide1.xml": slide(["Last"]), "ppt/slides/slide2.xml": slide(["First", "sub", "sub"], ["body"]), "ppt/slides/_rels/slide2.xml.rels": rels(n="../notesSlides/notesSlide1.xml"), "ppt/notesSlides/notesSlide1.xml": slide(["say this"])})
XLSX = packed({
    "[Content_Types].xml": "<x/>", "xl/workbook.xml": f'<workbook {SHEET}><sheets><sheet name="S" r:id="a"/><sheet name="Empty" r:id="b"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(a="worksheets/sheet1.xml", b="worksheets/sheet2.xml"),
    "xl/sharedStrings.xml": f"<sst {SHEET}><si><t>na</t><r><t>me</t></r></si></sst>", "xl/worksheets/sheet2.xml": f"<worksheet {SHEET}><sheetData/></worksheet>",
    "xl/worksheets/sheet1.xml": f'<worksheet {SHEET}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.5</v></c></row><row/><row><c r="B3" t="inlineStr"><is><t>x</t></is></c><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>'})
EPUB = packed({
    "mimetype": "application/epub+zip", "META-INF/container.xml": '<c xmlns="u"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></c>',
    "O/p.opf": '<package xmlns="u"><manifest><item id="1" href="one.xhtml"/><item id="2" href="two.xhtml"/></manifest><spine><itemref idref="2"/><itemref idref="1"/></spine></package>', "O/one.xhtml": "<h1>One</h1>", "O/two.xhtml": "<p>Two</p>"})


def test_office_readers():
    assert O.docx(DOCX) == "# Title\n\n- one\n  1. two\n\n**bold** and [link](http://x.y)\n\n| wide | wide | tall |\n| --- | --- | --- |\n| a\\|b | c | tall |\n"
    assert O.pptx(PPTX) == "# Slide 1: First\n\nsub\n\nbody\n\n## Notes\n\nsay this\n\n# Slide 2: Last\n"
    assert O.xlsx(XLSX) == "## S\n\n| name |  | 3.5 |\n| --- | --- | --- |\n|  | x | TRUE |\n"
    assert O.epub(EPUB) == "Two\n\n# One\n"


def test_files_are_read_by_route(spark):
    files = [("/d/a.docx", DOCX), ("/d/b.PPTX", PPTX), ("/d/c.xlsx", XLSX), ("/d/e.epub", EPUB), ("/d/x.docx", b"PK broken"), ("/d/h.html", b"<!DOCTYPE html><p>x"), ("/d/t.txt", b"text"), ("/d/fake.pdf", b"no"), ("/d/real.pdf", b"%PDF-1"), ("/d/wrong.txt", b"<html>"), ("/d/none", DOCX), ("/d/z.xyz", b""), ("/d/.hidden", b"")]
    df = I.formats(spark.createDataFrame([(n, bytearray(b)) for n, b in files], "path string, content binary"))
    told = I.routes(df.join(I.sniffed(df), "path"))
    got = {r["path"][3:]: (r["format"], r["source_type"], r["route"], r["reason"]) for r in told.collect()}
    assert got == {
        "a.docx": ("docx", "pdf_like", "office_xml", ""), "b.PPTX": ("pptx", "generic_block", "office_xml", ""), "c.xlsx": ("xlsx", "pdf_like", "office_xml", ""), "e.epub": ("ebook", "pdf_like", "epub", ""), "x.docx": ("docx", "pdf_like", "office_xml", ""),
        "h.html": ("html", "generic_block", "direct", ""), "t.txt": ("text", "generic_block", "direct", ""), "fake.pdf": ("pdf", "pdf_like", "unsupported", "extension_content_mismatch"), "real.pdf": ("pdf", "pdf_like", "external_pdf", ""),
        "wrong.txt": ("text", "generic_block", "unsupported", "extension_content_mismatch"), "none": ("unknown", "generic_block", "office_xml", ""), "z.xyz": ("unknown", "generic_block", "unsupported", "no_converter"), ".hidden": ("unknown", "generic_block", "unsupported", "no_converter")}
    read = {r["path"][3:]: (r["markdown"] is not None, r["error"]) for r in O.converted(df).collect()}
    assert set(read) == {"a.docx", "b.PPTX", "c.xlsx", "e.epub", "x.docx"} and read["a.docx"] == (True, None) and not read["x.docx"][0] and "BadZipFile" in read["x.docx"][1]
    refused = I.readable(spark.createDataFrame([("/proc/x", 1), ("/d/a", 2 << 30), ("/d/proc", 1)], "path string, size long")).collect()
    assert [r["refused"] for r in refused] == ["system_path", "too_large", None]


@pytest.mark.parametrize("names", [["../x"], ["/x"], ["a", "a"], ["c:x"], [f"f{i}" for i in range(5001)]])
def test_unsafe_archives_are_refused(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "")
    with pytest.raises(ValueError):
        I.archive_of(out.getvalue())


def test_subtitles(spark):
    text = "WEBVTT\nKind: captions\n\n1\n00:01.000 --> 00:02.000\n<c>hello</c> &amp; all\n\n2\n00:02.000 --> 00:03.000\nhello & all\n\n00:03.000 --> 00:04.000\nhello & all friends\n[Music] >> next\nNOTE x\nnext" + "\n\n" + "w" * 300 + "\n" + "v" * 300
    got = spark.createDataFrame([(text,), ("",)], "t string").select(C.transcript(F.col("t")).alias("m")).collect()
    assert got[0]["m"] == "# Transcript\n\nhello & all friends\n\nnext\n\n" + "w" * 300 + "\n\n" + "v" * 300 + "\n"
    assert got[1]["m"] == "# Transcript\n\n\n"


def test_notebook():
    cells = [
        {"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "print('```')", "outputs": [{"output_type": "stream", "text": ["a\n"]}, {"output_type": "execute_result", "data": {"text/plain": "1"}}, {"output_type": "error", "ename": "E", "evalue": "v"}]},
        {"cell_type": "raw", "source": "r"}, {"cell_type": "code", "source": " ", "outputs": []}]
    assert C.notebook(json.dumps({"metadata": {"kernelspec": {"name": "R"}}, "cells": cells})) == "# T\nx\n\n````r\nprint('```')\n````\n\n## Cell 2 Output\n\n```text\na\n1\nE: v\n```\n\n## Cell 3 (raw)\n\nr\n"
    assert C.notebook("{}") == "\n"


def test_html_keeps_links_and_images():
    page = '<header>no</header><main><h2>A <a href="/x">link</a></h2><p>see <a href="y"></a> <img src="i.png" alt="pic"></p><ul><li>one<li>two</ul><div><a href="z"><p>whole</p></a></div><a>bare</a></main>'
    assert H.markdown_of(page) == "## A [link](/x)\n\nsee [y](y) ![pic](i.png)\n\none\n\n- - two".replace("- - two", "- two") + "\n\nwhole\n\nbare"
    assert H.markdown_of("<nav>only this</nav>") == "only this"


def test_html_tables():
    text = "a\n<TABLE><tr><th>k|</th><th>v</th></tr><tr><td>1</td></tr><tr></tr></table>\nb <table></table> <table><tr><td>open"
    got, n = H.tables_to_markdown(text)
    assert n == 1 and got == "a\n\n| k\\| | v |\n| --- | --- |\n| 1 |  |\n\nb <table></table> <table><tr><td>open"
    assert H.tables_to_markdown(None) == ("", 0)
