"""HTML to Markdown: a tree of the page, walked once into pieces of text and breaks between lines."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

# Elements left out, and those that stand on lines of their own.
SKIPPED = {"script", "style", "svg", "noscript", "nav", "header", "footer"}
BLOCKS = {"article", "main", "section", "p", "div", "blockquote", "tr"}
# end of fixed values
LISTS = {"ul", "ol", "table"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}


class _Tree(HTMLParser):
    """Builds (tag, attributes, children) nodes; what is never closed ends with what holds it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ("", {}, [])
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = (tag, {k: v for k, v in attrs if v is not None}, [])
        self.open[-1][2].append(node)
        if tag not in EMPTY:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append((tag, {k: v for k, v in attrs if v is not None}, []))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if text := " ".join(data.split()):
            self.open[-1][2].append(text)


def _pieces(nodes: list) -> Iterator[tuple[str, str]]:
    """("text", piece) and ("end", mark): a line ends, with the mark that stands before it."""
    for node in nodes:
        if isinstance(node, str):
            yield "text", node
            continue
        tag, attributes, children = node
        if tag in SKIPPED:
            continue
        if tag == "br":
            yield "end", ""
        elif tag == "img":
            if src := attributes.get("src", "").strip():
                yield "text", f"![{(attributes.get('alt') or attributes.get('title') or '').strip()}]({src})"
        elif tag == "a" and (href := attributes.get("href", "").strip()):
            inner = list(_pieces(children))
            if any(kind == "end" for kind, _ in inner):  # a link around whole lines stays text
                yield from inner
            else:
                yield "text", f"[{' '.join(piece for _, piece in inner) or href}]({href})"
        else:
            mark = HEADINGS.get(tag, "- " if tag == "li" else "")
            if mark or tag in BLOCKS:
                yield "end", ""
            yield from _pieces(children)
            if mark or tag in BLOCKS or tag in LISTS:
                yield "end", mark


def _lines(pieces: Iterator[tuple[str, str]]) -> Iterator[str]:
    held, before = [], None
    for kind, piece in (*pieces, ("end", "")):
        if kind == "text":
            held.append(piece)
        elif held:
            line, held = piece + " ".join(held), []
            if line != before:
                yield line
            before = line


def markdown_of(html: str | None) -> str:
    """Lines of the page, equal consecutive ones once; the bare text where no line is left."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    if shown := "\n\n".join(_lines(_pieces(tree.root[2]))):
        return shown
    return " ".join(_texts(tree.root))


def _texts(node) -> Iterator[str]:
    for child in node[2]:
        yield from (child,) if isinstance(child, str) else _texts(child)


def table_rows(html: str) -> list[list[str]]:
    """Cells of the first table of a piece of HTML, pipes escaped; rows without cells are left out."""
    tree = _Tree()
    tree.feed(html)
    tree.close()

    def rows(node, inside):
        for child in node[2]:
            if isinstance(child, tuple):
                if child[0] == "tr" and inside:
                    if cells := [" ".join(" ".join(_texts(c)).split()).replace("|", "\\|") for c in child[2] if isinstance(c, tuple) and c[0] in ("td", "th")]:
                        yield cells
                else:
                    yield from rows(child, inside or child[0] == "table")

    return list(rows(tree.root, False))


def grid(rows: list[list[str]]) -> str:
    """A Markdown table, the first row as head, short rows filled."""
    width = max(map(len, rows), default=0)
    shown = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([*shown[:1], "| " + " | ".join(["---"] * width) + " |", *shown[1:]]) if rows else ""


def tables_to_markdown(text: str | None) -> tuple[str, int]:
    """(the text with its outermost HTML tables as Markdown, how many were turned)."""
    import re

    text, out, at, n = text or "", [], 0, 0
    for opening in re.finditer(r"(?i)<table\b", text):
        if opening.start() < at:
            continue
        depth, end = 0, None
        for tag in re.finditer(r"(?i)<(/?)table\b[^>]*>", text[opening.start() :]):
            depth += -1 if tag[1] else 1
            if not depth:
                end = opening.start() + tag.end()
                break
        if end is None or not (shown := grid(table_rows(text[opening.start() : end]))):
            continue
        out += [text[at : opening.start()], "\n", shown, "\n"]
        at, n = end, n + 1
    return "".join([*out, text[at:]]), n


def to_markdown(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, markdown) for every page, in Arrow batches."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([markdown_of(x) for x in part.column(1).to_pylist()], pa.string())], names=[id_col, "markdown"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, markdown string")
