"""What is written and checked around cleaned documents: clean views, assets, titles, chunk files, proposals, review answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T

# What a title may not be, and what speaks for one.
TITLE_SPLIT = ["Anthropic", "Claude", "Building an", "译", "横版", "中文译本", "仅供", "内部研究"]
TITLE_REJECT = ["Anthropic", "Claude", "译", "中文译本", "仅供", "内部研究", "YouTube", "目录", r"Chapter\d*", "Resources"]
TITLE_NEVER = {"目录", "资源", "Resources", "Contents"}
TITLE_WORDS = ["手册", "指南", "报告", "白皮书", "行动", "Playbook", "Guide", "Manual", "Report"]
VIDEO_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com"]
# end of fixed values
TITLE_LINES = 80


def normalized(text: Column) -> Column:
    """Text as nodes and blocks are compared: without heading marks, list marks and surplus white space, in lower case."""
    return F.lower(T.stripped(F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*(?:#{1,6}|[-*+]|>)\s+", ""), r"(?U)\s+", " ")))


def clean_view(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, node_id, ordinal): blocks in order of the nodes they match, then the others.

    Nodes take the first block of their text that no node before has taken: the k-th node of a text meets the k-th block of it.
    """
    nth = lambda at: F.row_number().over(Window.partitionBy("doc_id", "norm").orderBy(at))
    n = nodes.withColumn("norm", normalized(F.col("text"))).where("norm <> ''").select("doc_id", "norm", "node_id", "n", nth("n").alias("k"))
    b = blocks.withColumn("norm", normalized(F.col("text"))).select("doc_id", "norm", "block_idx", nth("block_idx").alias("k"))
    met = b.join(n, ["doc_id", "norm", "k"], "left")
    order = Window.partitionBy("doc_id").orderBy(F.col("n").asc_nulls_last(), "block_idx")
    return met.select("doc_id", "block_idx", "node_id", F.row_number().over(order).cast("long").alias("ordinal"))


def view_faults(view: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, status, reason, missing, extra, repeated): whether a view (doc_id, block_id) lists every block once."""
    v = view.groupBy("doc_id", "block_id").agg(F.count("*").alias("times"))
    met = v.join(blocks.select("doc_id", "block_id", F.lit(True).alias("known")).distinct(), ["doc_id", "block_id"], "full")
    g = met.groupBy("doc_id").agg(F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("known").isNull()).alias("extra"), F.count_if(F.col("times") > 1).alias("repeated"))
    reason = F.when(F.col("repeated") > 0, "clean_view_inconsistent").when((F.col("missing") > 0) | (F.col("extra") > 0), "clean_view_incomplete").otherwise("clean_view_covers_blocks")
    return g.select("doc_id", F.when(reason == "clean_view_covers_blocks", "pass").otherwise("fail").alias("status"), reason.alias("reason"), "missing", "extra", "repeated")


def document_gate(faults: DataFrame, rejected: DataFrame, rendered: DataFrame) -> DataFrame:
    """(doc_id, status, blocks_publication): fails with a faulty view or without a text, warns with rejected patches (doc_id, rejected)."""
    met = faults.select("doc_id", "status").join(rejected, "doc_id", "left").join(rendered.select("doc_id", F.lit(True).alias("text")), "doc_id", "left")
    status = F.when((F.col("status") == "fail") | F.col("text").isNull(), "fail").when(F.coalesce("rejected", F.lit(0)) > 0, "warn").otherwise("pass")
    return met.select("doc_id", status.alias("status"), (status == "fail").alias("blocks_publication"))


def conversion_gate(measures: DataFrame) -> DataFrame:
    """``measures`` (unreadable_text_ratio, chars) with status: text too short or too damaged is not cleaned."""
    bad = F.col("unreadable_text_ratio")
    status = F.when((F.col("chars") < 20) | (bad > 0.08), "fail").when(bad > 0.03, "warn").otherwise("pass")
    code = F.when(F.col("chars") < 20, "E_CONVERTED_TEXT_TOO_SHORT").when(bad > 0.08, "E_CONVERTED_TEXT_UNREADABLE").when(bad > 0.03, "W_SOURCE_TEXT_LAYER")
    return measures.withColumns({"status": status, "code": code})


def image_assets(docs: DataFrame, listing: DataFrame) -> DataFrame:
    """(doc_id, src, status): every image address of a text (standard and wiki references) against a listing of files (src)."""
    refs = F.concat(F.transform(F.regexp_extract_all("text", F.lit(T.IMAGE), F.lit(2)), lambda x: F.regexp_extract(T.stripped(x), r"^<?([^\s>]+)", 1)), F.transform(F.regexp_extract_all("text", F.lit(r"!\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"), F.lit(1)), T.stripped))
    each = docs.select("doc_id", F.explode(F.array_distinct(refs)).alias("src"))
    remote, escapes = F.rlike("src", F.lit("^(?i:https?:|data:|//)")), F.rlike("src", F.lit(r"^/|(?:^|/)\.\.(?:/|$)"))
    met = each.join(listing.select("src", F.lit(True).alias("there")).distinct(), "src", "left")
    return met.select("doc_id", "src", F.when(remote, "remote").when(escapes, "refused").when(F.col("there"), "copied").otherwise("missing").alias("status"))


def video_id(url: Column) -> Column:
    """The id in a video's address, or an empty string."""
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, r"^https?://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"^https?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"[?&]v=([^&#]*)", 1)
    found = F.when(host == "youtu.be", F.regexp_extract(path, "^/*([^/]*)", 1)).when(host.isin(VIDEO_HOSTS) & (path == "/watch"), query).when(host.isin(VIDEO_HOSTS), F.regexp_extract(path, "^/(?:shorts|embed)/([^/?#]+)", 1)).otherwise("")
    return F.substring(F.regexp_replace(found, "[^A-Za-z0-9_-]+", ""), 1, 64)


def chunk_file(number: Column, text: Column, fields: dict[str, Column]) -> Column:
    """A chunk as a file: front matter with plain values, then the text."""
    plain = lambda c: F.when(F.rlike(c, F.lit("^[A-Za-z0-9_-]+$")), c).otherwise(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    lines = [F.concat(F.lit(f"{k}: "), plain(c.cast("string"))) for k, c in {"chunk_id": F.format_string("c_%04d", number), **fields}.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), text, F.lit("\n"))


def fits(value: Column, pattern: Column, match: Column) -> Column:
    return F.when(match == "literal", F.contains(F.lower(value), F.lower(pattern))).otherwise(F.rlike(value, F.concat(F.lit("(?iuU)"), pattern)))


def proposals(rows: DataFrame) -> DataFrame:
    """Proposals (id, action, match, pattern, examples, counterexamples) with ok, misses, hits and narrowed.

    One may be accepted if its pattern fits all examples and no counterexample. A literal that fits counterexamples is narrowed to
    the shortest example that holds it and stands in none of them.
    """
    own = lambda x: fits(x, F.col("pattern"), F.col("match"))
    told = rows.withColumns({"misses": F.size(F.filter("examples", lambda x: ~own(x))).cast("long"), "hits": F.size(F.filter("counterexamples", own)).cast("long")})
    longer = F.filter("examples", lambda x: (x != F.col("pattern")) & F.contains(F.lower(x), F.lower("pattern")) & ~F.exists("counterexamples", lambda c: F.contains(F.lower(c), F.lower(x))))
    shortest = F.array_min(F.transform(longer, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return told.withColumns({"ok": (F.col("misses") == 0) & (F.col("hits") == 0), "narrowed": F.when((F.col("action") == "discard") & (F.col("hits") > 0) & (F.col("match") == "literal"), F.substring(shortest, 1, 120))})


def rule_effect(rules: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, docs, status): after a rerun a discarding literal stands in no cleaned text (body), a protecting one in some."""
    few = [(r["id"], r["action"], r["pattern"]) for r in rules.select("id", "action", "pattern").collect()]  # rules that a user has accepted
    if not few:
        return rules.select("id", F.lit(0).cast("long").alias("docs"), F.lit("").alias("status")).limit(0)
    counts = texts.agg(*[F.count_if(F.contains(F.lower("body"), F.lit(p.lower()))).alias(f"n{k}") for k, (_, _, p) in enumerate(few)])
    held = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(a).alias("action"), F.col(f"n{k}").alias("docs")) for k, (i, a, _) in enumerate(few)])
    rows = counts.select(F.inline(held))
    good = F.when(F.col("action") == "discard", F.col("docs") == 0).otherwise(F.col("docs") > 0)
    return rows.select("id", "docs", F.when(good, "passed").otherwise("failed").alias("status"))


_SPACES = re.compile(r"\s+")


def _candidate(text: str) -> str | None:
    text = _SPACES.sub(" ", text.strip().strip("#*-_ \t"))
    if tail := re.search(r"[A-Za-z][A-Za-z'’ -]{3,}([一-鿿][一-鿿A-Za-z0-9《》「」：:·\- ]{2,39})$", text):
        text = tail[1].strip()
    text = re.split("|".join(TITLE_SPLIT), text, maxsplit=1, flags=re.I)[0].strip().strip(" ·:：-—_")
    return text if text and not re.fullmatch(r"\d{1,4}", text) else None


def best_title(text: str | None) -> str | None:
    """The likeliest title among the first lines: early, of fair length, with a title's words and without sentences."""
    found: list[tuple[int, int, str]] = []
    for n, line in enumerate((text or "").splitlines()[:TITLE_LINES]):
        line = line.strip()
        if re.fullmatch(r"(?i)<!--\s*page:\s*\d+\s*-->", line) or not (line := re.sub(r"^#{1,6}\s*", "", line).strip()):
            continue
        parts = [line, *(line.split(d, 1)[0] for d in ("✻", "|", "｜") if d in line), *re.findall(r"[一-鿿][一-鿿A-Za-z0-9《》「」：:·\- ]{2,39}", line)]
        for title in dict.fromkeys(filter(None, map(_candidate, parts))):
            tight = _SPACES.sub("", title)
            if 4 <= len(tight) <= 40 and tight not in TITLE_NEVER and not re.search("|".join(TITLE_REJECT), tight, re.I):
                score = 100 - min(n, 30) + 15 * bool(re.search("|".join(TITLE_WORDS), title, re.I)) - 40 * bool(re.search("[。！？!?；;]", title))
                found.append((score, -n, title))
    return max(found)[2] if found and max(found)[0] > 0 else None


def json_patch(messages: list) -> list[dict] | None:
    """The operations in the last message that holds a JSON array of them; fenced parts of a message come first."""
    decoder = json.JSONDecoder()

    def arrays(text: str):
        for at in (m.start() for m in re.finditer(r"\[", text)):
            try:
                yield decoder.raw_decode(text, at)[0]
            except ValueError:
                continue

    for message in reversed(messages):
        said = message if isinstance(message, str) else next((message[k] for k in ("content", "text", "message", "body") if isinstance(message.get(k), str)), json.dumps(message)) if isinstance(message, dict) else json.dumps(message)
        for part in (*re.findall(r"```(?:json)?\s*([\s\S]*?)```", said, re.I), said):
            if (first := next(arrays(part.strip()), None)) is not None:
                if all(isinstance(x, dict) and "op" in x and "path" in x for x in first):
                    return first
                break
    return None
