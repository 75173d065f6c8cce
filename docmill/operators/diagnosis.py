"""What a text is: quality measures, profile, document type, content form, title; and the fixes of its form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import signals as S
from docmill.functions import text as T

SAMPLE = 200_000
ALIAS = "array<struct<score:int,name:string>>"


def _hits(text: Column, pattern: str, flags: str = "") -> Column:
    return T.count(text, f"(?U{flags}){pattern}" if flags or "\\" in pattern else pattern)


def _length(text: Column, pattern: str) -> Column:
    """Characters in matches of a pattern."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def text_measures(text: Column | T.Read) -> dict[str, Column]:
    """Counts and shares that tell readable text from damaged text; shares are not rounded.

    Of a text that was read once, what only wide or unusual characters can make is counted in texts that hold such.
    """
    t, text = text, text.text if isinstance(text, T.Read) else text
    here = lambda found, c: F.when(found, c).otherwise(F.when(text.isNotNull(), F.lit(0).cast("long")))
    wide = t.wide if isinstance(t, T.Read) else T.is_wide(text)
    n = F.length(text)
    share = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    garbled = T.garbled_count(text)
    rare = here(T.is_unusual(text), T.count(text, r"[\p{C}&&[^\x{0}-\x{7f}]]|\x{fffd}"))
    mojibake = here(wide, F.greatest(_length(text, S.MOJIBAKE_SEQUENCE), T.count(text, S.MOJIBAKE_CHARACTER), _length(text, "|".join(S.MOJIBAKE_TOKENS))))
    replaced = F.when(F.contains(text, F.lit("\ufffd")), T.count(text, "\ufffd")).otherwise(F.when(text.isNotNull(), F.lit(0).cast("long")))
    said = T.count(text, T.CJK) + T.count(text, "[a-zA-Z0-9]")
    lost = F.when((replaced > 0) & (share(said) < 0.20), share(replaced)).otherwise(F.lit(0.0))
    confused = F.when(F.contains(text, F.lit("Al")) | F.contains(text, F.lit("A时代")), T.count(text, f"(?U){S.OCR_CONFUSION}")).otherwise(F.when(text.isNotNull(), F.lit(0).cast("long")))
    return {
        "garbled_chars": garbled, "mojibake_chars": mojibake, "garbled_ratio": share(garbled), "non_common_unicode_ratio": share(rare), "replacement_char_ratio": share(replaced), "mojibake_ratio": share(mojibake),
        "unreadable_text_ratio": F.greatest(share(garbled), share(rare), share(mojibake), lost), "ocr_confusions": confused,
        "has_qr_text": T.matches(t, "|".join([*S.QR_MARKERS, *S.IMAGE_QR])), "has_cta_text": T.contains_any(t, T.CTA) | T.matches(t, "|".join(f"(?:{p})" for _, p in T.PROMO)),
    }


def text_profile(text: Column, source_format: Column) -> tuple[dict[str, Column], Column]:
    """(counts, profile): a shape by counts first, then by terms, then by length."""
    n = lambda p, flags="": T.count(text, f"(?dmU{flags}){p}")
    english = n(T.EN_STEP_LINE, "iu")
    counts = {
        "char_count": F.length(text).cast("long"), "heading_count": n(r"^#{1,6}\s+"), "numbered_step_count": n(T.STEP_LINE) + english, "timestamp_line_count": n(r"^\s*(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"),
        "speaker_line_count": n(r"^\s*[^:\n：]{1,24}[：:]\s+\S+"), "table_row_count": n(r"^\|.+\|$"),
    }
    long = F.col("char_count") > 12_000
    has = lambda terms: T.contains_any(text, terms)
    profile = F.when((F.col("heading_count") >= 8) & long, "ebook_or_long_report").when((source_format == "subtitle_transcript") | (F.col("timestamp_line_count") >= 3) | (F.col("speaker_line_count") >= 8), "transcript").when(
        has(S.TUTORIAL_TERMS) | (F.col("numbered_step_count") >= 3) | (F.col("english_steps") > 0), "tutorial").when(has(S.MEETING_TERMS), "meeting_or_interview").when(has(S.NOTE_TERMS), "note").when(
        has(S.EBOOK_TERMS) & long, "ebook_or_long_report").when(F.col("char_count") < 4_000, "short_text").otherwise("long_text")
    return counts | {"english_steps": english}, profile


def type_scores(text: Column, source_type: Column, source_format: Column) -> Column:
    """array<struct<score, name>>: what speaks for each document type, in the order of the types."""
    sample = F.substring(text, 1, SAMPLE)
    points = {name: F.lit(0) for name in S.DOCUMENT_TYPES}
    for column, hints in ((source_type, S.SOURCE_HINTS), (source_format, S.FORMAT_HINTS)):
        for value, name, score in hints:
            points[name] = points[name] + F.when(F.lower(column) == value, score).otherwise(0)
    for name, score, pattern, flags in S.TYPE_PATTERNS:
        points[name] = points[name] + F.when(F.rlike(sample, F.lit(f"(?dU{flags}{'u' if 'i' in flags else ''}){pattern}")), score).otherwise(0)
    return F.array(*[F.struct(points[n].cast("int").alias("score"), F.lit(n).alias("name")) for n in S.DOCUMENT_TYPES]).cast(ALIAS)


def document_type(docs: DataFrame, text: str = "text", source_type: str = "source_type", source_format: str = "source_format") -> DataFrame:
    """``docs`` with document_type, confidence, usable (for choosing rules) and candidates by falling score, then name.

    Of equal scores the type that comes first in the list of types wins.
    """
    scored = docs.withColumn("_s", type_scores(F.col(text), F.col(source_type), F.col(source_format)))
    best = F.array_max(F.transform("_s", lambda x, i: F.struct(x["score"].alias("score"), (-i).alias("place"), x["name"].alias("name"))))
    told = scored.withColumn("_b", best)
    known = F.col("_b.score") > 0
    confidence = F.when(known, F.round(F.least(F.lit(0.95), F.lit(0.35) + F.col("_b.score") / 12), 3)).otherwise(F.lit(0.1))
    ranked = F.array_sort(F.transform("_s", lambda x: F.struct((-x["score"]).alias("score"), x["name"].alias("name"))))
    return told.withColumns({"document_type": F.when(known, F.col("_b.name")).otherwise("unknown"), "confidence": confidence, "usable": known & (confidence >= 0.5), "candidates": F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["name"], -x["score"])), ",")}).drop("_s", "_b")


def content_evidence(text: Column) -> dict[str, Column]:
    """Counts from which the content form follows."""
    n = lambda p: T.count(text, f"(?dmU){p}")
    return {
        "line_count": F.size(F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1), lambda x: T.stripped(x) != "")).cast("long"), "heading_count": n(r"^#{1,6}\s+\S+"), "link_count": n(r"\[[^\]]+\]\([^)]+\)|https?://"),
        "table_row_count": n(r"^\s*\|.+\|\s*$"), "code_fence_count": F.floor(T.count(text, "```") / 2).cast("long"), "timestamp_count": n(r"^\s*\d{1,2}:\d{2}\b"),
    }


def content_form() -> Column:
    """The dominant layout, from the columns of ``content_evidence``."""
    dense = F.col("heading_count") / F.greatest("line_count", F.lit(1)) >= 0.3
    return F.when(F.col("code_fence_count") >= 2, "code").when(F.col("table_row_count") >= 5, "table_heavy").when(F.col("timestamp_count") >= 3, "transcript").when((F.col("heading_count") >= 3) & dense, "outline").when(F.col("line_count") >= 3, "prose").otherwise("mixed")


def ocr_fixes(text: Column) -> tuple[Column, list[Column]]:
    """(the text after all fixes, how many each made), one fix after the other."""
    counts = []
    for pattern, new in S.OCR_FIXES:
        java = f"(?U){pattern}"
        counts.append(T.count(text, java))
        text = F.regexp_replace(text, java, new)
    return text, counts


def image_separators(text: Column) -> Column:
    """Backslashes in the addresses of image references become slashes."""
    hits = F.regexp_extract_all(text, F.lit(T.IMAGE), F.lit(0))
    alt, src = F.regexp_extract_all(text, F.lit(T.IMAGE), F.lit(1)), F.regexp_extract_all(text, F.lit(T.IMAGE), F.lit(2))
    fixed = F.zip_with(alt, src, lambda a, s: F.concat(F.lit("!["), a, F.lit("]("), F.translate(s, "\\", "/"), F.lit(")")))
    parts = F.split(text, T.IMAGE, -1)
    whole = F.array_join(F.zip_with(parts, fixed, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")
    return F.when(F.exists(src, lambda s: F.contains(s, F.lit("\\"))) & (F.size(hits) > 0), whole).otherwise(text)
