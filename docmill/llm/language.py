"""Language identification by compression.

For each language a zstandard raw-content dictionary is cut from labelled text.
A text is encoded with every dictionary; the language whose dictionary gives
the smallest encoding wins. The answer is rejected when the runner-up needs less
than ``MIN_BYTES`` more or is within ``min_margin`` of its own size.

Texts are lower-cased, ASCII characters other than letters count as spaces and
spaces as one. They are encoded in pieces of ``PIECE`` bytes whose sizes add up, so
the memory needed does not grow with the text. Every piece is followed by ``PAD``:
without it the encoder stores a piece that gains too little (any short text) as it
is, whatever the dictionary, and all languages tie.

Fitting is bounded: at most about ``rows`` slices of at most ``chars``
characters of labelled documents for each language.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and
rejected; without any labelled text all texts are ``und``; equal rows get equal
answers; a null id is in no held-out fold; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import in_fold, sliced, small_batches, table

PIECE, PAD = 1 << 12, bytes(512)
MIN_BYTES, MIN_MARGIN = 2, 0.01
OUT = "{id} {type}, lang_pred string, score double, margin double, rejected boolean"
#: ASCII characters other than letters become spaces.
_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def fit_dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 400, chars: int = 500, holdout: int = 5) -> dict[str, bytes]:
    """Language → dictionary, from documents outside the held-out fold (crc32(id) mod ``holdout`` = 0)."""
    labelled = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL").where(~in_fold(F.col("id"), holdout))
    counts = labelled.groupBy("lang").count().orderBy("lang").collect()  # one row for each language
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], rows / r["count"])])
    draw = F.pmod(F.xxhash64(F.lit(2), F.col("id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(draw < F.try_element_at(share, "lang"))
    at = F.pmod(F.xxhash64(F.lit(3), F.col("id").cast("string")), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    pieces: dict[str, list[bytes]] = {}
    for r in sample.select("lang", F.substring("text", at, F.lit(chars)).alias("piece"), "id").orderBy("lang", "id").collect():
        pieces.setdefault(r["lang"], []).append(r["piece"].lower().encode().translate(_SPACED))
    return {k: b" ".join(v) for k, v in sorted(pieces.items())}


def spaced(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split()) + b" "


def classifier(dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, min_bytes: int = MIN_BYTES) -> Callable[[str | None], tuple[str, float, float, bool]]:
    """text → (language, score, margin, rejected)."""
    import zstandard

    langs = list(dictionaries)
    how = zstandard.ZstdCompressionParameters(write_checksum=False, write_content_size=False, write_dict_id=False, strategy=4, search_log=5, window_log=18, hash_log=16, chain_log=16, min_match=4)

    def encoder(data: bytes) -> Callable[[bytes], bytes]:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress

    encoders = [encoder(dictionaries[x]) for x in langs]

    def classify(text: str | None) -> tuple[str, float, float, bool]:
        if not text or not langs or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, True
        data = spaced(text)
        sizes = [0] * len(langs)
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE] + PAD
            for i, encode in enumerate(encoders):
                sizes[i] += len(encode(piece))
        best = min(range(len(langs)), key=lambda i: (sizes[i], i))
        others = [s for i, s in enumerate(sizes) if i != best]
        gap = min(others) - sizes[best] if others else sizes[best]
        margin = gap / min(others) if others else 1.0
        score = 1 / sum(2.0 ** max(-60, sizes[best] - s) for s in sizes)
        return langs[best], score, margin, gap < min_bytes or margin < min_margin

    return classify


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """(id, lang_pred, score, margin, rejected) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        classify = classifier(dictionaries, min_margin)
        for whole in batches:
            for b in sliced(whole):
                rows = [classify(t.as_py()) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]], names=[id_col, "lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, OUT.format(id=f"`{id_col}`", type=kind))


def recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose text has a language: rejected ones go. Only texts travel to Python, and flags back."""
    small_batches(docs.sparkSession)
    model = fit_dictionaries(docs, id_col, text_col, lang_col)

    @F.arrow_udf("boolean")
    def kept(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classify = classifier(model, min_margin)
        for some in texts:
            yield pa.array([not classify(t.as_py())[3] for t in some], pa.bool_())

    return docs.where(kept(F.col(f"`{text_col}`")))


def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_dictionaries(docs))
    return found.select("doc_id", in_fold(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score", "margin", "rejected")
