"""Secret scans: fixed patterns and a randomness test battery, in DataFrame functions only.

Base kinds (leftmost non-overlapping matches, failing ones dropped): ``assign``,
``access`` and ``hex``. The battery adds ``random`` spans that touch no base span.

Battery. Runs of 20 or more base64 characters that mix letters with digits or
cases are candidates. Their encoding is inferred (hex, base32 or base64) and
three tests ask whether they look uniform in it: chi-squared of the alphabet's
counts (standardised with its exact mean and variance, so short runs are not
judged by an asymptotic law), runs above and below the middle of the alphabet,
and lag-1 serial correlation. p is the smallest of their p-values, times three.

False discoveries. A candidate's likelihood ratio of "uniform in its
encoding" against "written text" grows with the length, so short runs need to be unlikelier
text than long ones. It counts in the measure in which the battery finds the candidate uniform: in full from a p of
``FULL`` on, in proportion below, not at all under ``ALPHA``. A ratio times at most 1 is still an e-value. "Text" is the likeliest of
lower case, upper case, capitalised and digits-only writing. Among a document's m candidates
the e-BH rule keeps the largest k with e(k) >= m / (FDR * k), which bounds the
rate of false discoveries for any dependence.

Edge cases: a null text counts as empty; texts without a match have counts 0, the
digest of the empty string and empty spans; equal rows get equal answers; very
long texts are scanned whole; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import table

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHA, FULL, FDR = 0.001, 0.05, 0.001
HEX_ABC, B32_ABC = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
B64_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
FOUND = "array<struct<s:int,e:int,hit:string>>"
#: Chances of a character of written text by mode (lower case, upper case, capitalised, digits): lower, upper, digit, sign.
MODES = ((0.90, 0.04, 0.04, 0.02), (0.04, 0.90, 0.04, 0.02), (0.78, 0.18, 0.02, 0.02), (0.04, 0.04, 0.90, 0.02))


def running(values: str, kind: str, how: Callable[[str, str], str]) -> str:
    """SQL of the running results of ``how`` (of what is so far and a value) over an array expression of ``kind``, in blocks of 256 so that long arrays cost little more a value."""
    block = "transform(sequence(0, greatest(size(v) - 1, 0) div 256), b -> slice(v, b * 256 + 1, 256))"
    fold = lambda array, start: f"aggregate({array}, struct({start} AS a, cast(array() AS array<{kind}>) AS seen), (s, x) -> transform(array({how('s.a', 'x')}), y -> struct(y AS a, array_append(s.seen, y) AS seen))[0])"
    ends = fold(f"transform(bs, c -> aggregate(c, cast(0 AS {kind}), (a, x) -> {how('a', 'x')}))", f"cast(0 AS {kind})")
    return f"transform(array({values}), v -> transform(array({block}), bs -> transform(array({ends}.seen), es -> flatten(transform(bs, (c, i) -> {fold('c', f'if(i = 0, cast(0 AS {kind}), get(es, i - 1))')}.seen)))[0])[0])[0]"


def located(text: Column, pattern: str) -> Column:
    """All matches with their code point spans: array of (s, e, hit)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda a, b: F.struct(F.length(a).alias("skip"), F.length(b).alias("n"), b.alias("hit")))
    return F.when(F.rlike(text, F.lit(pattern)), steps).otherwise(F.array().cast("array<struct<skip:int,n:int,hit:string>>"))


def placed(steps: str) -> Column:
    """The spans of ``located`` steps: where each begins is a running sum of what was skipped and matched."""
    ends = running(f"transform({steps}, t -> t.skip + t.n)", "int", "{} + {}".format)
    return F.expr(f"if(size({steps}) = 0, cast(array() AS {FOUND}), zip_with({steps}, {ends}, (t, e) -> struct(e - t.n AS s, e AS e, t.hit AS hit)))")


#: Two-sided normal tail P(|Z| > z), by a known approximation with an error under 0.01.
_TAIL = "exp(-0.717 * z - 0.416 * z * z)"


def battery(token: str) -> str:
    """SQL of struct(p, ln_e) for the string variable ``token``."""
    kind = f"CASE WHEN {token} RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 16 WHEN {token} RLIKE '^[A-Z2-7]+$' THEN 32 ELSE 64 END"
    places = f"""transform(split({token}, ''), c -> instr(CASE k WHEN 16 THEN '{HEX_ABC}' WHEN 32 THEN '{B32_ABC}' ELSE '{B64_ABC}' END,
        CASE WHEN k = 16 THEN lower(c) WHEN c = '-' THEN '+' WHEN c = '_' THEN '/' ELSE c END) - 1)"""
    counted = ", ".join(f"length(regexp_replace({token}, '[^{chars}]', '')) AS {name}" for name, chars in (("lo", "a-z"), ("up", "A-Z"), ("di", "0-9")))
    squares = "aggregate(transform(array_distinct(r.x), v -> size(filter(r.x, y -> y = v))), 0D, (a, c) -> a + c * c)"
    chi = f"greatest(({squares} * r.k / r.n - r.n - (r.k - 1)) / sqrt(2D * (r.k - 1) * (r.n - 1) / r.n), 0D)"
    runs = "abs(1 + size(filter(sequence(1, r.n - 1), i -> (r.x[i] >= r.k / 2) <> (r.x[i - 1] >= r.k / 2))) - (1 + (r.n - 1) / 2D)) / sqrt((r.n - 1) / 4D)"
    serial = "abs(aggregate(sequence(1, r.n - 1), 0D, (a, i) -> a + (r.x[i] - (r.k - 1) / 2D) * (r.x[i - 1] - (r.k - 1) / 2D)) / ((r.k * r.k - 1) / 12D) / sqrt(r.n - 1))"
    ln_text = ", ".join(f"r.lo * ln({a} / 26) + r.up * ln({b} / 26) + r.di * ln({c} / 10) + (r.n - r.lo - r.up - r.di) * ln({d} / 4)" for a, b, c, d in MODES)
    tail = lambda z: f"transform(array({z}), z -> {_TAIL})[0]"
    return f"""transform(transform(transform(array({kind}), k -> struct(k AS k, {places} AS x, {counted})), t -> struct(t.k AS k, t.x AS x, size(t.x) AS n, t.lo AS lo, t.up AS up, t.di AS di)),
        r -> struct(least(1D, 3 * least({tail(chi)}, {tail(runs)}, {tail(serial)})) AS p, -r.n * ln(r.k) - greatest({ln_text}) AS ln_e))[0]"""


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base, spans): ``base`` and ``spans`` are arrays of (s, kind, e), sorted; kind is a place in ``KINDS``."""
    text = F.col("text")
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).select(
        "id", "text", located(text, ASSIGN).alias("assign"), located(text, ACCESS).alias("access"), located(text, HEX).alias("hex"), located(text, CANDIDATE).alias("runs")).select("id", "text", *[placed(c).alias(c) for c in ("assign", "access", "hex", "runs")])
    spanned = lambda name, k: F.transform(name, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("kind"), x["e"].alias("e")))
    long = F.filter("assign", lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6)
    base = found.select("id", "text", "runs", F.array_sort(F.concat(spanned(long, 0), spanned("access", 1), spanned("hex", 2))).alias("base"))
    free = """filter(runs, r -> (r.hit RLIKE '[0-9]' AND r.hit RLIKE '[A-Za-z]' OR r.hit RLIKE '[a-z].*[A-Z].*[a-z]')
        AND NOT exists(base, b -> b.s < r.e AND r.s < b.e))"""
    tested = base.select("id", "text", "base", F.expr(free).alias("runs")).select("id", "text", "base", F.expr(f"transform(runs, u -> struct(u.s AS s, u.e AS e, {battery('u.hit')} AS test))").alias("runs"))
    # e-BH: candidates by falling e-value, the last place k (from 1) that still has e >= m / (FDR k)
    weighed = f"transform(filter(runs, r -> r.test.p >= {ALPHA}), r -> struct(r.s AS s, r.e AS e, struct(r.test.ln_e + ln(least(1D, r.test.p / {FULL})) AS ln_e) AS test))"
    ranked = F.expr(f"array_sort({weighed}, (a, b) -> CASE WHEN a.test.ln_e > b.test.ln_e THEN -1 WHEN a.test.ln_e < b.test.ln_e THEN 1 ELSE 0 END)")
    kept = F.expr(f"slice(ranked, 1, greatest(0, coalesce(array_max(filter(transform(ranked, (r, i) -> if(r.test.ln_e >= ln(size(runs) / ({FDR} * (i + 1))), i + 1, 0)), k -> k > 0)), 0)))")
    return tested.select("id", "text", "base", "runs", ranked.alias("ranked")).select("id", "text", "base", F.array_sort(F.concat("base", F.transform(kept, lambda r: F.struct(r["s"].alias("s"), F.lit(3).alias("kind"), r["e"].alias("e"))))).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["s"], x["e"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark`` (overlapping spans by one)."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("body"))
    found = find_secrets(kept, "row", "body")
    # spans that overlap have one mark: a stretch begins where a span starts at or after all ends before it
    begins = "filter(spans, (x, i) -> i = 0 OR x.s >= get(reach, i - 1))"
    ends = "filter(reach, (m, i) -> i = size(reach) - 1 OR get(spans, i + 1).s >= m)"
    stretches = f"zip_with({begins}, {ends}, (b, m) -> struct(b.s AS s, m AS e))"
    pieces = f"concat(transform(st, (x, i) -> concat(substring(text, if(i = 0, 0, get(st, i - 1).e) + 1, x.s - if(i = 0, 0, get(st, i - 1).e)), '{mark}')), array(substring(text, try_element_at(st, -1).e + 1)))"
    reach = running("transform(spans, x -> x.e)", "int", "greatest({}, {})".format)
    clean = f"transform(array({reach}), reach -> transform(array({stretches}), st -> array_join({pieces}, ''))[0])[0]"
    text = F.when(F.size("spans") == 0, F.col(f"id.`{text_col}`")).otherwise(F.expr(clean))
    return found.select(*[(text if c == text_col else F.col(f"id.`{c}`")).alias(c) for c in docs.columns])


def op3_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
