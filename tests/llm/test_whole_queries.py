"""Registered training-data queries as a whole against brute force, on small tables with nulls, ties, repeated and long rows."""

import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docmill.llm import queries, winnowing

RND = random.Random(11)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tre", "vo") for b in ("na", "pu", "sol", "rt", "es")]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


LONG = prose(1500)
TEXTS = [
    (7, "", "a"), (2, None, None), (3, "one two three four five six seven", "a"), (3, "one two three four five six seven", "a"), (4, LONG, "b"), (5, LONG[:4000] + " " + prose(700), "b"), (6, "x", "c"), (9, "-" * 900, "c"),
    (11, "é一\U0001f600 " * 400, "c"), (12, prose(20), None), (13, prose(12) + LONG, "a"), (14, LONG[100:], "a"), (3, "other text of the same id", "a"), (15, "ab" * 40, "b"), (20, prose(300), "b"),
]


def write(path, name, columns):
    pq.write_table(pa.table(columns), f"{path}/{name}.parquet")


def documents(path, rows):
    ids, texts, sources = zip(*rows) if rows else ((), (), ())
    write(path, "documents", {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en" if i % 2 else "fr" for i in range(len(rows))], pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    return str(path)


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    return documents(tmp_path_factory.mktemp("small"), TEXTS)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return documents(tmp_path_factory.mktemp("empty"), [])


def run(spark, name, at):
    return queries.queries()[name](spark, at)


def marks_of(text):
    """Karp-Rabin values by the definition, the rightmost least one of every window."""
    c, k, w = list(map(ord, text)), winnowing.K, winnowing.W
    grams = [c[i : i + k] for i in range(len(c) - k + 1)] or ([c] if c else [])
    h = []
    for g in grams:
        value = 0
        for x in g:
            value = (value * winnowing.BASE + x) % winnowing.PRIME
        h.append(value)
    out = set()
    for s in range(max(len(h) - w, 0) + 1 if h else 0):
        window = h[s : s + w]
        out.add((s + max(i for i, x in enumerate(window) if x == min(window)), min(window)))
    return sorted(out)


def test_winnowing_query(spark, small, empty):
    rows = sorted((i, t or "") for i, t, _ in TEXTS)
    digest = lambda marks: hashlib.sha256(",".join(f"{p}:{h}" for p, h in marks).encode()).hexdigest()

    def likeness(a, b):
        x, y = {h for _, h in a}, {h for _, h in b}
        return len(x & y) / len(x | y) if x | y else 1.0

    want = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, changed = marks_of(text), marks_of(following), marks_of(edited)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(own), digest(changed), round(likeness(own, changed), 9), round(likeness(own, other), 9)))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in run(spark, "op1_winnowing", small).collect()]
    assert sorted(got) == sorted(want)
    assert run(spark, "op1_winnowing", empty).count() == 0


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_rows_in_order_whatever_the_buckets(spark, buckets):
    ids = [5, 5, 1, 9, 2, None, None, 7, 5, 30]
    rows = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "id long, text string")
    got = {(r["bucket"], r["mirrored"], r["id"], r["text"]) for r in winnowing.in_order(rows, buckets).collect()}
    assert {(i, t) for _, m, i, t in got if not m} == {(i, f"t{k}") for k, i in enumerate(ids)}
    key = lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3])
    order = [(r[2], r[3]) for r in sorted(got, key=key) if not r[1]]
    following = {}
    ranked = sorted(got, key=key)
    for a, b in zip(ranked, ranked[1:]):
        if not a[1] and a[0] == b[0]:
            following[a[3]] = b[3]
    assert following == {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}


def test_ids_of_any_type_and_clashing_columns(spark):
    from docmill.llm import language, minhash, mixing, secrets, toxicity, vectors

    rows = [(f"d{i}", t, "en", s, 1, "x", None) for i, (_, t, s) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "`doc.id` string, text string, lang string, source string, node int, key string, id int")
    same = {r["doc.id"]: r["component_id"] for r in minhash.near_duplicates(df, "doc.id").collect()}
    assert same["d3"] == "d2" and same["d0"] == "d0" and len(same) == len(rows)
    assert {r["doc.id"] for r in minhash.without_copies(df, "doc.id").collect()} >= {"d0", "d1", "d2"}
    assert language.identify(df, {"en": b"one two three four"}, "doc.id").count() == len(rows)
    assert secrets.redact(df.withColumnRenamed("doc.id", "doc_id")).columns[1:] == df.columns[1:]
    clash = df.withColumnRenamed("doc.id", "doc_id").withColumnRenamed("node", "_mix_shard").withColumnRenamed("key", "_mix_key")
    assert mixing.mixed_rows(clash).columns == clash.columns
    named = spark.createDataFrame([("b", [1.0, 0.0], 1), ("a", [2.0, 0.0], 1), ("c", [0.0, 1.0], 1), (None, [1.0, 0.0], 1)], "vec_id string, embedding array<float>, label int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(named).collect()} == {"a": (1, "a", True), "b": (1, "a", False), "c": (0, "c", True), None: (0, None, True)}
    model = {"words": ["grumblefoot"], "stems": [], "weights": [1.0] * 8 + [-2.0], "rate": 0.1}
    assert toxicity.score(df.withColumnRenamed("doc.id", "doc_id"), model).count() == len(rows)


SF = "/root/testdata/sf0.01"


def test_language_query_on_held_out_documents(spark, small, empty):
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    got = run(spark, "op2_language", SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got["held_out"].items())
    test = got[got["held_out"]]
    right = test["lang_pred"] == docs.loc[test.index, "lang"]
    assert len(test) > 150 and right.mean() > 0.97, right.mean()
    assert (~right & ~test["rejected"]).mean() < 0.02 and test["rejected"].mean() < 0.03
    few = {r["lang_pred"] for r in run(spark, "op2_language", small).where("score = 0").collect()}
    assert few == {"und"} and run(spark, "op2_language", empty).count() == 0


def test_language_rejects_what_two_languages_share(spark):
    from docmill.llm import language

    rnd = random.Random(5)
    words = {"aa": ["kento", "baruv", "mille", "sotra"], "bb": ["druzi", "pelon", "wexta", "gomri"]}
    model = {k: " ".join(rnd.choice(v) for _ in range(900)).encode() for k, v in words.items()}
    classify = language.classifier(model)
    assert classify("kento mille sotra")[0] == "aa" and not classify("kento mille sotra")[3]
    assert classify("zzqq")[3] and classify("kento druzi")[3]  # nothing known, and one word of each
    assert language.classifier({k: b"" for k in "ab"})("any text at all")[3]


def spans_of(text):
    import re

    pattern = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def random_spans(text, base):
    """The battery and the e-BH rule by their definitions."""
    import math
    import re

    from docmill.llm import secrets as S

    tested = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
        t = m[0]
        mixed = (re.search("[0-9]", t) and re.search("[A-Za-z]", t)) or re.search("[a-z].*[A-Z].*[a-z]", t)
        if not mixed or any(b[0] < m.end() and m.start() < b[2] for b in base):
            continue
        k = 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", t) else 32 if re.fullmatch("[A-Z2-7]+", t) else 64
        abc = {16: S.HEX_ABC, 32: S.B32_ABC, 64: S.B64_ABC}[k]
        x = [abc.index(c.lower() if k == 16 else {"-": "+", "_": "/"}.get(c, c)) for c in t]
        n, tail = len(x), lambda z: math.exp(-0.717 * z - 0.416 * z * z)
        chi = max((sum(x.count(v) ** 2 for v in set(x)) * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n), 0)
        turns = sum((a >= k / 2) != (b >= k / 2) for a, b in zip(x, x[1:]))
        runs = abs(1 + turns - (1 + (n - 1) / 2)) / math.sqrt((n - 1) / 4)
        serial = abs(sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in zip(x, x[1:])) / ((k * k - 1) / 12) / math.sqrt(n - 1))
        p = min(1, 3 * min(map(tail, (chi, runs, serial))))
        kinds = [sum(map(str.islower, t)), sum(map(str.isupper, t)), sum(map(str.isdigit, t))]
        kinds.append(n - sum(kinds))
        ln_e = -n * math.log(k) - max(sum(c * math.log(q / size) for c, q, size in zip(kinds, mode, (26, 26, 10, 4))) for mode in S.MODES)
        if p >= S.ALPHA:
            tested.append((ln_e + math.log(min(1, p / S.FULL)), m.start(), m.end()))
    tested.sort(reverse=True)
    most = max((i + 1 for i, (e, *_) in enumerate(tested) if e >= math.log(len(tested) / (S.FDR * (i + 1)))), default=0)
    return [(s, 3, e) for _, s, e in tested[:most]]


def test_secrets_query(spark, empty, tmp_path):
    from docmill.llm import secrets as S

    rnd = random.Random(21)
    abc = S.B64_ABC
    key = lambda n, chars=abc: "".join(rnd.choice(chars) for _ in range(n))
    texts = [t for _, t, _ in TEXTS] + [f"{prose(6, rnd)} {key(rnd.randint(20, 60))} {prose(4, rnd)} {key(40, S.B32_ABC)} x {key(32, '0123456789ABCDEF')}" for _ in range(30)]
    texts += [" ".join(f"Word{i}InCamelCaseAndMore{i}" for i in range(40)), "AAAAAAAAAA1111111111aaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz0123456789", "token=abcdef0123456789 " * 3000, "Secret: 'x' api_key=abc.def-123"]
    at = documents(tmp_path, [(i, t, "a") for i, t in enumerate(texts)])
    docs = {i: t or "" for i, t in enumerate(texts)}
    for r in run(spark, "op3_secrets", at).collect():
        text = docs[r["doc_id"]]
        base = spans_of(text)
        shown = lambda spans: ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r["base_sha256"] == hashlib.sha256(shown(base).encode()).hexdigest()
        assert r["spans"] == shown(base + random_spans(text, base)), text[:80]
    assert run(spark, "op3_secrets", empty).count() == 0


def test_bpe_query(spark, small, empty):
    import public_tokenizers
    import tiktoken

    from docmill.llm import bpe

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})
    want = sorted((i, len(ids := library.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in TEXTS)
    assert sorted(tuple(r) for r in run(spark, "op4_bpe", small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want
    assert run(spark, "op4_bpe", empty).count() == 0
    rnd = random.Random(3)
    for size in (127, 128, 129, 400):  # on either side of the plain and the heaped merge
        piece = "".join(rnd.choice("abe -=的") for _ in range(size)).encode()
        whole = tiktoken.Encoding("slices", pat_str=r"(?s:.+)", mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})
        assert bpe.merged(piece, bpe.read_ranks(bpe.default_path())) == whole.encode_ordinary(piece.decode())


def test_splitting_tree(spark):
    from docmill.llm import mixing

    quotas = {0: 5, 1: 0, 2: 64, 3: 1000, 4: 100_000}
    urn = spark.createDataFrame([(i, f"s{i}", q) for i, q in quotas.items()], "idx int, skey string, blocks long")
    for seed in (1, 2, 3):
        starts = {int(r["skey"][1:]): r["offsets"] for r in mixing.shard_offsets(urn, 8, seed).collect()}
        runs = {i: [b - a for a, b in zip(o, [*o[1:], quotas[i]])] for i, o in starts.items()}
        assert all(len(r) == 8 and min(r) >= 0 and sum(r) == quotas[i] for i, r in runs.items())  # disjoint runs that make up the quota
        shards = [sum(r[k] for r in runs.values()) for k in range(8)]
        assert max(shards) - min(shards) <= 3  # every node halves its urn
        # shares follow the hypergeometric law: within six deviations of an even split
        assert all(abs(x - 125) < 6 * (1000 / 8 * 7 / 8) ** 0.5 for x in runs[3]) and all(abs(x - 12_500) < 6 * (12_500 * 7 / 8 * 1069 / 101_069) ** 0.5 for x in runs[4])
    assert len({tuple(mixing.shard_offsets(urn, 8, s).where("skey = 's3'").first()["offsets"]) for s in range(4)}) > 1


def test_mixed_rows_keep_their_shards(spark):
    from collections import Counter

    from docmill.llm import mixing

    rnd = random.Random(9)
    df = spark.createDataFrame([(i, prose(rnd.randint(1, 40), rnd), f"s{i % 5}") for i in range(3000)], "doc_id long, text string, source string")
    plan = mixing.mix(df, docs_per_block=8).toPandas()
    rows = mixing.mixed_rows(df, docs_per_block=8, shard_col="shard")
    parts = rows.rdd.glom().collect()
    assert len(parts) == 64
    assert all(len({r["shard"] for r in p}) <= 1 for p in parts) and len({r["shard"] for p in parts for r in p}) > 50
    assert Counter((r["doc_id"], r["shard"]) for p in parts for r in p) == Counter((i, s) for i, shards in zip(plan["doc_id"], plan["shards"]) for s in shards)
    assert any([r["doc_id"] for r in p] != sorted(r["doc_id"] for r in p) for p in parts)


def test_toxicity_query_on_held_out_documents(spark):
    import zlib

    at = "/root/testdata/sf0.1"  # sf0.01 holds 70 labelled documents of the fold and six toxic ones: too few for rates
    labels = spark.read.parquet(f"{at}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    got = run(spark, "op7_toxicity", at).toPandas().set_index("doc_id")
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got["held_out"].items())
    test = got[got["held_out"] & got.index.isin(labels.index)]
    truth = labels.loc[test.index]
    assert len(test) > 800 and test["predicted"][truth == 1].mean() > 0.9 and test["predicted"][truth == 0].mean() < 0.005


def test_pipeline(spark, tmp_path):
    from collections import Counter

    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from docmill.llm import bpe, mixing

    rnd = random.Random(17)
    words = {"en": ["the", "and", "river", "stone", "walking", "under", "light", "morning"], "de": ["der", "und", "nicht", "strasse", "gehen", "unter", "licht", "morgen"]}
    rows = []
    for i in range(80):
        lang = "de" if i % 4 == 0 else "en"
        rows.append([i, " ".join(rnd.choice(words[lang]) for _ in range(60)) + f" {lang}{i}x", lang, f"s{i % 3}"])
    rows.append([100, rows[5][1], "en", "s1"])  # an exact copy
    rows.append([101, rows[6][1] + " again", "en", "s0"])  # a near copy
    rows.append([102, "12 34 !!", "en", "s0"])  # no language
    rows.append([103, None, "en", "s0"])
    rows[9][1] += " password=hunter2hunter2 end"
    table = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows]), "lang": pa.array([r[2] for r in rows]), "source": pa.array([r[3] for r in rows]), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}
    write(tmp_path, "documents", table)
    kept = [r for r in rows if r[0] < 100]
    clean = [(i, t.replace("password=hunter2hunter2", "[SECRET]"), lang, s) for i, t, lang, s in kept]
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(clean, "doc_id long, text string, lang string, source string")).collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})
    want = Counter()
    for i, t, *_ in clean:
        want[i, len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()] += taken[i]
    got = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want and sum(got.values()) > 60


def test_pipeline_of_an_empty_table(spark, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, empty)
        assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


def test_scoring_and_url_queries_run_whole(spark, empty):
    got = run(spark, "op6_scoring", SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(got) == docs == got["doc_id"].nunique() and (got["score"] < 0).all()
    test = got[got["held_out"]]
    assert test["score"].sum() > test["base_score"].sum()  # contexts tell more than counts, on texts that were not learned
    assert run(spark, "op6_scoring", empty).count() == 0


def test_components_of_nothing_and_of_a_hot_node(spark):
    from docmill.llm import components

    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    star = spark.range(1, 3000).selectExpr("0L AS u", "id AS v")
    assert {r["component"] for r in components.connected_components(star).collect()} == {0}


def test_long_texts(spark):
    from docmill.llm import language, minhash, toxicity

    rnd = random.Random(4)
    words = [rnd.choice(WORDS) + str(rnd.randrange(300)) for _ in range(30_000)]
    words[500] = "w" * 5000  # longer than a word is kept as it is
    text = " ".join(words)
    want = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    assert len(minhash.shingles(text.encode())) == len(want)
    assert (minhash.shingles(text.encode()) == minhash.shingles(("  " + text.upper().replace(" ", "\n") + "\n").encode())).all()
    model = {"aa": " ".join(words[:300]).encode(), "bb": b"quite other words here"}
    classify = language.classifier(model)
    assert classify(text)[0] == "aa" == classify(text * 3)[0]
    assert toxicity.Scorer(["grumblefoot"], []).features(text + " grumblefoot")[0] > 0
    rows = spark.createDataFrame([(1, text), (1, text), (2, text + " end"), (3, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(rows).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_equal_rows_get_equal_answers(spark):
    from docmill.llm import secrets, toxicity

    rows = spark.createDataFrame([(1, "see token=abcdef12 now", "x"), (1, "see token=abcdef12 now", "x"), (None, None, "y")], "doc_id long, text string, spans string")
    assert len({tuple(r) for r in secrets.redact(rows).collect()}) == 2 and secrets.redact(rows).columns == rows.columns
    model = {"words": ["grumblefoot"], "stems": [], "weights": [1.0] * 8 + [-2.0], "rate": 0.1}
    assert len({tuple(r) for r in toxicity.score(rows, model).collect()}) == 2
