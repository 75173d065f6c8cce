"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and context windows.

Lexicon. From labelled documents outside the held-out fold come words, and word
beginnings of 4 to 8 letters, that stand in toxic documents far more often than in
clean ones. Words covered by a kept beginning stay, for their misspellings.

Matching. The Levenshtein automata of all entries are intersected with their trie
and determinised as words come (see ``Automaton``). One edit is allowed for entries of
5 letters on, two from 9. Digits and signs that
stand for letters are read as letters, and drawn-out letters are shortened first.

Misspellings are rare among labelled texts, so each toxic one is read a second time with its exact hits
misspelled, at a weight of ``RARE`` (the share of toxic texts taken to be written so): how much such a hit
tells follows from these and from chance hits in clean texts.

Context. Every hit looks at ``SPAN`` words to either side: between quotation marks
or beside a word of reporting it counts as quoted, else as abuse. A logistic model
on counts and densities of exact and misspelled hits, quoted or not, gives the score.

Fitting is bounded by ``sample`` labelled documents of each class, drawn by a hash of
the id; class weights undo the drawing.

Edge cases: null and empty texts have no hits and get the score of clean text;
without labels every score is 0; of several labels of one id the highest
counts; equal rows get equal answers; other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import discard, in_fold, materialize, small_batches, table, worker_store

SPAN = 6
STEMS = range(4, 9)
WORDS_HELD = 500_000
RARE = 0.03
#: fixed values: characters written for letters, marks of quotation, words of reporting
LEET = str.maketrans("013457@$", "oieastas")
QUOTES = "\"“”„«»‘‚"
REPORTING = {"said", "says", "wrote", "called", "quote", "quoted", "quotes", "term", "word", "words", "phrase", "sagte", "schrieb", "zitat", "wort", "dit", "écrit", "mot", "terme", "dijo", "escribió", "cita", "palabra", "término"}
_EDGE = re.compile(r"^\W+|\W+$")
_DRAWN = re.compile(r"(.)\1\1+")
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return text.lower().split()


def core(word: str) -> str:
    """A word without signs around it, with digits and signs inside read as letters."""
    if word.isalpha():
        return word
    word = _EDGE.sub("", word)
    if not word.isalpha() and any(map(str.isalpha, word)):
        word = "".join(_LETTERS.findall(word.translate(LEET)))
    return word


class Automaton:
    """Levenshtein automata of all entries, intersected with their trie and made deterministic as words come.

    A state is a set of (trie node, edits so far); reading a letter follows the trie, or spends an edit on a letter
    too many, another letter, or letters left out. Sets met before are numbered, so a word costs one look-up a
    letter until its state is empty. Entries shorter than 5 letters allow no edit, shorter than 9 one, others two.
    """

    HELD = 2_000_000

    def __init__(self, words: list[str], stems: list[str]):
        self.nodes: list[dict] = [{} for _ in range(3)]  # one root for each number of edits
        self.ends: dict[int, bool] = {}  # node → whether it ends a stem
        self.limit = [0, 1, 2]
        for entry, begins in [*((w, False) for w in words), *((s, True) for s in stems)]:
            at = limit = 0 if len(entry) < 5 else 1 if len(entry) < 9 else 2
            for c in entry:
                if c not in self.nodes[at]:
                    self.nodes[at][c] = len(self.nodes)
                    self.nodes.append({})
                    self.limit.append(limit)
                at = self.nodes[at][c]
            self.ends[at] = self.ends.get(at, False) or begins
        self.start()

    def start(self) -> None:
        self.sets: list[frozenset] = [frozenset()]
        self.numbers: dict[frozenset, int] = {self.sets[0]: 0}
        self.moves: dict[tuple[int, str], int] = {}
        self.at_end: list[int] = [9]  # fewest edits if the word ends here
        self.so_far: list[int] = [9]  # fewest edits to a stem that ends here
        self.first = self.number({(0, 0), (1, 0), (2, 0)})

    def number(self, states: set) -> int:
        todo = list(states)
        while todo:  # letters of the entry left out
            at, e = todo.pop()
            if e < self.limit[at]:
                for below in self.nodes[at].values():
                    if (below, e + 1) not in states:
                        states.add((below, e + 1))
                        todo.append((below, e + 1))
        key = frozenset(states)
        if (n := self.numbers.get(key)) is None:
            n = self.numbers[key] = len(self.sets)
            self.sets.append(key)
            ended = [(e, self.ends[at]) for at, e in key if at in self.ends]
            self.at_end.append(min((e for e, _ in ended), default=9))
            self.so_far.append(min((e for e, stem in ended if stem), default=9))
        return n

    def move(self, state: int, c: str) -> int:
        out = set()
        for at, e in self.sets[state]:
            if (below := self.nodes[at].get(c)) is not None:
                out.add((below, e))
            if e < self.limit[at]:
                out.add((at, e + 1))
                out.update((below, e + 1) for below in self.nodes[at].values())
        n = self.moves[state, c] = self.number(out) if out else 0
        return n

    def within(self, word: str) -> int | None:
        """The fewest edits between ``word`` and an entry, or a beginning of ``word`` and a stem, as far as allowed."""
        if len(self.moves) > self.HELD:
            self.start()
        state, best, get = self.first, 9, self.moves.get
        for c in word:
            if (nxt := get((state, c))) is None:
                nxt = self.move(state, c)
            if not (state := nxt):
                break
            if self.so_far[state] < best:
                best = self.so_far[state]
        best = min(best, self.at_end[state])
        return best if best < 9 else None


class Scorer:
    """Hits and features of texts under one lexicon."""

    def __init__(self, words: list[str], stems: list[str]):
        self.automaton = Automaton(words, stems)
        self.known: dict[str, int] = {}

    def hit(self, raw: str) -> int:
        """0: none, 1: exact, 2: misspelled."""
        if (found := self.known.get(raw)) is None:
            w = core(raw)
            least = self.automaton.within(w)
            if least is None and (short := _DRAWN.sub(r"\1", w)) != w:
                least = self.automaton.within(short)
                least = None if least is None else max(1, least)
            found = 0 if least is None else 1 if least == 0 else 2
            if len(self.known) >= WORDS_HELD:
                self.known.clear()
            self.known[raw] = found
        return found

    def features(self, text: str | None) -> list[float]:
        words = words_of(text or "")
        known, hit = self.known, self.hit
        hits = {w: k for w in set(words) if (k := known.get(w) if w in known else hit(w))}
        tally = [0, 0, 0, 0]
        if hits:
            open_ = 0
            for i, w in enumerate(words):
                before = open_
                open_ += sum(w.count(q) for q in QUOTES)
                if (k := hits.get(w)) is not None:
                    near = words[max(0, i - SPAN) : i + SPAN + 1]
                    closing = open_ > before or before % 2 == 1 and any(q in x for x in words[i : i + SPAN + 1] for q in QUOTES)
                    quoted = closing or any(_EDGE.sub("", x) in REPORTING for x in near)
                    tally[2 * (k - 1) + quoted] += 1
        n = max(len(words), 1)
        return [*map(math.log1p, tally), *(math.log1p(100 * x / n) for x in tally)]


def misspelled(text: str, hit: Callable[[str], int]) -> str | None:
    """The text with the exact hits that allow an edit misspelled (two letters near the middle change places); null if there are none."""
    out, changed = [], False
    for w in words_of(text):
        c = core(w)
        if len(c) >= 6 and hit(w) == 1:
            k = len(c) // 2
            new = c[: k - 1] + c[k] + c[k - 1] + c[k + 1 :] if c[k] != c[k - 1] else c[:k] + c[k + 1 :]
            if hit(new) == 2 or hit(new := c[:k] + c[k + 1 :]) == 2:
                w, changed = new, True
        out.append(w)
    return " ".join(out) if changed else None


def scorer(words: list[str], stems: list[str]) -> Scorer:
    """The scorer of a lexicon, kept with its automaton while the Python process lives."""
    store, key = worker_store("toxicity"), ("toxicity", *words, 0, *stems)
    if store.get("toxicity", (None,))[0] != key:
        store["toxicity"] = (key, Scorer(words, stems))
    return store["toxicity"][1]


def terms_of(text: str) -> set[str]:
    """What the lexicon is chosen from: words as they are, beginnings with a hyphen."""
    out = set()
    for raw in set(words_of(text)):
        w = core(raw)
        if len(w) > 2:
            out.add(w)
            out.update(w[:n] + "-" for n in STEMS if n < len(w))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 10_000, holdout: int = 5) -> dict:
    """The lexicon and the weights."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("y IS NOT NULL AND id IS NOT NULL").where(~in_fold(F.col("id"), holdout)).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return {"words": [], "stems": [], "weights": None, "rate": 1.0 if counts.get(1) else 0.0}
    share = F.when(F.col("y") == 1, F.lit(sample / counts[1])).otherwise(F.lit(sample / counts[0]))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(7), F.col("id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    # at most about 2 * sample ids: bounded
    texts = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL").join(F.broadcast(drawn), "id").select("text", "y"), "toxic-sample")
    n = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    n1, n0 = max(n.get(1, 0), 1), max(n.get(0, 0), 1)

    def count(batches):
        import pyarrow as pa

        seen = ({}, {})
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tally = seen[int(y == 1)]
                for w in terms_of(t):
                    tally[w] = tally.get(w, 0) + 1
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield from flush(pa, seen)
                seen = ({}, {})
        yield from flush(pa, seen)

    def flush(pa, seen):
        for y, tally in enumerate(seen):
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array([y] * len(tally), pa.int32()), pa.array(list(tally.values()), pa.int64())], names=["term", "y", "n"])

    tallied = texts.mapInArrow(count, "term string, y int, n bigint").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"))
    telling = tallied.where((F.col("bad") >= max(3, 0.004 * n1)) & (F.col("bad") / n1 > 25 * (F.col("good") + 0.5) / n0))
    top = telling.orderBy(F.desc("bad"), "term").collect()  # bounded by the label sample and the least share of documents
    stems: dict[str, None] = {}
    for s in sorted((r["term"][:-1] for r in top if r["term"].endswith("-")), key=lambda s: (len(s), s)):
        if not any(s[:n] in stems for n in STEMS):
            stems[s] = None
    stems = list(stems)
    # words that a stem covers matter for misspellings
    words = sorted({r["term"] for r in top if not r["term"].endswith("-")})

    def featured(batches):
        import pyarrow as pa

        s = scorer(words, stems)
        for b in batches:
            rows = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.append((s.features(t), y, 1.0))
                if y == 1 and (changed := misspelled(t, s.hit)) is not None:
                    rows.append((s.features(changed), y, RARE))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, *_ in rows], pa.list_(pa.float64())), pa.array([y for _, y, _ in rows], pa.int32()), pa.array([w for *_, w in rows], pa.float64())], names=["x", "y", "w"])

    rows = texts.mapInArrow(featured, "x array<double>, y int, w double").collect()
    discard(texts)
    x = np.array([r["x"] for r in rows])
    y = np.array([float(r["y"] == 1) for r in rows])
    weight = np.where(y == 1, counts[1] / n1, counts[0] / n0) * np.array([r["w"] for r in rows])
    return {"words": words, "stems": stems, "weights": _logistic(x, y, weight / weight.mean()).tolist(), "rate": counts[1] / (counts[0] + counts[1])}


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic model, the intercept last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        s, w = scorer(model["words"], model["stems"]), model["weights"]
        for b in batches:
            out = []
            for t in b.column(1):
                z = None if w is None else w[-1] + sum(a * c for a, c in zip(w, s.features(t.as_py())))
                out.append(model["rate"] if z is None else 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
