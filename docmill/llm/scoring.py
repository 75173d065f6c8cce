"""Language-model scoring by logistic context mixing, bit by bit, with the model dealt to shards by context.

Bits. Tokens are lower-cased words and one end for each text. The ``HEAD`` commonest have
Huffman codes; any other word, and one met only once, is an escape and then spelled byte by byte. Every
bit of a code is predicted, so a text's score is the log10 of its whole chance.

Predictors. A bit of a word is predicted by its place in the code alone, after the
word before, and after the two words before; a bit of a spelled byte after the last one, two and three bytes
and after all of the word so far. Each context and place in the code has its own counts: sorted by context and
code, the bits that share them are neighbours. The predictors' stretched
chances are added with weights that a gate selects: how often the two longest
contexts have been seen. An adaptive probability map refines the sum for each gate.

Shards. The long contexts of a token include the word before it, so tokens are dealt by
that word (common ones are shared out by the word before that): a shard holds all that is
known about its contexts and counts, learns weights and maps, and prices its
tokens on its own. What comes again after the same two words is priced once and learned as often as
it is met. Spelled words are dealt by their beginning, each distinct word once, and so is each beginning. Shards are as many as
the corpus asks for (about ``SHARD`` tokens), so the model grows with it; no table of it
is collected or broadcast but codes and counts of the ``HEAD`` words.

Weights are Newton steps over all of a shard's training bits, each seen as if it had not
been counted. Everything is frozen before scoring: equal texts get equal scores.

The base score adds up the logs of word counts; words beyond the head meet their
counts by a join, so the vocabulary may grow without bound (a partition holds its share of the distinct words in memory).

Edge cases: a null text counts as empty: one token, the end; a null id is in no held-out
fold; without training documents nothing is known and every bit is a half; rows that
repeat stay rows of their own; texts of any length are tokenised whole; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import math
import uuid
import zlib
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import discard, in_fold, materialize, shuffle_parts, small_batches, table, worker_store

HEAD = 1 << 17
SHARD, CHUNK = 300_000, 1 << 20  # tokens of a shard, and of a stretch of documents that is dealt at once
SPELLED = 5_000  # spelled words of a shard
START = 0xFFFFFFFF  # stands for the word before the first
GATES, BUCKETS, LIMIT, STEPS, RIDGE = 16, 33, 8.0, 2, 4.0
FLUSH = 1 << 22  # words counted at once
BLOCK, PART = 1 << 15, 15_000  # bits priced at once; tokens of a part of a shard, whose bits fit a core's cache


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, then the end as an empty word."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), b""]


# --- codes


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, nodes, bits): for each symbol the inner nodes of its code and the side taken at each."""
    n = len(weights)
    parent, side = np.zeros(max(2 * n - 1, 1), np.int64), np.zeros(max(2 * n - 1, 1), np.uint8)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    for new in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = new
        side[j] = 1
        heapq.heappush(heap, (a + b, new))
    at, symbol, found = np.arange(n), np.arange(n), []
    while True:
        inner = at < 2 * n - 2
        at, symbol = at[inner], symbol[inner]
        if not len(at):
            break
        found.append((symbol, parent[at] - n, side[at]))
        at = parent[at]
    if not found:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8)
    symbol, node, bit = map(np.concatenate, zip(*found))
    order = np.argsort(symbol, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(symbol, minlength=n))]), node[order].astype(np.int32), bit[order]


def alone_by_node(code: tuple, counts: np.ndarray) -> np.ndarray:
    """Stretched chance of a one at each place of the code, from the symbols' counts."""
    offsets, nodes, bits = code
    each, size = np.repeat(counts, np.diff(offsets)), max(len(counts) - 1, 1)
    return stretch(np.bincount(nodes, each * (1 - bits.astype(np.int64)), size), np.bincount(nodes, each * bits, size)).astype(np.float32)


def stretch(n0, n1):
    return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))


def clipped(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(x, np.float32(-LIMIT)), np.float32(LIMIT))


def hashed(*parts: np.ndarray) -> np.ndarray:
    """32-bit hash of several 32-bit numbers."""
    h = np.full(len(parts[0]), 0x2F0B4C47, np.uint32)
    for p in parts:
        h ^= p.astype(np.uint32, copy=False)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(13)
    return h


# --- one shard


def counted(context: np.ndarray, path: np.ndarray, rank: np.ndarray, learn: np.ndarray, one: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each bit's place in the code was met with a zero and with a one in its context, exactly.

    Rows stand by falling length of their codes, bits by depth: those of depth d are ``one[ends[d] : ends[d + 1]]``, one for
    each of the first rows. Sorted by context and path, the rows that share a context and a beginning are neighbours.
    """
    pair = np.empty(len(one), np.complex64)  # zeros and ones, right for rows that stand alone
    pair.imag = learn * one
    pair.real = learn - pair.imag
    row = np.argsort(context.astype(np.uint64) << np.uint64(32) | rank)
    apart = np.full(len(row), ~np.uint64(0))
    here, word = context[row], path[row]
    new = np.append(True, here[1:] != here[:-1])
    apart[1:] = np.where(new[1:], apart[1:], word[1:] ^ word[:-1])
    for d, (a, b) in enumerate(zip(ends, ends[1:])):
        if d:
            new = apart >= np.uint64(1) << np.uint64(64 - d)
        shared = ~(new & np.append(new[1:], True)) & (row < b - a)
        row, apart, new = row[shared], apart[shared], new[shared]
        if not len(row):
            break
        firsts, at = np.flatnonzero(new), row + a
        many = np.diff(firsts, append=len(row))
        pair[at] = np.repeat(np.add.reduceat(pair.take(at), firsts), many)
    return pair.real.copy(), pair.imag.copy()


def price(symbols: np.ndarray, contexts: list[np.ndarray], train: np.ndarray, code: tuple, alone: np.ndarray | None = None) -> np.ndarray:
    """Cost (-ln of the chance) of each symbol after its contexts, by a model that learns each as often as ``train`` says."""
    offsets, nodes, bits = code
    root = offsets.take(symbols + 1) - 1  # codes are held from the leaf up
    length = root + 1 - offsets.take(symbols)
    if not length.any():
        return np.zeros(len(symbols))
    falling = np.argsort((length.max() - length).astype(np.uint8), kind="stable")  # codes of more than 64 bits take more than 10**13 tokens
    root, times = root[falling], train[falling].astype(np.float32)
    rows = np.searchsorted(-length[falling], -np.arange(length.max()))  # that have a bit of each depth
    ends = np.concatenate([[0], np.cumsum(rows)])
    at = np.concatenate([root[:k] - d for d, k in enumerate(rows)])
    node, one = nodes.take(at), bits.take(at)
    y, n = one.astype(np.float32), len(contexts) + (alone is not None)
    path = np.zeros(len(root), np.uint64)
    for d, k in enumerate(rows):
        path[:k] |= one[ends[d] : ends[d + 1]].astype(np.uint64) << np.uint64(63 - d)
    rank = np.unique(path, return_inverse=True)[1].astype(np.uint64)
    learn = np.concatenate([times[:k] for k in rows])
    zeros, ones = zip(*(counted(c[falling], path, rank, learn, y, ends) for c in contexts))

    met = [np.minimum(n0 + n1, 4).astype(np.uint8) for n0, n1 in list(zip(zeros, ones))[-2:]]
    fixed = [] if alone is None else [alone.take(node)]

    def inputs(some, less):
        """(stretched chances, gates) of a slice of the bits; ``less``: as if each bit had not been counted (right for those learned from)."""
        yy = y[some]
        x, gate = np.empty((n, len(yy)), np.float32), np.uint8(0)
        if fixed:
            x[0] = fixed[0][some]
        for k, (n0, n1) in enumerate(zip(zeros, ones)):
            n0, n1 = n0[some], n1[some]
            if less:
                n0, n1 = np.maximum(n0 - (1 - yy), 0), np.maximum(n1 - yy, 0)
            x[n - len(ones) + k] = stretch(n0, n1)
        for q in met:
            gate = gate * np.uint8(4) + (q[some] - np.uint8(1) if less else np.minimum(q[some], np.uint8(3)))
        return x, gate

    start = np.full(n, 0.9 / n)
    weights, centres = np.tile(start, (GATES, 1)), np.linspace(-LIMIT, LIMIT, BUCKETS)
    maps, chance = np.tile(centres, (GATES, 1)), 1 / (1 + np.exp(-centres))
    x, gate = np.empty((n, len(y)), np.float32), np.empty(len(y), np.uint8)
    for a in range(0, len(y), BLOCK):
        x[:, a : a + BLOCK], gate[a : a + BLOCK] = inputs(slice(a, a + BLOCK), True)
    gate += gate
    gate += one
    gate[learn == 0] = 2 * GATES  # what is not learned from stands last
    order = np.argsort(gate, kind="stable")
    stops = np.searchsorted(gate.take(order), np.arange(2 * GATES + 1, dtype=np.uint8))  # of the zeros and the ones of each gate
    order = order[: stops[-1]]
    x, often = np.stack([r.take(order) for r in x]), learn.take(order)
    for g in range(GATES):
        first, middle, last = stops[2 * g : 2 * g + 3]
        mine = slice(first, last)
        if first == last:
            continue
        xs, many, ys = x[:, mine], often[mine], np.zeros(last - first, np.float32)
        ys[middle - first :] = 1
        for _ in range(STEPS):
            p = np.exp(-clipped(weights[g].astype(np.float32) @ xs))
            p += 1
            np.reciprocal(p, out=p)
            pull = xs @ (many * (ys - p)) - RIDGE * (weights[g] - start)
            p *= 1 - p
            curve = np.maximum(p, np.float32(0.005), out=p)
            curve *= many
            weights[g] += np.linalg.solve(np.array([xs @ (curve * r) for r in xs]) + RIDGE * np.eye(n), pull)
        bucket = np.rint((clipped(weights[g].astype(np.float32) @ xs) + LIMIT) * ((BUCKETS - 1) / (2 * LIMIT))).astype(np.int64)
        unset, are_set = (np.bincount(bucket[part], many[part], BUCKETS) for part in (slice(None, middle - first), slice(middle - first, None)))
        p = (are_set + 4 * chance) / (unset + are_set + 4)
        maps[g] = np.log(p / (1 - p))
    del x, gate, order, often
    weights, maps = weights.astype(np.float32), maps.astype(np.float32).ravel()
    spent = np.empty(len(y), np.float32)
    for a in range(0, len(y), BLOCK):
        some = slice(a, a + BLOCK)
        x, gate = inputs(some, False)
        gate = gate.astype(np.int64)
        dot = np.zeros(len(gate), np.float32)
        for k in range(n):
            dot += weights[:, k].take(gate) * x[k]
        place = (clipped(dot) + np.float32(LIMIT)) * np.float32((BUCKETS - 1) / (2 * LIMIT))
        low = np.minimum(place.astype(np.int64), BUCKETS - 2)
        part = place - low.astype(np.float32)
        low += gate * BUCKETS
        mean = (dot + maps.take(low) * (1 - part) + maps.take(low + 1) * part) * (np.float32(0.5) - y[some])
        spent[some] = np.maximum(mean, 0) + np.log1p(np.exp(-np.abs(mean)))  # ln(1 + e^mean)
    each, cost = np.zeros(len(symbols)), np.empty(len(symbols))
    for d, k in enumerate(rows):
        each[:k] += spent[ends[d] : ends[d + 1]]
    cost[falling] = each
    return cost


# --- packed numbers


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers of one length, byte by byte, compressed."""
    import zstandard

    raw = b"".join((a.astype(np.uint32) >> np.uint32(k)).astype(np.uint8).tobytes() for a in arrays for k in (0, 8, 16, 24))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(data: bytes, number: int) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(number, 4, -1)
    return [sum(b.astype(np.uint32) << np.uint32(8 * k) for k, b in enumerate(x)) for x in raw]


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers."""
    return np.diff(x, prepend=0)


# --- the corpus


def split(texts) -> tuple[np.ndarray, object]:
    """(number of words of each text of an Arrow array, all words in a row): ``tokens`` without the ends."""
    import pyarrow.compute as pc

    # no cast before this: pyarrow lower-cases the wrong bytes of a slice that was cast
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)  # white space at either side leaves an empty piece
    met = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return np.diff(met[lists.offsets.to_numpy() - lists.offsets[0].as_py()]), words.filter(full)


def count_words(docs: DataFrame) -> DataFrame:
    """(w, c): every token of all documents with its count over the training documents, nought if only others hold it."""

    def run(batches):
        import pyarrow as pa

        def out(words, times, ends):
            found = pa.concat_arrays(words).dictionary_encode()
            n = np.bincount(found.indices.to_numpy(), np.concatenate(times), len(found.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.binary()), pa.array(n)], names=["w", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], names=["w", "n"])

        words, times, ends, held = [], [], 0, 0
        for b in batches:
            train = b.column(1).to_numpy(zero_copy_only=False)
            n, found = split(b.column(0))
            words.append(found), times.append(np.repeat(train, n))
            held, ends = held + max(len(found), found.nbytes >> 6), ends + int(train.sum())
            if held >= FLUSH:
                yield from out(words, times, ends)
                words, times, ends, held = [], [], 0, 0
        if words:
            yield from out(words, times, ends)

    return docs.select("text", "train").mapInArrow(run, "w binary, n bigint").repartition("w").groupBy("w").agg(F.sum("n").alias("c"))


def shared_with_tasks(head, n: int, docs: int, shards: int) -> SimpleNamespace:
    """What tasks need to know: codes, word counts, shards and how widely common words are shared out (plain arrays and lists)."""
    words, counts = head["w"].to_pylist(), head["c"].to_numpy().astype(np.int64)
    with_others = np.append(counts, n - int(counts.sum()))
    code = huffman(np.maximum(with_others, 1))
    share = max(n // max(shards, 1), 1)
    spread = np.append(np.maximum(-(-counts // share), 1), [1, max(-(-docs // share), 1)]).astype(np.uint32)  # of words, others, starts
    return SimpleNamespace(name=uuid.uuid4().hex, words=words, escape=len(words), code=code, alone=alone_by_node(code, with_others), logs=np.append(np.log10(counts + 0.1), 0.0), shards=shards, spread=spread)


def head_of(know: SimpleNamespace):
    """The words of the head as an Arrow array, made once for each Python process."""
    import pyarrow as pa

    held = worker_store("scoring")
    if held.get("name") != know.name:
        held["name"], held["words"] = know.name, pa.array(know.words, pa.binary())
    return held["words"]


def token_stream(docs: DataFrame, shared) -> DataFrame:
    """Documents in stretches of about ``CHUNK`` tokens: (chunk, ids, docs, tokens, words).

    ``docs`` packs (tokens, bytes, training) of each document, ``tokens`` the place of each token in the head, or the
    head's size plus the place of its word in ``words``.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        know = shared.value
        escape, head = know.escape, head_of(know)
        number = TaskContext.get().partitionId() << 32

        def row(parts, number):
            ids, total, size, train, words = zip(*parts)
            total = np.concatenate(total)
            found = pa.concat_arrays(words).dictionary_encode()
            known = pc.index_in(pa.concat_arrays([found.dictionary.cast(pa.binary()), pa.array([b""], pa.binary())]), value_set=head)
            other = known.is_null().to_numpy(zero_copy_only=False)
            place = np.where(other, escape + np.cumsum(other) - 1, known.fill_null(0).to_numpy()).astype(np.uint32)
            rest = pa.concat_arrays([found.dictionary.cast(pa.binary()), pa.array([b""], pa.binary())]).filter(pa.array(other))
            stream, ends = np.empty(int(total.sum()), np.uint32), np.zeros(int(total.sum()), bool)
            ends[np.cumsum(total) - 1] = True
            stream[ends], stream[~ends] = place[-1], place[found.indices.to_numpy()]
            ids = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([packed(total, np.concatenate(size), np.concatenate(train))], pa.binary()), pa.array([packed(stream)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest)],
                names=["chunk", "ids", "docs", "tokens", "words"])

        held, parts = 0, []
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            train = b.column(2).to_numpy(zero_copy_only=False)
            n, words = split(b.column(1))
            until, at = np.concatenate([[0], np.cumsum(n + 1)]), 0
            while at < len(n):
                to = min(int(np.searchsorted(until, until[at] + CHUNK - held)), len(n))  # up to the document that fills the stretch
                parts.append((b.column(0).slice(at, to - at), n[at:to] + 1, size[at:to], train[at:to], words.slice(int(until[at]) - at, int(n[at:to].sum()))))
                held, at = held + int(until[to] - until[at]), to
                if held >= CHUNK:
                    yield row(parts, number)
                    parts, held, number = [], 0, number + 1
        if parts:
            yield row(parts, number)

    return docs.select("id", "text", "train").mapInArrow(run, f"chunk bigint, ids array<{kind}>, docs binary, tokens binary, words array<binary>")


def _read(batch):
    """(chunk, tokens of each document, bytes, training, token places, row) of the stretches of a batch."""
    of = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
    for k in range(batch.num_rows):
        n, size, train = unpacked(of["docs"][k].as_py(), 3)
        yield of["chunk"][k].as_py(), n.astype(np.int64), size, train, unpacked(of["tokens"][k].as_py(), 1)[0], {name: c[k] for name, c in of.items()}


def deal(stream: DataFrame, shared) -> DataFrame:
    """(shard, chunk, events, before): every token with the two words before it, sent to the shard of its contexts."""

    def run(batches):
        import pyarrow as pa

        know = shared.value
        escape = know.escape
        for b in batches:
            for chunk, n, _, train, at, row in _read(b):
                marks = np.fromiter(map(zlib.crc32, row["words"].values.to_numpy(zero_copy_only=False)), np.uint32, len(row["words"])) % np.uint32(START - escape) + np.uint32(escape)
                word = at.copy()
                other = at >= escape
                word[other] = marks[at[other] - escape]
                symbol = np.minimum(at, escape)
                doc = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                one, two, spread = np.full(len(at), START, np.uint32), np.full(len(at), START, np.uint32), np.full(len(at), escape + 1)
                one[1:], two[2:], spread[1:] = word[:-1], word[:-2], symbol[:-1]
                one[place < 1], two[place < 2], spread[place < 1] = START, START, escape + 1
                # a pair of words that takes more than a shard is shared out by document and place
                pair = hashed(one, two) >> np.uint32(16)
                copies = -(-np.bincount(pair, minlength=1 << 16) * know.shards // len(at))[pair]
                salt, hot = np.zeros(len(at), np.uint32), np.flatnonzero(copies > 1)
                salt[hot] = hashed(doc[hot], place[hot] >> 15) % copies[hot].astype(np.uint32)
                part = hashed(np.where(place < 2, doc, two).astype(np.uint32)) % know.spread[spread]
                shard = hashed(one, part, salt) % np.uint32(know.shards)
                order = np.argsort(shard.astype(np.uint16 if know.shards <= 1 << 16 else np.uint32), kind="stable")  # 16 bits sort several times faster
                ends = np.searchsorted(shard[order], np.arange(know.shards + 1))
                full = np.flatnonzero(np.diff(ends))
                data = []
                for s in full:
                    mine = order[ends[s] : ends[s + 1]]
                    words, number = np.unique(one[mine], return_inverse=True)
                    data.append((packed(symbol[mine], number, two[mine], steps(doc[mine] * 2 + train[doc[mine]])), packed(steps(words))))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array([e for e, _ in data], pa.binary()), pa.array([w for _, w in data], pa.binary())], names=["shard", "chunk", "events", "before"])

    return stream.select("chunk", "docs", "tokens", "words").mapInArrow(run, "shard int, chunk bigint, events binary, before binary")


def price_words(symbol: np.ndarray, one: np.ndarray, two: np.ndarray, train: np.ndarray, code: tuple, alone: np.ndarray) -> np.ndarray:
    """Cost of each token of a shard after the two words before it, in parts by the word before, each with its own counts and weights.

    What comes again after the same two words costs the same: it is priced once and learned as often as it was met.
    """
    befores, first = np.unique(one, return_inverse=True)
    seconds, second = np.unique(two, return_inverse=True)
    kinds = np.uint64(len(code[0]) - 1)
    # below 2**64 for shards of up to 2**23 tokens
    distinct, same = np.unique((first.astype(np.uint64) * np.uint64(len(seconds)) + second.astype(np.uint64)) * kinds + symbol.astype(np.uint64), return_inverse=True)
    times = np.bincount(same, train, len(distinct))
    pair, symbol = np.divmod(distinct, kinds)
    first, second = np.divmod(pair, np.uint64(len(seconds)))
    one, two, symbol = befores[first], seconds[second], symbol.astype(np.int64)
    part = hashed(one) % np.uint32(min(max(1, len(same) // PART), 1 << 16))
    order = np.argsort(part.astype(np.uint16), kind="stable")
    cost = np.zeros(len(distinct))
    for mine in np.split(order, np.searchsorted(part[order], np.arange(1, part.max(initial=0) + 1))):
        cost[mine] = price(symbol[mine], [one[mine], hashed(one[mine], two[mine])], times[mine], code, alone)
    return cost[same]


def learn_words(dealt: DataFrame, shared) -> DataFrame:
    """(chunk, costs): each shard learns its contexts and prices its tokens, added up by document."""

    def run(t):
        import pyarrow as pa

        know = shared.value
        rows = sorted(zip(t["chunk"].to_pylist(), t["events"].to_pylist(), t["before"].to_pylist()))
        parts = [unpacked(e, 4) for _, e, _ in rows]
        symbol, two = (np.concatenate([p[k] for p in parts]) for k in (0, 2))
        one = np.concatenate([np.cumsum(unpacked(w, 1)[0], dtype=np.uint32)[p[1]] for p, (_, _, w) in zip(parts, rows)])
        marks = [np.cumsum(p[3].astype(np.int64)) for p in parts]
        train = np.concatenate(marks) % 2 == 1
        cost = price_words(symbol, one, two, train, know.code, know.alone)
        out, at = [], 0
        for m in marks:
            doc = m >> 1  # ascending
            firsts = np.flatnonzero(np.diff(doc, prepend=-1))
            sums = np.add.reduceat(cost[at : at + len(m)], firsts)
            out.append(packed(steps(doc[firsts]), sums.astype(np.float32).view(np.uint32)))
            at += len(m)
        return pa.table({"chunk": pa.array([c for c, _, _ in rows], pa.int64()), "costs": pa.array(out, pa.binary())})

    return dealt.groupBy("shard").applyInArrow(run, "chunk bigint, costs binary")


def gathered(costs: DataFrame) -> DataFrame:
    """(chunk, place, cost) for each document of each stretch."""

    def run(t):
        import pyarrow as pa

        parts = [unpacked(c, 2) for c in t["costs"].to_pylist()]
        doc = np.concatenate([np.cumsum(p[0].astype(np.int64)) for p in parts])
        order = np.argsort(np.concatenate([p[1] for p in parts]), kind="stable")  # a sum that does not depend on the order of arrival
        total = np.bincount(doc[order], np.concatenate([p[1].view(np.float32) for p in parts])[order].astype(float))
        return pa.table({"chunk": pa.array([t["chunk"][0].as_py()] * len(total), pa.int64()), "place": pa.array(np.arange(len(total)), pa.int32()), "cost": pa.array(total, pa.float64())})

    return costs.groupBy("chunk").applyInArrow(run, "chunk bigint, place int, cost double")


def spelled(words: DataFrame, shards: int) -> DataFrame:
    """(w, known, log, spell) for distinct words (w, c): log10 of the smoothed count, and the cost of the word's bytes."""

    def run(t):
        import pyarrow as pa

        t = t.sort_by("w")
        found, c = t["w"].to_pylist(), t["c"].to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join(w + b"\xff" for w in found), np.uint8)  # in no UTF-8 text
        length = np.array([len(w) + 1 for w in found])
        owner = np.repeat(np.arange(len(found)), length)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(length) - length, length)
        last = []
        for k in (1, 2, 3):
            x = np.full(len(raw), 256, np.uint32)
            x[k:] = raw[:-k]
            x[place < k] = 256
            last.append(x)
        # all of the word so far, hashed; a beginning that the word before shares is the same row, learned as often as it is met
        far, fresh = np.zeros(len(raw), np.uint32), np.ones(len(raw), bool)
        first, here, steps_on = np.cumsum(length) - length, None, []
        like, alive = np.append(False, np.ones(len(found) - 1, bool)), np.arange(len(found))
        while len(alive):
            k = len(steps_on)
            here = first[alive] + k
            if k:
                far[here] = (far[here - 1] + raw[here - 1] + np.uint32(1)) * np.uint32(0x9E3779B1)
            like[alive] &= (length[alive - 1] > k) & (raw[here] == raw[np.minimum(first[alive - 1] + k, len(raw) - 1)])
            fresh[here] = ~like[alive]
            steps_on.append(here)
            alive = alive[length[alive] > k + 1]
        row = np.where(fresh, np.cumsum(fresh) - 1, 0)
        for here in steps_on:
            row[here] = np.maximum.accumulate(row[here])
        known = (c > 0)[owner]
        times = np.bincount(row, known, int(fresh.sum()))
        contexts = [x[fresh] for x in (last[0], hashed(*last[:2]), hashed(*last), hashed(far, place))]
        cost = price(raw[fresh].astype(np.int64), contexts, times, huffman(np.bincount(raw[known], minlength=256) + 1))
        return pa.table({"w": t["w"], "known": pa.array(c > 0), "log": pa.array(np.log10(c + 0.1)), "spell": pa.array(np.bincount(owner, cost[row], len(found)))})

    begun = words.withColumn("pre", F.substring("w", 1, 3))
    # beginnings that take more than a shard are shared out by word; there are at most as many of them as shards, so they are broadcast
    hot = begun.groupBy("pre").count().where(F.col("count") > SPELLED).select("pre", F.ceil(F.col("count") / SPELLED).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("w"), F.col("parts")), F.lit(0))
    dealt = begun.join(F.broadcast(hot), "pre", "left").select("w", "c", F.pmod(F.xxhash64("pre", part), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, "w binary, known boolean, log double, spell double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs``.

    The model learns from the rows where ``train`` holds (default: those outside the fold of crc32(id) modulo 10).
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    small_batches(spark)
    learns = F.coalesce(train if train is not None else ~in_fold(F.col(f"`{id_col}`"), 10), F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), learns.alias("train"))
    counts = materialize(count_words(rows), "lm-counts")
    n, words, types, starts = (x or 0 for x in counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") > 0), F.sum(F.when(F.col("w") == b"", F.col("c")))).first())
    # words met once have no code of their own: from them the escape and the spelling learn what a new word is like
    head = counts.where("c > 1").orderBy(F.desc("c"), "w").limit(HEAD).toArrow()
    shards = max(2 * shuffle_parts(spark), n // SHARD)
    shared = spark.sparkContext.broadcast(shared_with_tasks(head, n, starts, shards))  # at most HEAD words and their codes
    stream = materialize(token_stream(rows, shared), "lm-stream")
    costs = gathered(learn_words(deal(stream, shared), shared))

    def documents(batches):
        import pyarrow as pa

        know = shared.value
        escape = know.escape
        for b in batches:
            for chunk, total, size, train, at, row in _read(b):
                firsts = np.cumsum(total) - total
                logs = np.add.reduceat(know.logs[np.minimum(at, escape)], firsts)
                common = np.add.reduceat((at < escape).astype(np.int64), firsts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(total), pa.int64()), pa.array(np.arange(len(total)), pa.int32()), row["ids"].values, pa.array(train == 0), pa.array(total, pa.int64()), pa.array(size.astype(np.int64)), pa.array(common), pa.array(logs)],
                    names=["chunk", "place", "id", "held_out", "total", "bytes", "n", "base"])

    def others(batches):
        import pyarrow as pa

        escape = shared.value.escape
        for b in batches:
            for chunk, total, _, _, at, row in _read(b):
                here = np.flatnonzero(at >= escape)
                pair, times = np.unique(np.repeat(np.arange(len(total)), total)[here] << 32 | (at[here] - escape).astype(np.int64), return_counts=True)
                words = row["words"].values
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(pair), pa.int64()), pa.array((pair >> 32).astype(np.int32)), words.take(pa.array(pair & 0xFFFFFFFF)), pa.array(times.astype(np.int32))], names=["chunk", "place", "w", "n"])

    each = stream.select("chunk", "ids", "docs", "tokens").mapInArrow(documents, f"chunk bigint, place int, id {kind}, held_out boolean, total bigint, bytes bigint, n bigint, base double")
    tail = stream.select("chunk", "docs", "tokens", "words").mapInArrow(others, "chunk bigint, place int, w binary, n int")
    beyond = counts  # the words without a code: those after the last of the head
    if head.num_rows:
        w, c = head["w"][-1].as_py(), head["c"][-1].as_py()
        beyond = counts.where((F.col("c") < c) | ((F.col("c") == c) & (F.col("w") > F.lit(w))))
    priced = materialize(spelled(beyond, max(2 * shuffle_parts(spark), (words - head.num_rows) // SPELLED)), "lm-words")
    of_tail = tail.join(priced.hint("shuffle_hash"), "w").groupBy("chunk", "place").agg(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("tn"), F.sum(F.col("n") * F.col("log")).alias("tbase"), F.sum(F.col("n") * F.col("spell")).alias("tcost"))
    met = each.join(costs, ["chunk", "place"], "left").join(of_tail, ["chunk", "place"], "left")
    whole = -(F.coalesce("cost", F.lit(0.0)) + F.coalesce("tcost", F.lit(0.0)))
    return met.select(
        F.col("id").alias(id_col), "held_out", F.col("total").alias("n_tokens"), (F.col("n") + F.coalesce("tn", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tbase", F.lit(0.0)) - F.col("total") * F.lit(math.log10(n + 0.1 * (types + 1)))).alias("base_score"),
        (whole / F.lit(math.log(10))).alias("score"), (-whole / F.lit(math.log(2)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"))


def op6_scoring(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
