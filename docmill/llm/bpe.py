"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-tokenisation uses no regex. Code points are mapped to classes (letter,
number, white space, other; with one look ahead for the last white space of a
run and for contractions) by array look-ups. A class is a transition function
on the tokeniser's states; functions compose associatively, so states are found
by a scan: compose within blocks of ``BLOCK`` positions for all start states at
once, combine the blocks' functions by doubling, then walk all blocks together.
A token begins where the (state, class) table says so.

Each slice is encoded by merging its bytes pairwise, lowest rank first and leftmost
of equal ones (see ``merged``), with a bounded cache of slices. Offsets of the ids in
the text's bytes are kept, so any range of ids decodes to an exact range of bytes.

Edge cases: a null text counts as empty, an empty text has no ids; lone
surrogates cannot occur in Spark strings; texts of any length are cut at token
starts into windows of ``WINDOW`` code points; equal rows get equal ids; other
columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import no_cycles, sliced, small_batches, table, worker_store

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK = 32
WINDOW = 1 << 19
CACHE, CACHED = 200_000, 48  # slices held, and bytes of the longest
SHORT = 128  # pieces up to so many bytes are merged in plain lists, longer ones with a heap

# classes of positions; BREAK stands between two texts
L, N, O, W, W_END, BLANK_END, CUT1, CUT2, BREAK = range(9)
# states after a position: nothing yet, in a letter, number, other or white run, a blank that joins what follows,
# one or two letters of a contraction to come, contraction ended
NONE, IN_L, IN_N, IN_O, IN_W, JOIN, ONE, TWO, ENDED = range(9)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, token begins here), both by class and state."""
    goes, begins = np.zeros((9, 9), np.uint8), np.ones((9, 9), bool)
    for kind, run in ((L, IN_L), (N, IN_N), (O, IN_O), (W, IN_W), (W_END, IN_W), (BLANK_END, JOIN), (CUT1, ONE), (CUT2, TWO)):
        goes[kind] = run
    for kind, run in ((L, IN_L), (N, IN_N), (O, IN_O)):
        begins[kind, [run, JOIN]] = False
    begins[W, IN_W] = False
    goes[L, ONE], goes[L, TWO] = ENDED, ONE
    begins[L, [ONE, TWO]] = False
    for kind in (CUT1, CUT2):  # within a run of others, or after a blank, an apostrophe is like any other
        goes[kind, [IN_O, JOIN]] = IN_O
        begins[kind, [IN_O, JOIN]] = False
    return goes, begins


_GOES, _BEGINS = _machine()
_GOES_TABLE, _BEGINS_TABLE = (x.astype(np.uint8).tobytes().ljust(256, b"\0") for x in (_GOES, _BEGINS))


def _look(at: np.ndarray, by_byte: bytes) -> np.ndarray:
    return np.frombuffer(at.tobytes().translate(by_byte), np.uint8).reshape(at.shape)


def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    out = np.full(0x110000, O, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, what in ((L, r"\p{L}"), (N, r"\p{N}"), (W, r"\s")):
        found = "".join(regex.findall(what + "+", every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def classes(cp: np.ndarray, by_cp: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Classes with look ahead. The end counts as the text's end, and so does each of ``breaks``."""
    c = by_cp[cp]
    n = len(cp)
    c[breaks] = W
    white = c == W
    follows = np.zeros(n, bool)
    follows[:-1] = ~white[1:]
    ends = white & follows
    if len(breaks):
        ends[breaks] = False
        follows[breaks[breaks > 0] - 1] = False
        ends &= follows
    c[ends] = np.where(cp[ends] == 32, BLANK_END, W_END)
    at = np.flatnonzero(cp[:-1] == 39) if n else np.empty(0, np.int64)
    if len(at):
        after = np.zeros(n + 3, np.uint32)
        after[:n] = cp
        a, b = after[at + 1], after[at + 2]
        one = np.isin(a, [115, 116, 109, 100])
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        c[at[one]] = CUT1
        c[at[two]] = CUT2
    c[breaks] = BREAK
    return c


def token_starts(c: np.ndarray) -> np.ndarray:
    """Positions where a token begins, by a scan of composed transition functions."""
    n = len(c)
    if not n:
        return np.empty(0, np.int64)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, W, np.uint8)
    grid[:n] = c
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    whole = np.broadcast_to(np.arange(9, dtype=np.uint8), (blocks, 9))
    for row in grid:
        whole = _look(row[:, None] * np.uint8(9) + whole, _GOES_TABLE)
    # inclusive scan over blocks: after step k, whole[i] is the composition of blocks i-2k+1 .. i
    step = 1
    while step < blocks:
        composed = np.take_along_axis(whole[step:], whole[:-step], 1)
        whole = np.concatenate([whole[:step], composed])
        step *= 2
    state = np.full(blocks, NONE, np.uint8)
    state[1:] = whole[:-1, NONE]
    begins = np.empty((BLOCK, blocks), bool)
    for j, row in enumerate(grid):
        at = row * np.uint8(9) + state
        begins[j] = _look(at, _BEGINS_TABLE)
        state = _look(at, _GOES_TABLE)
    return np.flatnonzero(begins.T.ravel()[:n])


_NO_BREAKS = np.empty(0, np.int64)


def slices(text: str, by_cp: np.ndarray):
    """The text's tokens before merging, in order: they join to the text."""
    at, size = 0, WINDOW
    while at < len(text):
        piece = text[at : at + size]
        cuts = token_starts(classes(np.frombuffer(piece.encode("utf-32-le"), np.uint32), by_cp, _NO_BREAKS)).tolist()
        end = len(piece)
        if at + end < len(text):
            # what begins near the end may depend on what follows; the next window starts where a token surely does
            while cuts and cuts[-1] > len(piece) - 4:
                cuts.pop()
            if len(cuts) < 2:
                size *= 2
                continue
            end = cuts.pop()
        size = WINDOW
        yield from [piece[a:b] for a, b in zip(cuts, [*cuts[1:], end])]
        at += end


def slices_of(texts: list[str], by_cp: np.ndarray) -> list[list[str]]:
    """``slices`` of many short texts in one scan."""
    joined = "\0".join(texts)
    breaks = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)[:-1] - 1
    starts = token_starts(classes(np.frombuffer(joined.encode("utf-32-le"), np.uint32), by_cp, breaks))
    firsts = np.searchsorted(starts, breaks).tolist()
    cuts = starts.tolist()
    pieces = [joined[a:b] for a, b in zip(cuts, [*cuts[1:], len(joined)])]
    out, at = [], 0
    for end in firsts:  # pieces[end] is the break itself
        out.append(pieces[at:end])
        at = end + 1
    return [*out, pieces[at:]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of the lowest rank merges, the leftmost of equal ones, until no pair has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    return _merged_short(piece, ranks.get) if len(piece) <= SHORT else _merged_long(piece, ranks.get)


_NONE = 1 << 60


def _merged_short(piece: bytes, rank) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [rank(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < _NONE:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], _NONE)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], _NONE)
    return [rank(p) for p in parts]


def _merged_long(piece: bytes, rank) -> list[int]:
    """The same in n log n: candidates wait in a heap by (rank, place); those whose ends have moved on are skipped."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that begins here
    before = list(range(-1, n))  # beginning of the part before
    alive = [True] * n + [False]
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2], _NONE)) < _NONE]
    heapq.heapify(heap)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if not (alive[a] and end[a] == b and alive[b] and end[b] == c):
            continue
        end[a], alive[b] = c, False
        if c < n:
            before[c] = a
            if (r := rank(piece[a : end[c]], _NONE)) < _NONE:
                heapq.heappush(heap, (r, a, c, end[c]))
        if a:
            p = before[a]
            if (r := rank(piece[p:c], _NONE)) < _NONE:
                heapq.heappush(heap, (r, p, a, c))
    return [rank(piece[i : end[i]]) for i in range(n) if alive[i]]


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded cache of slices."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.bytes[i] = b
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.by_cp = class_table()
        self.cache: dict[str, tuple[int, ...]] = {}

    def _new(self, piece: str) -> tuple[int, ...]:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        raw = piece.encode("utf-8", "replace")
        ids = tuple(merged(raw, self.ranks))
        if len(raw) <= CACHED:
            self.cache[piece] = ids
        return ids

    def parts(self, text: str):
        cache, new = self.cache, self._new
        for piece in slices(text, self.by_cp):
            yield cache.get(piece) or new(piece)

    def encode_all(self, texts: list[str | None]):
        """Ids of each text, in order; short texts share a scan of up to ``WINDOW`` code points."""
        cache, new = self.cache, self._new
        group, held = [], 0
        for i, t in enumerate(texts):
            group.append(t or "")
            held += len(group[-1]) + 1
            if held >= WINDOW or i == len(texts) - 1:
                if len(group) == 1:
                    yield self.encode(group[0])
                else:
                    for pieces in slices_of(group, self.by_cp):
                        yield list(chain.from_iterable([cache.get(p) or new(p) for p in pieces]))
                group, held = [], 0

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text))) if text else []

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Where each id's bytes begin, and the total."""
        return np.concatenate([[0], np.cumsum([len(self.bytes[i]) for i in ids], dtype=np.int64)])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def codec(path: str) -> Codec:
    """The vocabulary's codec, made once for each Python process."""
    store = worker_store("bpe")
    if path not in store:
        with no_cycles():
            store[path] = Codec(path)
    return store[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids, offsets) for every row: token ids and where each id's bytes begin in the text's UTF-8."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        c = codec(path or default_path())
        for b in batches:
            for k in range(0, b.num_rows, 64):  # bounded output batches
                ids = list(c.encode_all(b.column(1)[k : k + 64].to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 64], pa.array(ids, pa.list_(pa.int32())), pa.array([c.offsets(x) for x in ids], pa.list_(pa.int64()))], names=[id_col, "ids", "offsets"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, offsets array<bigint>")


def decode(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, bytes) for rows with ``ids``."""
    small_batches(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        c = codec(path or default_path())
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py() or []) for x in b.column(1)], pa.binary())], names=[id_col, "bytes"])

    return encoded.select(F.col(f"`{id_col}`").alias("id"), "ids").mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, keeping digests only."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        c = codec(path or default_path())
        for b in (part for whole in batches for part in sliced(whole)):
            counts, encoded, decoded = [], [], []
            with no_cycles():
                for ids in c.encode_all(b.column(1).to_pylist()):
                    counts.append(len(ids))
                    encoded.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), path=default_path())
