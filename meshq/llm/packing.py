"""Best-fit packing into sequences of a fixed number of tokens.

Documents are tokenized, ended by id 1, and cut into pieces only if they are longer than a sequence. Pieces are then placed by
bulk-synchronous best fit. Pieces of one length are a run, and so are sequences with one gap. In each superstep the runs of a band of
lengths and the gaps are dealt by ranges of size; every range is swept in descending order, so that each run meets its successors,
the smallest gaps that hold it, and pieces compete for them by rank. What a range leaves is carried to the gaps of those above, and
what fits nowhere opens new sequences. Gaps are updated, and supersteps follow until the band is placed; then comes the next band.
A length is at most the sequence's, so the runs are at most so many however many documents there are: documents only get
their rank within a run, by a two-step count, and look their place up. There are about as many sequences as best-fit decreasing
one by one makes; tests compare the two.

Null text counts as empty: a document of the end id alone. Repeated rows are packed each by itself; ties are broken by id, piece and
checksum. Very long texts are read whole. An empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from heapq import heapify, heappop, heappush
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshq.llm.common import materialize, worker_cache
from meshq.llm.tokens import KEPT_LENGTH, SLICE, byte_symbols, lower, read_vocabulary, vocabulary_path

END = 1


#: Letters above may be newer than the library's tables; words with one go through all of its steps.
LATER = "\u0530"
#: Bytes that a Python worker keeps pieces in: two generations of half as many. An entry costs ENTRY besides its piece and ids.
HELD, ENTRY = 192 << 20, 200
#: Rows that a worker gets at once.
BATCH = 500


def lowered(texts: pa.Array) -> pa.Array:
    """In lower case, as far as ASCII goes, where that changes nothing else: special strings stay, and letters before marks that they may
    be composed with."""
    raw = texts.view(pa.binary())
    kept = reduce(pc.or_, [pc.match_substring(raw, x) for x in (b"<|", b"\xcc", b"\xcd")])
    return pc.if_else(kept, texts, pc.ascii_lower(texts))


def sliced(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in turn, as many at once as hold about SLICE bytes."""
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def parts(piece: str) -> tuple[str, str, bool]:
    """The piece without the marks of ASCII at its end, if letters come before, which make a pre-token of their own; those marks; and whether
    the first is one run of letters in its final form."""
    mark = ""
    if not piece.isalpha():
        rest = piece.rstrip(punctuation)
        if not rest.isalpha():
            return piece, mark, False
        piece, mark = rest, piece[len(rest) :]
    if piece.isascii():
        return piece.lower(), mark, True
    if max(piece) < LATER and unicodedata.is_normalized("NFC", piece) and (low := lower(piece)).isalpha():
        return low, mark, True
    return piece, mark, False


class Recent:
    """What pieces of text were made into, by last use: when the younger generation is full it becomes the older one, which goes. Long
    pieces aren't kept."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old, self.held = most // 2, {}, {}, 0

    def of(self, pieces: list[bytes], make) -> list[bytes]:
        if self.held > self.most:
            self.young, self.old, self.held = {}, self.young, 0
        out = list(map(self.young.get, pieces))
        lost = [i for i, v in enumerate(out) if v is None]
        if lost:
            names = [pieces[i] for i in lost]
            found = dict(zip(names, map(self.old.get, names), strict=True))
            found |= make([w for w, v in found.items() if v is None])
            for i, v in zip(lost, found.values(), strict=True):
                out[i] = v
            if max(map(len, names)) > KEPT_LENGTH:
                found = {w: v for w, v in found.items() if len(w) <= KEPT_LENGTH}
            self.young.update(found)
            self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)
        return out


class Encoder:
    """Token ids as little-endian bytes, by the tokenizers library. White space of ASCII never joins two tokens, so that the ids of the
    pieces between follow one another; short ones are kept for when they come again, in bounded memory. A run of letters that the
    library's normal form and pre-tokens would leave as it is goes to its merges straight, as bytes in their written form. What is known
    of the vocabulary's steps is checked when it is read."""

    def __init__(self, path: str, held: int = HELD) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        model = read_vocabulary(path)["model"]
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.written = str.maketrans({b: c for b, c in enumerate(byte_symbols()) if b != 32})
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(model["end_of_word_suffix"])]] = True
        self.known = Recent(held)

    def ids_of_words(self, words: list[str]) -> dict[str, bytes] | None:
        """Of runs of letters in their final form, as one text: each ends with a token that ends a word. None if that doesn't come out."""
        if not words:
            return {}
        text = " ".join(words).encode().decode("latin-1").translate(self.written)
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return None
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True)}

    def made(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        if not pieces:
            return {}
        split = [parts(t) for t in b"\n".join(pieces).decode("utf-8", "replace").split("\n")]
        marks = {m for _, m, _ in split}
        known = self.known.young
        ids = {c: v for c in {c for c, mark, word in split if word and mark} if (v := known.get(c.encode()))}
        ids |= self.ids_of_words(list({c for c, _, word in split if word}.difference(ids))) or {}
        rest = list({c for c, _, _ in split}.union(marks).difference(ids))
        ids |= {c: array("I", e.ids).tobytes() for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True)}
        return {w: ids[c] + ids[mark] if mark else ids[c] for w, (c, mark, _) in zip(pieces, split, strict=True)}

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        """Of UTF-8 texts; of a slice, every piece is looked up once."""
        for some in sliced(texts.fill_null(b"").view(pa.string())):
            lists = pc.ascii_split_whitespace(lowered(some))
            coded = lists.values.dictionary_encode()
            ids = self.known.of(coded.dictionary.view(pa.binary()).to_pylist(), self.made)
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            index, flat = coded.indices.to_numpy(), np.frombuffer(b"".join(ids), "<u4")
            long = n[index]
            ends = np.r_[0, np.cumsum(long)]
            raw = flat[np.repeat((np.cumsum(n) - n)[index] - ends[:-1], long) + np.arange(ends[-1])].tobytes()
            cuts = (4 * ends[lists.offsets.to_numpy()]).tolist()
            for a, b in zip(cuts, cuts[1:]):
                yield raw[a:b]

    def encode(self, text: bytes) -> bytes:
        return next(self.of(pa.array([text], pa.binary())))


def encoder(path: str) -> Encoder:
    """One per Python worker, which Spark uses for task after task."""
    return worker_cache(f"ids {path}", lambda: Encoder(path))


def pieces(documents: DataFrame, capacity: int, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or vocabulary_path()).of
        step, end = 4 * capacity, np.array([END], "<u4").tobytes()
        for b in batches:
            rows, cols = [], ([], [], [], [])
            for i, ids in enumerate(encode(b.column(1).cast(pa.binary()))):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(i)
                    for c, v in zip(cols, (k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


#: Rows of the packing's state, and what they hold: a run of pieces (length, first rank, number), sequences with one gap (gap, first
#: sequence, number), pieces with a place (length, first rank, number, how many to a sequence, first sequence, the gap they went to),
#: and how many sequences there are.
STATE = "what int, size long, at long, n long, each long, base long, gap long"
PIECE, GAP, PLACED, MADE = range(4)
#: Ranges of sizes that a superstep sweeps by themselves.
RANGES = 16
#: Bands of lengths end above these parts of a sequence. Pieces of one of the first fill a sequence so far that what is left holds none of
#: their band, so that opening sequences for a whole band at once costs nothing.
CUTS = (2, 3, 4, 5, 8, 16, 64)


def successor_sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]]) -> tuple[list, list, list]:
    """pieces (length, rank, n) and gaps (gap, base, n): placed (length, rank, n, each, base, gap), and the pieces and gaps left.

    Both pass by in descending order; gaps wait on a stack, whose top is a piece's successor, the smallest gap that holds it. Pieces of a
    run take it by their rank. What is left of a gap is smaller than the piece and takes its turn later on."""
    todo = [(-g, 0, base, n) for g, base, n in gaps] + [(-length, 1, rank, n) for length, rank, n in pieces]
    heapify(todo)
    stack, placed, left = [], [], []
    while todo:
        size, is_piece, at, n = heappop(todo)
        size = -size
        if not is_piece:
            stack.append((size, at, n))
            continue
        while n and stack:
            gap, base, many = stack.pop()
            each = gap // size
            full = min(many, n // each)
            if full:
                placed.append((size, at, full * each, each, base, gap))
                at, n = at + full * each, n - full * each
                if gap > each * size:
                    heappush(todo, (each * size - gap, 0, base, full))
            if full < many and 0 < n < each:  # fewer than a sequence takes
                placed.append((size, at, n, n, base + full, gap))
                if gap > n * size:
                    heappush(todo, (n * size - gap, 0, base + full, 1))
                at, n, full = at + n, 0, full + 1
            if full < many:
                stack.append((gap, base + full, many - full))
        if n:
            left.append((size, at, n))
    return placed, left, stack


def opened(left: list[tuple[int, int, int]], made: int, capacity: int) -> tuple[list, list, list, int]:
    """New sequences for pieces that no gap holds: placed, left, gaps, and how many sequences there are then. Pieces of one length fill
    sequences of their own; for those that are too few, as many open as their tokens fill."""
    placed, rest, gaps, tokens = [], [], [], 0
    for length, rank, n in left:
        each = capacity // length
        full = n // each
        if full:
            placed.append((length, rank, full * each, each, made, capacity))
            if capacity > each * length:
                gaps.append((capacity - each * length, made, full))
            made, rank, n = made + full, rank + full * each, n - full * each
        if n:
            rest.append((length, rank, n))
            tokens += n * length
    if tokens:
        more = -(-tokens // capacity)
        gaps.append((capacity, made, more))
        made += more
    return placed, rest, gaps, made


def _read(t: pa.Table) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {PIECE: [], GAP: [], PLACED: [], MADE: []}
    for what, *row in sorted(zip(*(t.column(c).to_pylist() for c in ("what", "size", "at", "n", "each", "base", "gap")), strict=True)):
        out[what].append(tuple(row[:3]) if what in (PIECE, GAP) else tuple(row))
    return out


def _rows(placed, pieces, gaps, made: list[int]) -> pa.Table:
    rows = [(PLACED, *p) for p in placed] + [(PIECE, *p, 0, 0, 0) for p in pieces] + [(GAP, *g, 0, 0, 0) for g in gaps] + [(MADE, 0, m, 0, 0, 0, 0) for m in made]
    names = ("what", "size", "at", "n", "each", "base", "gap")
    return pa.table({c: pa.array([r[i] for r in rows], pa.int32() if c == "what" else pa.int64()) for i, c in enumerate(names)})


def superstep(state: DataFrame, low: int, capacity: int) -> DataFrame:
    """state: rows of STATE, the pieces those of one band, all longer than low. Each range of sizes is swept by itself; then what it
    leaves meets the gaps of the ranges above, and new sequences open for pieces that fit nowhere. All rows are runs, whose number the
    capacity bounds whatever the corpus holds."""
    width = max(1, capacity // RANGES)

    def within(t: pa.Table) -> pa.Table:
        r = _read(t)
        if not r[PIECE]:
            return t.select(["what", "size", "at", "n", "each", "base", "gap"])
        placed, left, gaps = successor_sweep(r[PIECE], r[GAP])
        return _rows(r[PLACED] + placed, left, gaps, [m[1] for m in r[MADE]])

    def across(t: pa.Table) -> pa.Table:
        r = _read(t)
        made = max((m[1] for m in r[MADE]), default=0)
        small = [g for g in r[GAP] if g[0] <= low]
        placed, left, gaps = successor_sweep(r[PIECE], [g for g in r[GAP] if g[0] > low])
        more, left, new, made = opened(left, made, capacity)
        return _rows(r[PLACED] + placed + more, left, small + gaps + new, [made])

    part = F.when(F.col("what").isin(PIECE, GAP), F.floor(F.col("size") / width)).otherwise(-1)
    each = state.withColumn("part", part).groupBy("part").applyInArrow(within, STATE)
    return each.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(across, STATE)


def packing_plan(runs: DataFrame, capacity: int) -> DataFrame:
    """runs (length, n): the rows of STATE that place all pieces. Bands of lengths follow one another, the longest first; within
    a band supersteps are repeated until every piece has a place."""
    spark, done = runs.sparkSession, []
    state = spark.createDataFrame([(MADE, 0, 0, 0, 0, 0, 0)], STATE)
    lengths = [r.length for r in runs.select("length").collect()]  # at most capacity rows
    lows = [capacity // c for c in CUTS] + [0]
    for low, high in zip(lows, [capacity, *lows[:-1]], strict=True):
        if not any(low < x <= high for x in lengths):
            continue
        zero = F.lit(0).cast("long")
        mine = runs.filter((F.col("length") > low) & (F.col("length") <= high)).select(F.lit(PIECE).alias("what"), F.col("length").alias("size"), zero.alias("at"), "n", zero.alias("each"), zero.alias("base"), zero.alias("gap"))
        state, left = state.unionByName(mine), True
        while left:
            got = materialize(superstep(state, low, capacity), "packing-step")
            done.append(got.filter(F.col("what") == PLACED))
            state = got.filter(F.col("what") != PLACED)
            left = not got.filter(F.col("what") == PIECE).isEmpty()
    return reduce(DataFrame.unionByName, done) if done else state.filter("false")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within hands Python at most so many rows at once, which bounds the memory of executors and workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pack(documents: DataFrame, capacity: int = 4096, path: str | None = None, rows_each: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with batches_of(documents.sparkSession, BATCH):
        p = materialize(pieces(documents, capacity, path), "pieces")
    runs = materialize(p.groupBy("length").agg(F.count("*").alias("n")), "packing-runs")  # at most capacity rows
    found = packing_plan(runs, capacity).select("size", "at", "each", "base", "gap").toArrow()
    plan = np.stack([c.to_numpy() for c in found.columns], axis=1).reshape(-1, 5)
    plan[:, 4] = capacity - plan[:, 4]
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    total = runs.agg(F.sum("n")).first()[0] or 0
    # The rank within a length: a count of the parts before, and a count within the part.
    parts = max(16, total // rows_each)
    p = p.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = p.groupBy("length", "_part").agg(F.count("*").alias("_n")).select("length", "_part", F.coalesce(before, F.lit(0)).alias("_base"))
    w = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = p.withColumn("_in", F.row_number().over(w) - 1).join(base, ["length", "_part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_in")).cast("long").alias("rank"))
    shared = documents.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity alone

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = (t[:, 0] << 48) | t[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = t[np.searchsorted(keys, (length << 48) | rank, side="right") - 1] if len(length) else t[:0]
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 3] + k // row[:, 2]), pa.array(row[:, 4] + k % row[:, 2] * length)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
