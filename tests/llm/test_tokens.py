import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from meshq.llm import packing, tokens

ODD = [
    None, "", "  \n\t", "Hello World", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ", "é ́x", "a\x1cb\x85c\xa0d​e　f", "don'T x're 12ab ''s", "KK", "a\x00b",
    "ﬁ 日本語 text", "_x_y!!!???", "👩‍👩‍👧", "aaaaaaaaaaaaaaaaaaa" * 40, "hahahahahahahaha", "<|endoftext|><|endoftext|>", "x" * 3000, "한국어 한",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary_path())


def texts():
    r = random.Random(4)
    abc = "abcdefghijklmnopqrstuvwxyz'<|>., éñüß\n\t0123ΣAZ日́"
    return ODD + ["".join(r.choice(abc) for _ in range(r.randint(1, 400))) for _ in range(150)]


def test_counts_equal_library(spark, library):
    rows = list(enumerate(texts()))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows += [(1000 + d.doc_id, d.text) for d in docs]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048), t
    assert tokens.token_counts(df.filter("doc_id < 0")).count() == 0


def test_pieces_equal_library(library):
    e = packing.Encoder(tokens.vocabulary_path())
    for t in texts():
        assert np.frombuffer(e.encode((t or "").encode()), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_pieces_in_little_memory(library):
    words = ["Straße", "ÉTÉ,", "e\u0301t", "H\u0331A.", "İx", "ΣΑΣ", "Привет!", "ŉa", "<|ENDOFTEXT|>", "<|endoftext|>A.", "don't,", "word.%%%", "X###", "it's's", ".", "...,", "a1", "\x1ca", "日本.", "ǅa", "\u0345a", "a\u00a0B"]
    r = random.Random(5)
    words += ["".join(r.choice("abcdeéüñTHS") for _ in range(r.randint(1, 12))) + r.choice(["", "", ".", "!?"]) for _ in range(600)] + ["Long" * 40 + "."]
    rows = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(400)] + words + ["", "  ", "\ta \n b\v"]
    e = packing.Encoder(tokens.vocabulary_path(), 30_000)
    for at in range(0, len(rows), 50):
        some = rows[at : at + 50]
        got = list(e.of(pa.array([t.encode() for t in some], pa.binary())))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in some]
        # A generation is full at half the memory, and may grow by what one slice has.
        assert all(len(g) * packing.ENTRY < 15_000 + 620 * packing.ENTRY for g in (e.known.young, e.known.old))
    assert e.known.old and max(map(len, {**e.known.young, **e.known.old})) <= 64


def test_packing_gets_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    write = packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, name: seen.append((name, spark.conf.get(key))) or write(df, name))
    before = spark.conf.get(key)
    packing.pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), 256)
    assert ("pieces", str(packing.BATCH)) in seen and spark.conf.get(key) == before


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_supersteps_are_as_good_as_best_fit(spark):
    r = random.Random(8)
    for capacity, n in ((7, 60), (200, 0), (200, 300), (4096, 400)):
        lengths = [r.randint(1, capacity) if r.random() < 0.6 else r.randint(1, 1 + capacity // 5) for _ in range(n)]
        runs = spark.createDataFrame(sorted((x, lengths.count(x)) for x in set(lengths)), "length long, n long")
        used, placed = defaultdict(int), defaultdict(list)
        for p in packing.packing_plan(runs, capacity).collect():
            placed[p["size"]].append((p["at"], p["n"]))
            for k in range(p["n"]):
                s = p["base"] + k // p["each"]
                if k % p["each"] == 0:
                    assert used[s] == capacity - p["gap"]  # a gap begins where the last piece ended
                used[s] += p["size"]
        for x, parts in placed.items():
            at = 0
            for rank, m in sorted(parts):
                assert rank == at
                at += m
            assert at == lengths.count(x)
        assert set(placed) == set(lengths) and all(u <= capacity for u in used.values())
        best = best_fit(lengths, capacity)
        assert len(used) <= best + max(1, best // 50), (capacity, len(used), best)


def test_pack(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, "Hello World", "x")] * 40 + [(500, "pro " * 9000, "x"), (None, "one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = packing.pack(df, 256, rows_each=5).collect()
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t, _ in rows]
    want = [(i, k, k * 256, len(x[k * 256 : k * 256 + 256]), zlib.crc32(x[k * 256 : k * 256 + 256].tobytes())) for (i, _, _), x in zip(rows, ids) for k in range(-(-len(x) // 256))]
    assert sorted(map(str, want)) == sorted(str(tuple(r[:5])) for r in got)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 256
    best = best_fit([w[3] for w in want], 256)
    assert len(seqs) <= best + max(1, best // 50)
    assert packing.pack(df.filter("doc_id < 0"), 256).count() == 0


def test_words_are_kept_for_when_they_come_again():
    known, made = packing.Recent(packing.HELD), []
    words = [f"w{i:09d}".encode() for i in range(340_000)]

    def make(lost):
        made.append(len(lost))
        return dict.fromkeys(lost, bytes(16))

    for _ in range(2):
        for i in range(0, len(words), 10_000):
            known.of(words[i : i + 10_000], make)
    assert sum(made) == len(words)
