import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from meshq.llm import simhash
from meshq.llm.components import components


def test_code_is_perfect():
    g = simhash.golay()
    x = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    i, _ = g.nearest(x)
    assert (np.bitwise_count(x ^ g.words[i]) <= 3).all()
    near, holds = g.near(x)
    for row in range(40):
        assert sorted(near[row][holds[row]]) == np.flatnonzero(np.bitwise_count(g.words ^ x[row]) <= 4).tolist()


def brute(text, n=3):
    w = [x for x in text.encode().lower().split()]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_links_equal_brute_force(spark):
    r = random.Random(5)
    fps = set()
    for _ in range(60):
        f = r.getrandbits(64)
        fps.add(f)
        for _ in range(6):
            fps.add(f := f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    want = {(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    got = {(x.a % (1 << 64), x.b % (1 << 64)) for x in got}
    assert got | {(b, a) for a, b in got} == want


def test_components_equal_brute_force(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (3, None)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((x.node, x.root) for x in got) == sorted((n, find(n)) for n in root)


def test_classes(spark):
    r = random.Random(9)
    words = [f"w{i}é" for i in range(300)]
    texts = [None, "", "  \n", "One", "one", "a B", "ſ K", " ".join(words) * 3]
    for _ in range(25):
        t = [r.choice(words) for _ in range(r.randint(2, 120))]
        texts += [" ".join(t), "\t".join(t).upper().replace("É", "é"), " ".join(t[:-1] + ["zz"])]
    rows = [(100 - i, t, "x") for i, t in enumerate(texts)] + [(50, texts[50], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    fp = {(i, t): brute(t or "") for i, t, _ in rows}
    ids = list(fp)
    root = {i: i for i, _ in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in ids:
        for b in ids:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    got = simhash.classes(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{fp[i, t]:016x}", find(i)) for i, t, _ in rows)
    assert simhash.classes(df.filter("doc_id < 0")).count() == 0
