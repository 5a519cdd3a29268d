import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshq.llm import queries, simhash, topk, toxicity, warc

DIR = "/root/testdata/sf0.001"


def test_topk_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-1.5, -0.2, 0.0, 0.31, 0.9]) for _ in range(6)], 0) for i in range(700)]
    rows += [(i, [0.5] * 6, 0) for i in range(700, 760)] + [(800, None, 0), (820, [0.1, None] + [0.0] * 4, 0), (840, [float("nan")] * 6, 0), (860, [float("inf")] * 6, 0), (880, [], 0), (None, [0.5] * 6, 0), (900, [0.25, 0.5], 0), (901, [0.5, -0.5], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for x in topk.search_table(df).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    ok = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    for q in (i for i in ok if i % 20 == 0):
        s = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:20]
        assert sorted(got.pop(q, [])) == [(n + 1, i, -a) for n, (a, i) in enumerate(s)]
    assert not got and topk.search_table(df.filter("vec_id < 0")).count() == 0


def test_large_components_are_exact():
    # 2**60 and 2**60 + 1 are one number in doubles; the greater score has the greater id.
    big = np.array([[2**30, 0], [2**30, 1], [-(2**30), 5]])
    query = np.array([[2**30, 1]])
    points, queries_ = topk.exact(big, query)
    assert points.dtype == np.int64
    floor = np.full(1, topk.nothing(points.dtype))
    best, names = topk.search(points, np.array([1, 2, 3]), queries_, np.array([9]), floor, 2)
    assert names.tolist() == [[2, 1]] and best.tolist() == [[2**60 + 1, 2**60]]
    points, queries_ = topk.exact(big * 2**20, query * 2**20)
    assert points.dtype == object
    best, names = topk.search(points, np.array([1, 2, 3]), queries_, np.array([9]), np.full(1, -np.inf, object), 3)
    assert names.tolist() == [[1, 2, 3]] and best.tolist() == [[2**63 - 1, 2**63 - 1, 1 - 2**63]]  # kept within a long


def test_large_scores_over_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_EACH", 8)
    r = random.Random(3)
    rows = [(i, [float(2**24 + r.randint(0, 3)), float(r.randint(-3, 3))]) for i in range(200)]
    got = topk.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5).collect()
    whole = {i: [64 * int(x) for x in v] for i, v in rows}
    for q in range(0, 200, 20):
        s = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted((x["rank"], x.vec_id, x.score) for x in got if x.query_id == q) == [(n + 1, i, -a) for n, (a, i) in enumerate(s)]


def test_few_dimensions_skip_most_leaves():
    r = np.random.default_rng(5)
    points = np.floor(64 * r.normal(size=(20_000, 3)))
    seen = []
    best, _ = topk.search(points, np.arange(20_000), points[:50], np.arange(50), np.full(50, -np.inf), 20, seen)
    want = np.sort(points[:50] @ points.T - np.where(np.eye(50, 20_000), np.inf, 0), axis=1)[:, ::-1][:, :20]
    assert (best == want).all() and seen[0] < 0.35 * seen[1], seen


def test_few_dimensions_skip_most_regions(spark):
    r = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(6_000, 2)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = topk.whole_vectors(df)
    shares = {}
    n = topk.top_k(whole, whole.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 20, shares).count()
    assert n == 300 * 20 and shares["searched"] < 0.4 * shares["all"], shares


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://www.Example.com:80/a?b#c", big), (2, "https://example.com/x", big), (9, None, big), (4, "ftp", "small"), (5, "http://a.b/1", "small"), (6, "u\r\nv", None), (7, "http://h/" + "p" * 3000, "x\r\n\r\nWARC/1.1\r\n" * 200), (9, "http://h/9", big), (None, "http://n/", "n" * 1200)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(map(str, map(tuple, warc.round_trip(df).collect())))
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = h == big and i != 9
        want.append(str((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None)))
    assert got == sorted(want)
    assert warc.round_trip(df.filter("page_id < 0")).count() == 0
    path = f"file://{tmp_path}"
    warc.write_archives(df, f"{path}/a")
    index = warc.CaptureIndex.build(warc.captures(spark, f"{path}/a"), f"{path}/i", lines=2, parts=2)
    keys = df.select(warc.surt(warc.target_uri(F.col("url"))).alias("key"))
    assert index.find(keys).count() == len(rows) and index.find(keys.limit(0)).count() == 0
    hit = index.lookup("com,example,www)/a?b")
    assert len(hit) == 1 and warc.parse_record(warc.read_range(*hit[0][1:]))[0] == 1
    assert index.lookup("zz)/") == [] and index.lookup("a") == []


def test_find_equals_a_scan(spark, tmp_path, monkeypatch):
    r = random.Random(13)
    rows = [(i, r.choice([None, "", " x ", "http://a.b/" + "p" * r.randint(0, 3), f"http://h{r.randint(0, 30)}.org/{r.randint(0, 9)}"]), "z" * r.randint(0, 9)) for i in range(400)]
    rows += [(1000 + i, "http://hot.org/", "same") for i in range(150)] + [(2000, "http://long.org/", "y" * 2_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}"
    warc.write_archives(df, f"{path}/a")
    index = warc.CaptureIndex.build(warc.captures(spark, f"{path}/a"), f"{path}/i", lines=7, parts=6)
    assert index.files.count() > 3 and index.directory.count() > 20
    keyed = df.select("page_id", warc.surt(warc.target_uri(F.col("url"))).alias("key")).collect()
    for key in ("org,hot)/", "", " x ", "b,a)/pp", "org,h3)/4", "nowhere"):
        got = [warc.parse_record(warc.read_range(*e[1:]))[0] for e in index.lookup(key)]
        assert sorted(got) == sorted(x.page_id for x in keyed if x.key == key), key
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    assert sorted(x.page_id for x in warc.round_trip(df).collect()) == sorted(i for i, _, _ in rows)


def test_surt(spark):
    keys = [r[0] for r in spark.createDataFrame([("HTTP://u@WWW.Ex.org:81/P?q#f",), ("http://ex.org",), ("x",), (None,)], "u string").select(warc.surt(F.col("u"))).collect()]
    assert keys == ["org,ex,www)/P?q", "org,ex)/", "x", ""]


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(700):
        w = [r.choice(["the", "old", "house", "stands", "near", "water", "people", "walk"]) + r.choice(["", "s", "ing"]) for _ in range(r.randint(5, 80))]
        bad = i % 7 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(["horrid", "vilezzy"]) + r.choice(["", "ly", "ness", "est"]))
        rows.append((i, " ".join(w), "src"))
        labels.append((i, int(bad)))
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "wort " * 30_000, "c"), (None, "the house", "d"), (3, rows[3][1], "src")]
    labels += [(1000, None), (None, 1), (2000, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, toxic):
    import zlib

    docs, labels = toxic
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 700]
    assert sum(r.predicted == (r.doc_id % 7 == 0) for r in held) / len(held) > 0.97
    kept = {r.doc_id for r in toxicity.clean(docs, labels).collect()}
    assert sum(i % 7 == 0 for i in kept if i is not None and i < 700) < 10 and {None, 1000, 1001, 1002} <= kept
    assert toxicity.score(docs, labels.filter("false")).agg(F.max("score")).first()[0] < 0.5
    assert toxicity.score(docs.filter("false"), labels).count() == 0


def test_both_lookups_agree(spark, toxic):
    docs, labels = toxic
    grams = toxicity.table(toxicity.count_words(toxicity.with_label(docs, labels)))
    a, b = (sorted((str(r.doc_id), r.n_words, round(r.ratio, 4)) for r in toxicity.with_figures(docs.select("doc_id", "text"), grams, shared=shared).collect()) for shared in (toxicity.shared_table(grams), None))
    assert a == b


def test_far_sides_agree(spark, toxic, monkeypatch):
    docs, labels = toxic
    near = sorted((str(r.doc_id), r.predicted) for r in toxicity.score(docs, labels).collect())
    kept = sorted(str(r.doc_id) for r in toxicity.clean(docs, labels).collect())
    monkeypatch.setattr(toxicity, "MOST_BROADCAST", 0)
    monkeypatch.setattr(toxicity, "MOST_LABELS", 0)
    assert near == sorted((str(r.doc_id), r.predicted) for r in toxicity.score(docs, labels).collect())
    assert kept == sorted(str(r.doc_id) for r in toxicity.clean(docs, labels).collect())


def kneser_ney(labelled):
    """labelled (word, t, o): the log-likelihood difference of any word, straight from the definitions."""
    n = toxicity.ORDER
    padded = {}
    for w, t, o in labelled:
        w = "\x02" * (n - 1) + "".join("0" if c.isdigit() else c for c in w) + "\x03"
        padded[w] = [x + y for x, y in zip(padded.get(w, [0, 0]), (t, o))]

    def discount(counts):
        n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
        y = n1 / max(1, n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / max(1, n1), 2 - 3 * y * n3 / max(1, n2), 3 - 4 * y * n4 / max(1, n3)]
        d = [min(i, max(low, x)) for i, low, x in zip((1, 2, 3), (0.5, 0.8, 1), raw)]
        return lambda c: 0 if c <= 0 else d[min(c, 3) - 1]

    tops = [{}, {}]
    for w, counts in padded.items():
        for i in range(n, len(w) + 1):
            for top, c in zip(tops, counts):
                top[w[i - n : i]] = top.get(w[i - n : i], 0) + c
    types, orders = set(tops[0]), {}
    for m in range(n - 1, 0, -1):
        orders[m] = {}
        for g in types:
            orders[m][g[1:]] = orders[m].get(g[1:], 0) + 1
        types = set(orders[m])
    offs = {m: discount(list(c.values())) for m, c in orders.items()}

    def below(g):
        if not g:
            return 1 / (len(orders[1]) + 1)
        counts, off = orders[len(g)], offs[len(g)]
        follow = {x: c for x, c in counts.items() if x[:-1] == g[:-1]}
        total = sum(follow.values())
        return (counts[g] - off(counts[g])) / total + sum(map(off, follow.values())) / total * below(g[1:])

    def value(g):
        out = []
        for top in tops:
            off = discount(list(top.values()))
            follow = [c for x, c in top.items() if x[:-1] == g[:-1]]
            total = sum(follow)
            back = sum(map(off, follow)) / total if total else 1.0
            out.append(((top.get(g, 0) - off(top.get(g, 0))) / total if total else 0.0, back))
        if not any(top.get(g, 0) for top in tops):
            return 0.0
        p = below(g[1:])
        return np.log((out[0][0] + out[0][1] * p) / (out[1][0] + out[1][1] * p))

    def word(w):
        w = "\x02" * (n - 1) + "".join("0" if c.isdigit() else c for c in w) + "\x03"
        each = [value(w[i - n : i]) for i in range(n, len(w) + 1)]
        return sum(each) * min(1.0, toxicity.LONG / len(each))

    return word


def test_models_equal_brute_force(spark):
    r = random.Random(14)
    parts = ["an", "er", "in", "th", "on", "ö", "7", "日"]
    counted = [("".join(r.choice(parts) for _ in range(r.randint(1, 6))), r.choice([0, 0, 1, 2, 5]), r.choice([0, 1, 1, 3, 9])) for _ in range(150)]
    counted += [("thinnerinneranerintheronan", 1, 0), ("a", 0, 2)]
    counts = spark.createDataFrame(counted, "word string, t long, o long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    grams = toxicity.table(counts)
    known, sought = kneser_ney(counted), sorted({w for w, _, _ in counted} | {"unseen", "thin", "zzz", "9an9", "k" * 40})
    got = toxicity.ratios(sought, toxicity.Lookup.of(grams))
    joined = {x.word: x.x for x in toxicity.word_ratios(spark.createDataFrame([(w,) for w in sought], "word string"), grams).collect()}
    for w, x in zip(sought, got):
        assert abs(x - known(w)) < 1e-4 and abs(joined[w] - known(w)) < 1e-4, (w, x, joined[w], known(w))


def test_near_classes(spark):
    r = random.Random(12)
    base = [[f"t{r.randint(0, 20000)}" for _ in range(r.randint(80, 400))] for _ in range(40)]
    rows, truth = [], {}
    for g, w in enumerate(base):
        for c in range(4):
            v = list(w)
            if c:
                v[r.randrange(len(v))] = f"edit{c}"
            rows.append((len(rows), " ".join(v), 1))
            truth[rows[-1][0]] = g
    rows += [(500, None, 1), (501, "", 1), (501, "", 1), (600, "lone words stay here", 1), (None, "no id", 1), (3, rows[3][1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig int")
    kept = [x.doc_id for x in simhash.without_copies(df).collect()]
    groups = [truth[i] for i in kept if i in truth]
    assert sorted(groups) == list(range(40)) and kept.count(600) == 1 and kept.count(None) == 1
    assert kept.count(500) + kept.count(501) == 1
    assert simhash.without_copies(df.filter("doc_id < 0")).count() == 0


def test_links_have_the_similarity(spark):
    r = random.Random(4)
    rows, sets = [], []
    for _ in range(25):
        w = [f"t{r.randint(0, 20000)}" for _ in range(r.randint(30, 300))]
        for _ in range(5):
            v = list(w)
            for _ in range(r.randint(0, 1 + len(w) // 25)):
                v[r.randrange(len(v))] = f"e{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(v)))
            sets.append({tuple(v[i : i + 5]) for i in range(len(v) - 4)})
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {x.id: x.class_id for x in simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_registered_names(spark):
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in queries.QUERIES


@pytest.mark.parametrize("name", ["op6_topk", "op7_warc"])
def test_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(cols).collect()))) == sorted(map(str, c.execute(f"select {', '.join(cols)} from ({queries.SQL[name]})").fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = corpus_pipeline.run(spark, DIR).collect()
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in docs.select("doc_id").collect()}
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in used.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 4096
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0
