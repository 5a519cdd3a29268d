import random

from meshq.llm import components, simhash


def classes_of(spark, rows):
    got = simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {x.id: x.class_id for x in got}


def test_case_copies_outside_ascii(spark):
    r = random.Random(21)
    letters = "абвгдежзиклмнопрстуфхцчшщыэюя"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(200)) for _ in range(30)]
    got = classes_of(spark, [(i, t) for i, t in enumerate(texts)] + [(100 + i, t.upper()) for i, t in enumerate(texts)])
    assert sum(got[100 + i] == i for i in range(30)) == 30


def contiguous(r, w):
    """Copies of w whose shingles have a Jaccard similarity of 0.8 or more: a cut tail, a cut head, an appended and a replaced passage."""
    n = len(w)
    new = [f"new{r.randint(0, 10**9)}" for _ in range(n)]
    at, k = n // 3, (n - 4) // 9 - 4
    return [w[: n - (n - 4) // 5], w[(n - 4) // 5 :], w + new[: (n - 4) // 4], w[:at] + new[:k] + w[at + k :]]


def test_contiguous_edits_are_found(spark):
    r = random.Random(22)
    base = [[f"t{r.randint(0, 20000)}" for _ in range(r.randint(80, 300))] for _ in range(15)]
    rows, truth = [], {}
    for w in base:
        for v in contiguous(r, w):
            a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v))
            assert len(a & b) >= 0.8 * len(a | b)
            salt = f"s{r.randint(0, 10**9)}"  # each pair by itself, so that no link is found by way of another copy
            truth[len(rows) + 1] = len(rows)
            rows += [(len(rows), " ".join(x + salt for x in w)), (len(rows) + 1, " ".join(x + salt for x in v))]
    got = classes_of(spark, rows)
    assert sum(got[b] == a for b, a in truth.items()) == len(truth)


def test_rows_that_share_an_id(spark):
    r = random.Random(23)
    texts = [" ".join(f"t{r.randint(0, 20000)}" for _ in range(100)) for _ in range(4)]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (8, texts[0] + " more"), (9, texts[1] + " more"), (9, texts[2]), (9, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(x.doc_id, x.text) for x in simhash.without_copies(df).collect()]
    assert sorted(kept) == sorted([(7, texts[0]), (7, texts[1]), (9, texts[2]), (9, texts[3])])


def brute_classes(rows):
    """The least id that links of Jaccard similarity 0.8 reach, over all pairs."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    links = 0
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}, links


def mixed_corpus(seed=24):
    """Copies with scattered and contiguous edits at all similarities, chains of them, passages that many texts share, short texts,
    and texts of many more shingles than a plain sketch is for."""
    r = random.Random(seed)
    word = lambda: f"t{r.randint(0, 9000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        w = [word() for _ in range(r.choice([6, 12, 40, 150, 400]))]
        for _ in range(5):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(r.randint(1, 1 + len(w) // 30)):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.4:
                w = w[: len(w) - len(w) // r.choice([6, 9, 15])]
    texts += [" ".join(passage + [word() for _ in range(r.choice([5, 12, 30, 200]))]) for _ in range(25)]
    texts += [" ".join([word() for _ in range(r.choice([1, 2, 4, 5, 6]))]) for _ in range(10)] + ["one two", "one two", "One  two", "a b c d e f", "a b c d e g"]
    long = [word() for _ in range(4000)]
    for n in (0, 5, 60, 90, 130):
        v = list(long)
        for at in r.sample(range(len(v)), n):
            v[at] = word()
        texts.append(" ".join(v))
    texts += [" ".join(long + [word() for _ in range(900)]), " ".join(long[:3300])]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_classes_equal_brute_force(spark):
    rows = mixed_corpus()
    want, links = brute_classes(rows)
    assert links > 30 and classes_of(spark, rows) == want


def test_far_sides_agree(spark, monkeypatch):
    rows = mixed_corpus(25)
    want, _ = brute_classes(rows)
    for name in ("MOST_BROADCAST", "MOST_KEYS", "PAIRS_EACH"):
        monkeypatch.setattr(simhash, name, 0)
    monkeypatch.setattr(simhash, "COMMON", 0)
    assert classes_of(spark, rows) == want


def test_recall_of_pairs_on_documents(spark):
    """Every pair that is similar enough, found by an inverted index over all shingles, is in one class."""
    docs = [(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want, links = brute_classes([(i, t or "") for i, t in docs])
    assert links and classes_of(spark, docs) == want


def test_large_groups_are_linked_before_pairs(spark, monkeypatch):
    """Copies of one text that share an end with more texts of other words: the group is one class before all pairs are compared, though a
    node drawn from a common key seldom belongs to it."""
    r = random.Random(26)
    word = lambda: f"t{r.randint(0, 10**6)}"
    end, base = [word() for _ in range(40)], [word() for _ in range(110)]
    rows = [(0, " ".join(base + end))]
    for i in range(1, 151):
        at = r.randrange(90)
        rows.append((i, " ".join(base[:at] + [word() for _ in range(9)] + base[at + 9 :] + end)))
    rows += [(1000 + i, " ".join([word() for _ in range(110)] + end)) for i in range(400)]
    compared, exact = [], simhash.exact_pairs

    def counted(*args):
        compared.append(exact(*args).count())
        return exact(*args)

    monkeypatch.setattr(simhash, "exact_pairs", counted)
    want, links = brute_classes(rows)
    assert links > 1000 and classes_of(spark, rows) == want
    assert sum(compared) < 150


def test_few_links_take_no_rounds(spark, monkeypatch):
    """A chain of copies: linked by the driver, and with equal classes by stars."""
    r = random.Random(31)
    w = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(12):
        w = w if not i else w[8:] + [f"new{r.randint(0, 10**9)}" for _ in range(8)]
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"x{r.randint(0, 10**9)}" for _ in range(50))) for i in range(5)]
    rounds, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda edges, large: rounds.append(large) or star(edges, large))
    got = classes_of(spark, rows)
    assert not rounds and got == {i: 0 if i < 12 else i for i, _ in rows}
    monkeypatch.setattr(simhash, "MOST_LINKS", 0)
    assert classes_of(spark, rows) == got and rounds


def test_linked_by_the_driver(spark):
    r = random.Random(32)
    edges = [(r.randint(-400, 400), r.randint(-400, 400)) for _ in range(300)] + [(2**62, -(2**62)), (5, 5)]
    d = spark.createDataFrame([*edges, (None, 7)], "a long, b long")
    stars, here = ({(x.node, x.root) for x in components.components(d, most_here=most).collect()} for most in (0, 1000))
    assert here == stars and len(here) > 300
    assert components.components(d.filter("a = b"), most_here=1000).count() == 0
