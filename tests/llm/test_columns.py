import random

import pytest

import corpus_pipeline
from meshq.llm import mixing, secrets, simhash, toxicity

#: Names that the operators use for columns of their own, and others that are awkward.
NAMES = ["_hash", "_id", "_size", "_n2", "_cuts", "_h", "_part", "_s", "_n", "hash", "id", "text_hash", "kept_id", "kept_hash", "found_id", "found_hash", "cuts", "rejected_id", "rejected_hash", "share_id", "share_hash", "share_size", "share_n", "taken", "size", "n", "fp", "node", "key", "root", "words", "ratio", "score", "predicted", "toxic", "target", "weight", "start", "length", "value", "kind", "before", "after", "a.b", "with `tick`", "Hash "]


@pytest.fixture(scope="module")
def clashing(spark):
    r = random.Random(9)
    texts = [" ".join(f"w{r.randint(0, 3000)}" for _ in range(r.choice([3, 40, 200]))) for _ in range(40)]
    texts += [None, "", texts[3], texts[4] + " more", "long " * 20_000, 'token = "' + "a1B2" * 100 + '" end', texts[5], texts[5]]
    rows = [(i if i != 20 else None, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), *(f"{c}{i}" for c in NAMES)) for i, t in enumerate(texts)]
    rows.append(rows[8])  # a repeated row
    names = ", ".join("`" + c.replace("`", "``") + "` string" for c in NAMES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")


def whole(df):
    return sorted(map(str, map(tuple, df.collect())))


def others(df):
    """The rows without their text and its length."""
    cols = [i for i, c in enumerate(df.columns) if c not in ("text", "n_chars")]
    return {str([r[i] for i in cols]) for r in df.collect()}


@pytest.fixture(scope="module")
def labels(spark, clashing):
    return spark.createDataFrame([(i, int(i % 5 == 0), i) for i in range(48)], "doc_id long, toxic int, _hash int")


def test_clean(clashing, labels):
    got = toxicity.clean(clashing, labels.filter("false"))
    assert got.columns == clashing.columns and whole(got) == whole(clashing)
    assert set(whole(toxicity.clean(clashing, labels))) <= set(whole(clashing))


def test_without_copies(clashing):
    got = simhash.without_copies(clashing)
    rows = whole(got)
    assert got.columns == clashing.columns and set(rows) <= set(whole(clashing)) and len(rows) == len(set(rows))
    assert len(rows) == clashing.count() - 6  # null and empty, a copy, a near copy, two more copies, the repeated row


def test_redact(clashing):
    got = secrets.redact(clashing)
    assert got.columns == clashing.columns and others(got) == others(clashing) and got.count() == clashing.count()
    assert sum("[secret]" in (r.text or "") for r in got.collect()) == 1


def test_mixed(clashing):
    got = mixing.mixed_documents(clashing)
    assert got.columns == clashing.columns and others(got) <= others(clashing)


def test_pipeline(spark, clashing, labels, tmp_path):
    folder = f"file://{tmp_path}"
    clashing.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == clashing.columns and others(docs) <= others(clashing)
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = clashing.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
