import random

import pytest

from meshq.llm import secrets

R = random.Random(31)
ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def run_of(n, more=""):
    return "a1" + "".join(R.choice(ALNUM + more) for _ in range(n - 2))


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(spark)


def redacted(spark, texts, model, monkeypatch):
    monkeypatch.setattr(secrets, "train", lambda _: model)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in secrets.redact(df).orderBy("doc_id").collect()]


def test_long_values(spark, model, monkeypatch):
    for n in (201, 300, 5000):
        v = [run_of(n, "+/"), run_of(n), run_of(n), run_of(n)]
        texts = [f"private key {v[0]} end", f'token = "{v[1]}" end', f"password: {v[2]}", f"see postgres://{'u' * 80}:{v[3]}@host.example.net/x"]
        out = redacted(spark, texts, model, monkeypatch)
        assert out == ["private key [secret] end", 'token = "[secret]" end', "password: [secret]", f"see postgres://{'u' * 80}:[secret]@host.example.net/x"], n


def test_private_keys(spark, model, monkeypatch):
    lines = ["MII" + run_of(61, "+/") for _ in range(12)] + [run_of(9)]
    for kind in ("RSA ", "", "OPENSSH ", "ENCRYPTED "):
        begin, end = f"-----BEGIN {kind}PRIVATE KEY-----", f"-----END {kind}PRIVATE KEY-----"
        enc = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n"
        bodies = ["\n".join(lines), "\r\n".join(lines), "\\n".join(lines), "".join(lines), enc + "\n".join(lines), "\n".join(lines) + "=="]
        texts = [f"before it\n{begin}\n{b}\n{end}\nafter all, words" for b in bodies]
        texts += [f"before it\n{begin}\n{b}" for b in bodies] + [f"before it\n{begin}\n{b}\n\nafter all, words" for b in bodies] + [f'SECRET_KEY="{begin}\n{bodies[0]}\n{end}" after all, words']
        out = redacted(spark, texts, model, monkeypatch)
        for t, o in zip(texts, out, strict=True):
            assert not any(x in o for x in lines) and "[secret]" in o and ("after all, words" in o) == ("after all, words" in t), (t, o)


def test_long_names(spark, model, monkeypatch):
    texts = ['my_db_password: "s3cr3t!pa$$9" x', 'MY_APP_SECRET_KEY="x7!kQ9$mZ2rr"', "spring.datasource.password=x7!kQ9$mZ2rr", "--auth-token-value x7, db_password_prod => x7!kQ9$mZ2rr"]
    got = secrets.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    want = {0: "s3cr3t!pa$$9", 1: "x7!kQ9$mZ2rr", 2: "x7!kQ9$mZ2rr", 3: "x7!kQ9$mZ2rr"}
    assert {r.doc_id: (r.kind, r.value) for r in got} == {i: ("assignment", v) for i, v in want.items()}
    out = redacted(spark, texts, model, monkeypatch)
    assert [o for o in out if "x7!kQ9" in o or "s3cr3t" in o] == []
