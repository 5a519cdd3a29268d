"""Secret scans: candidates by patterns, false positives removed by a random forest.

One ordered expression finds candidates: keys with a known prefix, private key blocks, values assigned to a telling name, and long
strings that mix digits in. The forest sees each candidate's length, its character classes and their transitions, its
distinct characters, the share that dictionary words cover, whether it looks like a path, and its neighbouring words. It is
trained on labelled findings: TRAINING lines made from a seed, each a template whose value is known to be a secret
or not, scanned like any text.

The dictionary is the whole words of a public tokenizer's vocabulary, read from its file.

Only DataFrame functions and JVM learners are used. Null and empty texts have no candidates. No length is bounded: texts are scanned
whole, and a value of any length is found, scored and blanked whole. Findings are counted from 0 in code points; of patterns that
match at one place the first kind wins, and found places never overlap. Repeated rows are each scanned by themselves, with equal
results; an empty table gives no rows. Only the id and the text are read; redact gives all other columns back, whatever their names.
"""

from __future__ import annotations

import random
import re
import uuid
from functools import lru_cache

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshq.llm.common import all_columns, drop, fresh, materialize
from meshq.llm.tokens import vocabulary_path

TRAINING, SEED, TREES, DEPTH, AROUND = 4000, 11, 24, 7, 48

# A private key: through its END line or, if five other dashes or none follow, through headers and base64 to the last line of nothing else.
PRIVATE_KEY = (
    r"-----BEGIN (?:(?!PRIVATE KEY)[A-Z0-9]++ )*+PRIVATE KEY(?: BLOCK)?-----(?:(?s:(?!-----).)*+-----END [A-Z0-9 ]*+-----"
    r"|(?:\s*+(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):[^\r\n]*+)*+"
    r"(?:(?:\s|\\[nrt]|[\"'+,>#*|])*+[A-Za-z0-9+/]{16,}+={0,2}+)*+"
    r"(?:(?:\r?\n|(?:\\r)?\\n)[\x20\t>#*|]*+[A-Za-z0-9+/]++={0,2}+(?=[\x20\t\"',]*+(?:[\r\n]|\\[nr]|\z)))*+)"
)
# Candidate kinds in order of precedence: name, expression. A group "v" isn't used: what is quoted or assigned is cut off later.
KINDS = [
    ("private-key", PRIVATE_KEY),
    ("cloud-key", r"\b(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{12,}+\b"),
    ("service-token", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{16,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{16,})"),
    ("signed-token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("assignment", r"(?i:(?<![a-z0-9_.-])[a-z0-9_.-]*?(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|auth[_-]?key|credential)[a-z0-9_-]*+[\"']?[\x20\t]{0,3}(?::=|=>|[:=])[\x20\t]{0,3})[\"']?+(?![=>]?-----BEGIN )[^\s\"',;]{6,}+"),
    ("connection", r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]++://[^\s:/@\"']++:[^\s:/@\"']{4,}+@"),
    ("mixed", r"(?<![A-Za-z0-9+/_=.@-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+(?![A-Za-z0-9+/_=.@-])"),
]
ANY = "|".join(f"(?:{x})" for _, x in KINDS)
#: What a text must hold, besides a long mixed string, to have a candidate.
MARKS = ["BEGIN", "AKIA", "ASIA", "AROA", "AIDA", "_", "-", ":", "=", "eyJ", "AIza"]
TELLING = "password passwd pwd token secret key credential auth login apikey private access passphrase bearer"
HARMLESS = "example sample test dummy checksum sha1 sha256 md5 commit uuid guid hash digest revision build version id isbn order invoice etag serial card figure"
#: Words of stand-ins, as no list of words has them.
STAND_INS = "passwd changeme placeholder todo redacted dummy xxxx asdf qwerty foobar yourtoken notsecret".split()
FEATURES = ["length", "digits", "upper", "lower", "other", "distinct", "changes", "covered", "stand_in", "path", "before", "before_harmless", "after", "hex", "repeated", "prefixed", "assigned"]


@lru_cache(maxsize=4)
def dictionary(path: str | None = None, least: int = 3) -> tuple[str, ...]:
    """The words, of plain letters and that many at least, that a public tokenizer's vocabulary holds whole; their number is the file's."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        body = f.read()
    # Sought in the text, for the driver needs none of the rest.
    end = re.search(r'"end_of_word_suffix"\s*:\s*"([^"]+)"', body)[1]
    return tuple(sorted(set(re.findall(rf'"([a-z]{{{least},}}){re.escape(end)}"\s*:\s*\d', body))))


def with_covered(df: DataFrame, value: str, out: str, path: str | None = None) -> DataFrame:
    """Adds out: the share of a column's letters and digits that words of the dictionary cover, in runs of letters that are cut where a
    small letter meets a capital. Each distinct value is looked up once; the dictionary, as large as its file, is broadcast."""
    known = df.sparkSession.createDataFrame([(w,) for w in dictionary(path)], "word string")
    runs = F.split(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z]+")
    each = df.select(value).distinct().select(value, F.explode(F.transform(runs, F.lower)).alias("word"))
    found = each.join(F.broadcast(known), "word").groupBy(value).agg(F.sum(F.length("word")).alias(out))
    total = F.greatest(F.length(F.regexp_replace(value, "[^A-Za-z0-9]", "")), F.lit(1))
    return df.join(found, value, "left").withColumn(out, F.coalesce(out, F.lit(0)) / total)


def spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: array of (start, length, found, before, after) of the candidates in order."""
    kind = "array<struct<start:int,length:int,found:string,before:string,after:string>>"
    t = F.col(text)
    df = df.withColumn("_found", F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(ANY), F.lit(0)))
    df = df.withColumn("_rest", F.when(F.size("_found") > 0, F.split(t, ANY, -1)))

    def step(a: Column, i: Column) -> Column:
        start = a["at"] + F.length(F.get("_rest", i))
        found = F.get("_found", i)
        stop = start + F.length(found)
        before = F.substring(t, F.greatest(F.lit(1), start - (AROUND - 1)), F.least(start, F.lit(AROUND)))
        one = F.struct(start.alias("start"), F.length(found).alias("length"), found.alias("found"), before.alias("before"), F.substring(t, stop + 1, F.lit(AROUND)).alias("after"))
        return F.struct(stop.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    got = F.when(F.size("_found") > 0, F.aggregate(F.sequence(F.lit(0), F.size("_found") - 1), begin, step)["out"]).otherwise(F.array().cast(kind))
    return df.withColumn(out, got).drop("_found", "_rest")


def findings(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, kind, start, length (of the value alone), value, before, after: a row for each candidate."""
    d = spans(df, text, "_spans").select(*keys, F.explode("_spans").alias("s")).select(*keys, "s.*")
    kind = F.lit("mixed")
    for name, x in reversed(KINDS[:-1]):
        kind = F.when(F.col("found").rlike(f"^(?:{x})$"), name).otherwise(kind)
    d = d.withColumn("kind", kind)
    lead = F.when(F.col("kind") == "assignment", F.regexp_extract("found", r"^[^:=]*(?::=|=>|[:=])[\x20\t]{0,3}[\"']?", 0)).when(F.col("kind") == "connection", F.regexp_extract("found", r"^[^:]*://[^:]*:", 0)).otherwise(F.lit(""))
    d = d.withColumn("_lead", lead)
    tail = F.when(F.col("kind") == "connection", 1).otherwise(0)
    n = F.col("length") - F.length("_lead") - tail
    return d.select(*keys, "kind", (F.col("start") + F.length("_lead")).alias("start"), n.alias("length"), F.substring("found", F.length("_lead") + 1, n).alias("value"), F.concat("before", "_lead").alias("before"), "after")


def with_features(d: DataFrame) -> DataFrame:
    d = with_covered(d, "value", "f_covered")
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    share = lambda cls: (n - F.length(F.regexp_replace(v, cls, ""))) / n
    coded = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[^A-Za-z0-9]", "~"), "[0-9]", "0"), "[A-Z]", "1"), "[a-z]", "a")
    runs = F.length(F.regexp_replace(coded, r"(.)\1+", "$1"))
    has = lambda col, words: F.lower(F.col(col)).rlike("(?:" + "|".join(words.split()) + ")").cast("double")
    stand_in = F.lower(v).rlike("(?:" + "|".join(STAND_INS) + "|example|sample|your|insert|replace|getenv|environ)").cast("double")
    path = (F.size(F.split(v, r"[/\\.]")) - 1) / n + F.endswith(F.col("before"), F.lit("/")).cast("double")
    return d.withColumns({
        "f_length": F.log2(n), "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_lower": share("[a-z]"), "f_other": share("[^A-Za-z0-9]"),
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(40)), "f_changes": (runs - 1) / n, "f_stand_in": stand_in, "f_path": path,
        "f_before": has("before", TELLING), "f_before_harmless": has("before", HARMLESS), "f_after": has("after", HARMLESS), "f_hex": F.lower(v).rlike("^[0-9a-f]+$").cast("double"),
        "f_repeated": (n - F.length(F.regexp_replace(v, r"(.)\1+", "$1"))) / n, "f_prefixed": F.col("kind").isin("private-key", "cloud-key", "service-token", "signed-token").cast("double"), "f_assigned": F.col("kind").isin("assignment", "connection").cast("double"),
    })


@lru_cache(maxsize=1)
def training_lines(n: int = TRAINING, seed: int = SEED) -> list[tuple[int, str, int]]:
    """id, line, and whether its value is a secret (1) or not (0); half each."""
    r = random.Random(seed)
    plain = [w for w in dictionary() if 4 <= len(w) <= 9]
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllables = ["an", "er", "in", "th", "on", "ed", "re", "ou", "st", "en", "la", "de", "que", "ion", "ver", "ge", "do", "ci"]
    filler = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(2, 6)))
    name = lambda: r.choice(["password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "apikey", "access_key", "auth_key", "db_password", "client_secret", "PASSWORD", "Token"])
    join = lambda: r.choice(["=", " = ", ": ", ":", "=>"])
    quote = lambda v: r.choice(["{}", '"{}"', "'{}'"]).format(v)
    secrets = [
        lambda: r.choice(["AKIA", "ASIA"]) + pick(up + dig, 16),
        lambda: f"{name()}{join()}{quote(pick('abcdef' + dig, r.choice([16, 18, 20, 24, 32, 40, 64])))}",
        lambda: f"{name()}{join()}{quote(pick(low + up + dig, r.randint(12, 48)))}",
        lambda: f"{name()}{join()}{quote(pick(low + up + dig + '!#$%&*+-_', r.randint(10, 24)))}",
        lambda: "gh" + r.choice("pos") + "_" + pick(low + up + dig, 36),
        lambda: f"xoxb-{pick(dig, 11)}-{pick(low + up + dig, 24)}",
        lambda: r.choice(["sk-", "sk_live_"]) + pick(low + up + dig, r.randint(24, 48)),
        lambda: "AIza" + pick(low + up + dig, 35),
        lambda: f"eyJ{pick(low + up + dig, 20)}.eyJ{pick(low + up + dig, 40)}.{pick(low + up + dig + '-_', 43)}",
        lambda: f"-----BEGIN {r.choice(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----",
        lambda: f"{r.choice(['postgres', 'mysql', 'https', 'amqp'])}://{pick(low, 6)}:{pick(low + up + dig, r.randint(10, 20))}@{pick(low, 8)}.example.net/x",
        lambda: f"{r.choice(['bearer', 'token', 'secret', 'private key'])} {pick(low + up + dig, r.randint(32, 64))}",
    ]
    word = lambda: r.choice(plain)
    harmless = [
        lambda: f"{r.choice(['sha256', 'md5', 'checksum', 'digest', 'commit', 'etag', 'hash', 'revision'])}{r.choice([' ', ': ', '='])}{pick('abcdef' + dig, r.choice([32, 40, 64]))}",
        lambda: f"{r.choice(['uuid', 'id', 'guid'])} {uuid.UUID(int=r.getrandbits(128))}",
        lambda: f"{name()}{join()}{quote(r.choice(['changeme', 'your_token_here', 'example123', 'xxxxxxxxxxxx', '************', '<password>', '${PASSWORD}', '{{ secret }}', 'REDACTED', 'placeholder', 'test1234', 'dummy-value', '00000000', 'none-none', 'os.environ', 'getenv(x)', 'input()x']))}",
        lambda: f"{name()}{join()}{word()}{r.choice(['', '_', '-', '.'])}{word()}{r.choice(['', '1', '12', '_here'])}",
        lambda: f"{name()}{join()}{filler().replace(' ', '')[:24] + 'ing'}",
        lambda: "AKIA" + pick(up[:4], 6) + "EXAMPLE" + pick(up[:2], 3),
        lambda: f"/{word()}/{word()}{r.randint(1, 99)}/{word()}_{word()}/{word()}{r.choice(['', '2', '03'])}",
        lambda: f"{word()}_{word()}_{word()}_{r.randint(1, 9999)}",
        lambda: f"{word().title()}{word().title()}{word().title()}{word().title()}{r.randint(1, 99)}",
        lambda: pick(dig, r.randint(20, 30)),
        lambda: f"{r.randint(2000, 2024)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{word()}-{word()}-{word()}",
        lambda: f"build {word()}-{r.randint(1, 9)}-{r.randint(10, 99)}-{word()}-{pick(dig, 8)}",
        lambda: "=" * r.randint(10, 30) + str(r.randint(0, 9)) + "-" * r.randint(10, 30),
        lambda: f"https://{word()}:{word()}@example.com/{word()}",
        lambda: "0" * r.randint(8, 20) + "1" * r.randint(8, 20) + "0" * 4,
    ]
    lines = [(i, f"{filler()} {r.choice(secrets if i % 2 else harmless)()} {filler()}", i % 2) for i in range(n)]
    # Values of more than 200 characters, and whole private keys.
    block = lambda sep: sep.join(["MII" + pick(low + up + dig + "+/", 61) for _ in range(r.randint(1, 26))] + [pick(low + up + dig + "+/", r.randint(4, 60)) + r.choice(["", "=", "=="])])
    pem = lambda kind, sep: f"-----BEGIN {kind}PRIVATE KEY-----{sep}{block(sep)}{sep}" + r.choice(["", f"-----END {kind}PRIVATE KEY-----"])
    secrets = [
        lambda: f"{name()}{join()}{quote(pick(low + up + dig + '+/', r.randint(201, 2000)))}",
        lambda: f"{r.choice(['bearer', 'token', 'secret', 'private key'])} {pick(low + up + dig + '+/', r.randint(201, 2000))}",
        lambda: f"{r.choice(['postgres', 'mysql', 'https', 'amqp'])}://{pick(low, r.randint(6, 80))}:{pick(low + up + dig, r.randint(101, 1000))}@{pick(low, 8)}.example.net/x",
        lambda: pem(r.choice(["RSA ", "EC ", "OPENSSH ", "ENCRYPTED ", ""]), r.choice(["\n", "\r\n", "\\n"])),
    ]
    harmless = [lambda: f"data:image/png;base64,{pick(low + up + dig + '+/', r.randint(201, 2000))}", lambda: f"{r.choice(['checksum', 'digest', 'etag'])} {pick('abcdef' + dig, r.choice([256, 512]))}", lambda: pick("0=-", r.randint(201, 600))]
    return lines + [(n + i, f"{filler()} {r.choice(secrets if i % 2 else harmless)()} {filler()}", i % 2) for i in range(n // 10)]


def train(spark: SparkSession) -> RandomForestClassificationModel:
    lines = spark.createDataFrame(training_lines(), "id long, text string, label int").coalesce(4)
    found = materialize(findings(lines, ["id", "label"]), "secret-lines")
    # Sorted, so that the forest draws the same rows whatever the order of the joins.
    f = materialize(with_features(found).coalesce(1).sortWithinPartitions("id", "start"), "secret-features")
    vectors = VectorAssembler(inputCols=[f"f_{x}" for x in FEATURES], outputCol="features").transform(f)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label").fit(vectors.select("label", "features"))
    drop(found, f)
    return model


def scan(df: DataFrame, keys: list[str], text: str = "text", model: RandomForestClassificationModel | None = None) -> DataFrame:
    """keys, kind, start, length, value, score, predicted of every candidate. Candidates are written first, so that texts are scanned
    once."""
    model = model or train(df.sparkSession)
    f = with_features(materialize(findings(df, keys, text), "secret-candidates"))
    v = VectorAssembler(inputCols=[f"f_{x}" for x in FEATURES], outputCol="features").transform(f)
    got = model.transform(v).withColumn("score", vector_to_array("probability")[1])
    return got.select(*keys, "kind", "start", "length", "value", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def redact(documents: DataFrame, mark_text: str = "[secret]") -> DataFrame:
    """documents with every predicted secret's value replaced, in the columns of the input; n_chars follows, if there is one."""
    mark, one, other, cuts = fresh(documents, "text_hash", "found_id", "found_hash", "cuts")
    d = documents.withColumn(mark, F.xxhash64("text"))
    hit = scan(d.select("doc_id", "text", F.col(mark).alias("hash")), ["doc_id", "hash"]).filter("predicted = 1")
    by_doc = hit.groupBy(F.col("doc_id").alias(one), F.col("hash").alias(other)).agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias(cuts))
    j = d.join(by_doc, F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(mark) == F.col(other)), "left")
    t, found = F.col("text"), F.col(cuts)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, c: F.struct((c["start"] + c["length"]).alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, c["start"] - a["at"]), F.lit(mark_text)).alias("out"))
    cut = F.aggregate(found, start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    out = j.withColumn("text", F.when(found.isNotNull(), cut).otherwise(t))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(found.isNotNull(), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*all_columns(documents))
