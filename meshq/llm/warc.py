"""WARC archives with a two-level capture index.

Archives: a text writer puts one record per row, so that any store Spark writes to will do and a lost task leaves nothing
behind; payloads repeated from 1000 bytes on become revisit records. Index: captures sorted by their reversed-host key in
compressed blocks, a line each, and a sparse directory with each block's first key and place. A lookup takes its keys to the index
files whose ranges hold them; there it searches the file's directory by halves, reads the blocks by range, searches them by halves,
and then reads the records by range. No machine holds the directory of more than one file.

Null html counts as empty; null or unusual URLs have the key they have as text, and any number of captures may share one; records of
null ids keep a null id. Of repeated rows that hold the largest id of a payload, all are responses. Payloads of any length are written
and read whole. An empty table gives an archive and an index without records. Columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshq.llm.common import materialize, new_path

LEAST_REVISIT = 1000
#: Repeated payloads up to this number (about 100 bytes each) are broadcast, so that payloads aren't shuffled; beyond, joined by hash.
MOST_BROADCAST = 100_000
#: Captures of an index file, index files at least and at most, and bytes of records that a task reads.
FILE_CAPTURES, LEAST_FILES, MOST_FILES, TASK_BYTES = 300_000, 16, 20_000, 64 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ID = "urn:meshq:page:"


@contextmanager
def opened(uri: str):
    """A readable, seekable file of the local system or of any that pyarrow knows."""
    if re.match(r"file:|/", uri):
        with open(re.sub(r"^file:/*", "/", uri), "rb") as f:
            yield f
    else:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            yield f


def files(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """Data files of a folder, by Spark's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-") and s.getPath().getName().endswith(suffix))


def over_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row per file, a few files a task."""
    df = spark.createDataFrame([(p,) for p in paths], "file string")
    return df.repartition(max(1, min(len(paths), 4096)))


def surt(url: Column) -> Column:
    """Reversed host, then path: 'com,example,www)/a?b'. The scheme, user, port, fragment and upper case of the host go."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"#.*$", "")
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host == "", u).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def target_uri(url: Column) -> Column:
    """The URL as a record's head has it, on one line."""
    return F.regexp_replace(url, r"[\r\n]+", "%0A")


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, n, digest, keeper (null: a response)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha1(F.encode("payload", "UTF-8"))})
    again = p.filter(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    again = materialize(again, "repeated")
    p = p.join(F.broadcast(again) if again.count() <= MOST_BROADCAST else again, "digest", "left")
    return p.withColumn("keeper", F.when(F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))).drop("largest")


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    p = plan_records(pages)
    revisit = F.col("keeper").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), F.lit(f"WARC-Date: {date}\r\n"),
        line("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))), line("WARC-Target-URI", target_uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("keeper").cast("string"), F.lit(">"))),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Payload-Length: "), F.col("n").cast("string"), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    p.select(F.concat(head, block, F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").option("compression", "none").text(path)


def read_head(f) -> dict[str, str] | None:
    """The named fields of the record at the file's position; None at its end."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record at {f.tell()}")
    out = {}
    while (line := f.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.removesuffix("\n").removesuffix("\r").removeprefix(" ")
    return out


def page_of(value: str | None) -> int | None:
    m = re.fullmatch(rf"<{ID}(-?\d+)>", value or "")
    return int(m[1]) if m else None


def captures(spark: SparkSession, path: str) -> DataFrame:
    """url, file, offset, length of every record. Contents are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with opened(name) as f:
                    while True:
                        at = f.tell()
                        head = read_head(f)
                        if head is None:
                            break
                        f.seek(f.tell() + int(head["content-length"]) + 4)
                        rows.append((head.get("warc-target-uri"), name, at, f.tell() - at))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(("url", "file", "offset", "length"), r, strict=True)) for r in rows], KIND)
                            rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(("url", "file", "offset", "length"), r, strict=True)) for r in rows], KIND)

    return over_files(spark, files(spark, path)).mapInArrow(run, "url string, file string, offset long, length long")


DIRECTORY = "file string, first_key string, last_key string, offset long, length long, n long"
KIND = pa.schema([("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


@dataclass
class CaptureIndex:
    """directory (file, first_key, offset, length, n): the blocks of the index files, in order of their keys. files (file, first_key,
    last_key): where each index file begins and ends; no more than MOST_FILES rows."""

    directory: DataFrame
    files: DataFrame

    @staticmethod
    def build(found: DataFrame, path: str, lines: int = 3000, parts: int | None = None) -> CaptureIndex:
        """found (url, file, offset, length). A block line: first key, last key, number, then the compressed entries, all but the number in
        base64."""
        spark = found.sparkSession
        s = found.select(surt(F.col("url")).alias("key"), "file", "offset", "length")
        parts = parts or min(MOST_FILES, max(LEAST_FILES, -(-found.count() // FILE_CAPTURES)))
        s = s.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
        coded = lambda key: base64.b64encode(key.encode()).decode() or "="

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def out(rows):
                body = "\n".join("\t".join((base64.b64encode(k.encode()).decode(), f, str(o), str(n))) for k, f, o, n in rows)
                text = " ".join((coded(rows[0][0]), coded(rows[-1][0]), str(len(rows)), base64.b64encode(zlib.compress(body.encode())).decode()))
                return pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])

            for b in batches:
                held += zip(*(c.to_pylist() for c in b.columns), strict=True)
                while len(held) >= lines:
                    yield out(held[:lines])
                    held = held[lines:]
            if held:
                yield out(held)

        s.mapInArrow(run, "value string").write.option("compression", "none").text(f"{path}/blocks")
        plain = lambda key: "" if key == b"=" else base64.b64decode(key).decode()

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name in b.column(0).to_pylist():
                    at = 0
                    with opened(name) as f:
                        for line in f:
                            first, last, n, _ = line.split(b" ", 3)
                            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, plain(first), plain(last), at, len(line), int(n))], names=["file", "first_key", "last_key", "offset", "length", "n"])
                            at += len(line)

        d = over_files(spark, files(spark, f"{path}/blocks")).mapInArrow(scan, DIRECTORY)
        d.write.parquet(f"{path}/directory")
        return CaptureIndex.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> CaptureIndex:
        d = spark.read.schema(DIRECTORY).parquet(f"{path}/directory")
        return CaptureIndex(d, d.groupBy("file").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")))

    def find(self, keys: DataFrame) -> DataFrame:
        """keys (key): key, file, offset, length of all their captures. Equal keys are sought once."""
        rows = sorted((r.first_key, r.last_key, r.file) for r in self.files.collect())
        firsts, lasts, names = ([r[i] for r in rows] for i in range(3))
        most = [max(lasts[: i + 1]) for i in range(len(lasts))]  # so far; rises, like the firsts
        shared = keys.sparkSession.sparkContext.broadcast((firsts, lasts, most, names))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts, lasts, most, names = shared.value
            for b in batches:
                out = [(k, names[i]) for k in b.column(0).to_pylist() for i in range(bisect_left(most, k), bisect_right(firsts, k)) if lasts[i] >= k]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], names=["key", "file"])

        def search(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
            rows = sorted(zip(*(blocks.column(c).to_pylist() for c in ("first_key", "last_key", "offset", "length", "file")), strict=True))
            begins, out, held, at = [r[0] for r in rows], [], [], None
            for key in sorted(wanted.column("key").to_pylist()):
                i = max(0, bisect_left(begins, key) - 1)
                while i < len(rows) and begins[i] <= key:
                    if rows[i][1] >= key:
                        if at != i:
                            held, at = read_block(rows[i][4], *rows[i][2:4]), i
                        lo = bisect_left(held, (key,))
                        while lo < len(held) and held[lo][0] == key:
                            out.append(held[lo])
                            lo += 1
                    i += 1
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(("key", "file", "offset", "length"), kinds, strict=True))})

        dealt = keys.select("key").distinct().mapInArrow(deal, "key string, file string")
        return self.directory.groupBy("file").cogroup(dealt.groupBy("file")).applyInArrow(search, "key string, file string, offset long, length long")

    def lookup(self, key: str) -> list[tuple[str, str, int, int]]:
        """Entries of one key."""
        return sorted(map(tuple, self.find(self.directory.sparkSession.createDataFrame([(key,)], "key string")).collect()))


def read_range(name: str, at: int, n: int) -> bytes:
    with opened(name) as f:
        f.seek(at)
        return f.read(n)


def read_block(name: str, at: int, n: int) -> list[tuple[str, str, int, int]]:
    body = zlib.decompress(base64.b64decode(read_range(name, at, n).rsplit(b" ", 1)[1])).decode()
    rows = (x.split("\t") for x in body.split("\n"))
    return [(base64.b64decode(k).decode(), f, int(o), int(m)) for k, f, o, m in rows]


def parse_record(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (None: a revisit). A digest that doesn't fit raises ValueError."""
    import io

    f = io.BytesIO(data)
    head = read_head(f)
    block = f.read(int(head["content-length"]))
    page, digest = page_of(head["warc-record-id"]), head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        return page, int(head["x-payload-length"]), digest, "revisit", page_of(head["warc-refers-to"]), None
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record of page {page}: payload and digest differ")
    return page, len(payload), digest, "response", None, payload


def read_captures(entries: DataFrame, parts: int | None = None) -> DataFrame:
    """entries (file, offset, length): the records' fields, each read by its range, in the order of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for b in batches:
            rows, now, f = [], None, None
            try:
                for name, at, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    if name != now:
                        if f:
                            f.__exit__(None, None, None)
                        f, now = opened(name), name
                        file = f.__enter__()
                    file.seek(at)
                    rows.append(parse_record(file.read(n))[:5])
            finally:
                if f:
                    f.__exit__(None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    parts = parts or max(LEAST_FILES, -(-(entries.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    e = entries.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return e.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives, indexes them, and reads back what the index finds for the URLs of all pages."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, f"{path}/archives")
    index = CaptureIndex.build(captures(spark, f"{path}/archives"), f"{path}/index")
    keys = pages.select(surt(target_uri(F.col("url"))).alias("key"))
    return read_captures(materialize(index.find(keys), "captures"))
