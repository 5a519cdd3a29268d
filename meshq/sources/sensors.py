"""Sensor files and coordinate tables as records, and an index of them on disk: groups as JSON lines, payloads packed into data files."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshq.functions import text, timecode
from meshq.operators import sensor
from meshq.sources import packed
from meshq.sources.packed import NAME_BYTES, header_format, header_size

# Folder and type names with their numbers and extensions.
TYPES = {"image": 0, "lidar_360": 1, "livox_avia": 2, "radar_enchance_pcl": 3, "coord": 4}
FOLDERS = {"Image": ("image", ".png"), "lidar_360": ("lidar_360", ".npy"), "livox_avia": ("livox_avia", ".npy"), "radar_enchance_pcl": ("radar_enchance_pcl", ".npy")}
COORD_COLUMNS = ("Sequence", "Timestamp", "Position", "Classification")
COORD = np.dtype([("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("cls", "u1"), ("pad", "V7")])
FORMAT = "index-jsonl-data-binary-v1"
MOST_SLOTS = 255
LINE = (
    "item_no long, seq int, seq_name string, dtype string, dtype_id int, avg_timestamp double, avg_timestamp_us long, index_vector array<double>, timestamps array<double>, timestamp_us array<long>, "
    "slot_count int, valid_count int, file_name string, index_copy_offset long, binary_index_record_size long, data_base_offset long, data_offsets array<long>, sizes array<long>"
)


def type_id(dtype: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), dtype)


def read_tree(spark: SparkSession, root: str, payloads: bool = False) -> DataFrame:
    """seq, seq_name, dtype, dtype_id, ts, ts_us, path, size (and payload) of root/seq<digits>/<folder>/<seconds>.<extension>. Empty files are
    records too, of size 0. The contents are read only if asked for."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # The reader leaves empty files out, but its list of files, which the driver holds in any case, has them.
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    every = spark.createDataFrame([(p,) for p in f.inputFiles()], "path string").select(plain(F.col("path")).alias("path"))
    f = every.join(f.select(plain(F.col("path")).alias("path"), F.col("length").alias("size"), *([F.col("content").alias("payload")] if payloads else [])), "path", "left")
    parts = F.split("path", "/")
    folder = F.element_at(parts, -2)
    kind = F.create_map(*[F.lit(x) for k, (t, _) in FOLDERS.items() for x in (k, t)])
    suffix = F.create_map(*[F.lit(x) for k, (_, e) in FOLDERS.items() for x in (k, e)])
    f = f.filter(folder.isin(list(FOLDERS)) & F.element_at(parts, -3).rlike(r"^seq\d+$")).filter(text.extension(F.col("path")) == F.element_at(suffix, folder))
    ts = timecode.stem_seconds(F.col("path"))
    ts = F.when(ts.isNotNull(), ts).otherwise(F.raise_error(F.concat(F.lit("no time in "), F.col("path"))).cast("double"))
    d = f.select(text.parse_seq(F.element_at(parts, -3)).alias("seq"), F.element_at(parts, -3).alias("seq_name"), F.element_at(kind, folder).alias("dtype"), ts.alias("ts"), "path", F.coalesce("size", F.lit(0)).cast("long").alias("size"), *([F.coalesce("payload", F.lit(b"")).alias("payload")] if payloads else []))
    return d.withColumns({"dtype_id": type_id(F.col("dtype")), "ts_us": timecode.seconds_to_us(F.col("ts"))})


def pack_coord(x: Column, y: Column, z: Column, cls: Column) -> Column:
    """32 bytes: three little-endian doubles, the class as a byte, seven of padding."""

    @F.pandas_udf("binary")
    def put(a: pd.Series, b: pd.Series, c: pd.Series, k: pd.Series) -> pd.Series:
        rows = np.zeros(len(a), COORD)
        for name, s in zip(("x", "y", "z", "cls"), (a, b, c, k), strict=True):
            rows[name] = s.to_numpy()
        body = rows.tobytes()
        return pd.Series([body[i : i + 32] for i in range(0, len(body), 32)], dtype=object)

    return put(x, y, z, cls)


def unpack_coord(payload: bytes) -> tuple[float, float, float, int]:
    return struct.unpack("<dddB7x", payload)


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    """Records of a coordinate CSV: quoted fields, any order of columns, extra ones ignored. A missing column, a sequence or position that
    is none, or a class beyond 0 to 255 raises an error."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = {c.strip().lstrip("﻿"): c for c in raw.columns}
    if lost := [c for c in COORD_COLUMNS if c not in names]:
        raise ValueError(f"{path}: no column {', '.join(lost)}")
    s, t, p, c = (text.trim(F.col(f"`{names[n]}`")) for n in COORD_COLUMNS)
    fail = lambda what, kind: F.raise_error(F.lit(what)).cast(kind)
    d = raw.select(text.parse_seq(s).alias("seq"), s.alias("seq_name"), t.cast("double").alias("ts"), text.parse_position(p).alias("pos"), c.cast("int").alias("cls"))
    d = d.withColumns({"pos": F.coalesce("pos", fail("a position needs three numbers", "array<double>")), "cls": F.when(F.col("cls").between(0, 255), F.col("cls")).otherwise(fail("a class is 0 to 255", "int"))})
    payload = pack_coord(F.col("pos")[0], F.col("pos")[1], F.col("pos")[2], F.col("cls"))
    where = F.concat(F.lit(f"{path}#"), F.col("ts").cast("string"), F.lit("#"), F.xxhash64("seq", "pos", "cls").cast("string"))
    return d.select("seq", "seq_name", F.lit("coord").alias("dtype"), "ts", where.alias("path"), F.lit(32).cast("long").alias("size"), payload.alias("payload"), F.lit(TYPES["coord"]).alias("dtype_id"), timecode.seconds_to_us(F.col("ts")).alias("ts_us"))


def with_header(lines: DataFrame, n: int, name_bytes: int = NAME_BYTES) -> DataFrame:
    """item_no, data_file, base and header, the bytes before the group's payloads, of index lines."""
    cols = ["item_no", "file_name", "index_copy_offset", "index_vector", "dtype_id", "timestamps", "seq", "data_offsets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            out = [packed.encode_header(v, n, kind, ts, seq, name, at, off, name_bytes) for _, name, at, v, kind, ts, seq, off in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=["item_no", "data_file", "base", "header"])

    return lines.select(*cols).mapInArrow(run, "item_no long, data_file string, base long, header binary")


def build(records: DataFrame, path: str, n: int = 1, max_bytes: int = 1 << 30, name_bytes: int = NAME_BYTES, verify: bool = False) -> None:
    """records (seq, seq_name, dtype, dtype_id, ts, ts_us, size, path, payload) to path: index.jsonl, a line for each n records of a sequence and
    type, data files with their headers and payloads, groups (what queries prune), and meta.json, which is written last. Ties in time go
    to the smaller path; groups are numbered by sequence, mean time, type number and chunk. The mean is that of whole microseconds, whose
    sum is exact, so that groups of equal means tie. verify reads all headers back."""
    if not 1 <= n <= MOST_SLOTS:
        raise ValueError(f"a group has 1 to {MOST_SLOTS} slots")
    spark, size = records.sparkSession, header_size(n, name_bytes)
    c = sensor.chunk(records, n, "path")
    own = F.sort_array(F.collect_list(F.struct("slot", "ts", "ts_us", "size"))).alias("own")
    mean_us = F.sum(F.col("ts_us").cast("decimal(38,0)")).cast("double") / F.count("*")
    more = [mean_us.alias("mean_us"), F.first("dtype_id").alias("dtype_id"), F.min("seq_name").alias("seq_name"), F.count_if(F.col("size") > 0).alias("n_payloads"), own]
    g = sensor.item_numbers(sensor.groups(c, *more), "mean_us", ("dtype_id", "chunk")).withColumn("avg_ts", F.col("mean_us") / 1e6)
    padded = lambda field, last: F.concat(F.transform("own", lambda s: s[field]), F.array_repeat(last, F.lit(n) - F.size("own")))
    sizes = padded("size", F.lit(0).cast("long"))
    g = g.withColumn("sizes", sizes)
    offsets = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("long"), lambda a, s: a + s))
    g.write.mode("overwrite").parquet(f"{path}/grouped")
    g = spark.read.parquet(f"{path}/grouped")
    place = packed.place_groups(g.select("item_no", (F.col("bytes") + size).alias("total")), max_bytes)
    avg_us = timecode.seconds_to_us(F.col("avg_ts"))
    file_name = F.format_string("data_%04d.bin", "data_no")
    g = g.join(place, "item_no").select(
        F.col("item_no").cast("long").alias("item_no"), F.col("seq").cast("int").alias("seq"), "seq_name", "dtype", "dtype_id", F.col("avg_ts").alias("avg_timestamp"), avg_us.alias("avg_timestamp_us"),
        F.array(*timecode.limbs(avg_us), F.col("seq").cast("double")).alias("index_vector"), padded("ts", F.element_at(F.col("own"), -1)["ts"]).alias("timestamps"), padded("ts_us", F.element_at(F.col("own"), -1)["ts_us"]).alias("timestamp_us"),
        F.lit(n).alias("slot_count"), F.col("valid_count").cast("int").alias("valid_count"), file_name.alias("file_name"), F.col("base").alias("index_copy_offset"), F.lit(size).cast("long").alias("binary_index_record_size"),
        (F.col("base") + size).alias("data_base_offset"), offsets.alias("data_offsets"), "sizes", "chunk", "first_us", "last_us", "n_payloads",
    )
    # Written first: all else is made from what stands there.
    g.write.mode("overwrite").parquet(f"{path}/staged")
    g = spark.read.parquet(f"{path}/staged")
    packed.remove(spark, f"{path}/grouped")
    lines = g.drop("chunk", "first_us", "last_us", "n_payloads")
    lines.repartitionByRange("item_no").sortWithinPartitions("item_no").write.mode("overwrite").json(f"{path}/index.jsonl")
    pruned = ["item_no", "seq", "dtype_id", "first_us", "last_us", "slot_count", "n_payloads"]
    g.select(*pruned).repartitionByRange("seq", "first_us").sortWithinPartitions("seq", "first_us").write.mode("overwrite").parquet(f"{path}/groups")
    heads = with_header(lines, n, name_bytes).join(g.select("item_no", "seq", "dtype", "chunk"), "item_no")
    files = packed.write_data_files(c.select("seq", "dtype", "chunk", "slot", "payload").join(heads, ["seq", "dtype", "chunk"]), path, n, name_bytes).collect()  # a row for each data file
    count = g.count()
    if verify and (bad := packed.verify(with_header(lines, n, name_bytes), path, n, name_bytes).limit(5).collect()):
        raise ValueError(f"{path}: headers differ at items {[r.item_no for r in bad]}")
    meta = {
        "format": FORMAT, "main_index_format": "jsonl", "data_index_copy_format": "fixed_binary", "endianness": "little", "index_file": "index.jsonl", "index_record_count": count, "group_size_N": n, "file_name_bytes": name_bytes,
        "binary_index_record_size": size, "binary_index_struct_format": header_format(n, name_bytes), "max_runtime_N": MOST_SLOTS, "max_data_file_size": max_bytes, "type_enum": TYPES, "coordinate_payload": {"format": "<dddB7x", "size": 32},
        "timestamp_vector_rule": "microseconds of the mean time in three limbs of 21 bits, each plus 1, then the sequence", "data_access_rule": "payload i: data_base_offset + data_offsets[i], up to data_offsets[i + 1]", "data_files": sorted(r.data_file for r in files),
    }
    packed.text_file(spark, f"{path}/meta.json", json.dumps(meta, indent=1))


def load_meta(spark: SparkSession, path: str, group_size: int | None = None, name_bytes: int | None = None) -> dict:
    """meta.json, checked; other group sizes or name widths than those asked for raise."""
    meta = json.loads(spark.read.text(f"{path}/meta.json", wholetext=True).first()[0])
    for key, want in (("group_size_N", group_size), ("file_name_bytes", name_bytes)):
        if not isinstance(meta.get(key), int) or meta[key] < 1 or want not in (None, meta[key]):
            raise ValueError(f"{path}: {key} is {meta.get(key)!r}, not {want or 'a positive number'}")
    if meta.get("binary_index_record_size") != header_size(meta["group_size_N"], meta["file_name_bytes"]):
        raise ValueError(f"{path}: binary_index_record_size is {meta.get('binary_index_record_size')!r}")
    return meta


def faults(n: int, size: int, name_bytes: int = NAME_BYTES) -> Column:
    """What is wrong with an index line; null if nothing."""
    c, steps = F.col, F.sequence(F.lit(0), F.lit(n - 1))
    checks = [
        ("no item_no", c("item_no").isNull() | (c("item_no") < 0)), ("seq or dtype_id is no byte", ~(c("seq").between(0, 255) & c("dtype_id").between(0, 255))), ("slot_count differs from meta", c("slot_count") != n),
        ("valid_count over slot_count", ~c("valid_count").between(0, c("slot_count"))), ("header size differs from meta", c("binary_index_record_size") != size), ("file_name too long", F.octet_length("file_name") > name_bytes),
        ("index_vector needs 4 numbers", F.size("index_vector") != 4), ("array lengths", (F.size("timestamps") != n) | (F.size("timestamp_us") != n) | (F.size("sizes") != n) | (F.size("data_offsets") != n + 1)),
        ("negative size", F.exists("sizes", lambda s: s.isNull() | (s < 0))), ("negative offset", F.exists("data_offsets", lambda o: o.isNull() | (o < 0))), ("first offset isn't 0", F.get("data_offsets", F.lit(0)) != 0),
        ("offsets fall", F.exists(steps, lambda i: F.get("data_offsets", i + 1) < F.get("data_offsets", i))), ("sizes aren't those of the offsets", F.exists(steps, lambda i: F.get("data_offsets", i + 1) - F.get("data_offsets", i) != F.get("sizes", i))),
        ("padding with a size", F.exists(steps, lambda i: (i >= c("valid_count")) & (F.get("sizes", i) != 0))),
    ]
    return F.coalesce(*[F.when(F.coalesce(wrong, F.lit(True)), F.lit(what)) for what, wrong in checks])


class SensorIndex:
    """A built index. A query prunes the groups by their times, loads the lines of those alone, checks them, and refines by slot."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.meta = load_meta(spark, self.path)
        self.n, self.name_bytes, self.size = (self.meta[k] for k in ("group_size_N", "file_name_bytes", "binary_index_record_size"))
        self.groups = spark.read.parquet(f"{self.path}/groups")
        self.raw = spark.read.schema(LINE).option("mode", "FAILFAST").json(f"{self.path}/{self.meta['index_file']}")

    def checked(self, lines: DataFrame) -> DataFrame:
        """Lines; one that isn't sound raises an error."""
        wrong = faults(self.n, self.size, self.name_bytes)
        message = F.concat(F.lit("line of item "), F.coalesce(F.col("item_no").cast("string"), F.lit("?")), F.lit(": "), wrong)
        return lines.withColumn("item_no", F.when(wrong.isNull(), F.col("item_no")).otherwise(F.raise_error(message).cast("long")))

    def lines(self) -> DataFrame:
        """All lines; their number must be the one in the metadata."""
        if (found := self.raw.count()) != self.meta["index_record_count"]:
            raise ValueError(f"{self.path}: {found} lines, and {self.meta['index_record_count']} by the metadata")
        return self.checked(self.raw)

    def candidate_lines(self, wanted: DataFrame) -> DataFrame:
        """The lines of wanted (item_no), in order; one that is missing raises an error."""
        if lost := sensor.missing(self.raw, wanted, "item_no").limit(5).collect():
            raise ValueError(f"{self.path}: no lines of items {sorted(r.item_no for r in lost)}")
        return self.checked(sensor.candidates(self.raw, wanted, "item_no")).orderBy("item_no")

    def slots(self, lines: DataFrame) -> DataFrame:
        """A row for each slot: its time, size and place in the data file."""
        z = F.arrays_zip(F.col("timestamps").alias("ts"), F.col("timestamp_us").alias("ts_us"), F.col("sizes").alias("size"), F.slice("data_offsets", 1, self.n).alias("off"))
        s = lines.select("item_no", "seq", "dtype", "dtype_id", F.col("file_name").alias("data_file"), "index_copy_offset", "data_base_offset", F.posexplode(z).alias("slot", "s"))
        return s.select("item_no", "seq", "dtype", "dtype_id", "slot", F.col("s.ts").alias("ts"), F.col("s.ts_us").alias("ts_us"), F.col("s.size").alias("size"), "data_file", "index_copy_offset", (F.col("data_base_offset") + F.col("s.off")).alias("payload_offset"))

    def records(self) -> DataFrame:
        return self.slots(self.lines())

    def knn_candidates(self, seq: int, seconds: float, k: int, include_padding: bool = False) -> DataFrame:
        return sensor.nearest_candidates(self.groups, seq, to_us(seconds), k, "slot_count" if include_padding else "n_payloads")

    def range_candidates(self, seqs: list[int], start: float, end: float) -> DataFrame:
        if end < start or not seqs:
            raise ValueError("a range needs start <= end and a sequence")
        return sensor.interval_candidates(self.groups, seqs, to_us(start), to_us(end))

    def knn(self, seq: int, seconds: float, k: int = 10, include_padding: bool = False) -> DataFrame:
        if k < 1:
            raise ValueError("k must be 1 or more")
        s = self.slots(self.candidate_lines(self.knn_candidates(seq, seconds, k, include_padding)))
        return sensor.nearest(s, seq, to_us(seconds), k, "item_no", "slot", include_padding=include_padding)

    def range(self, seqs: list[int], start: float, end: float, limit: int = 0, include_padding: bool = False) -> DataFrame:
        s = self.slots(self.candidate_lines(self.range_candidates(seqs, start, end)))
        return sensor.interval(s, seqs, to_us(start), to_us(end), "ts_us", "item_no", "slot", limit=limit, include_padding=include_padding)

    def counts(self, found: DataFrame, wanted: DataFrame, seqs: list[int] | None = None, include_padding: bool = False) -> dict[str, int]:
        """Candidates, their lines, slots that take part (in ranges alone), and matches."""
        lines = self.candidate_lines(wanted)
        slots = 0 if seqs is None else self.slots(lines).filter(F.col("seq").isin(seqs) & (F.lit(include_padding) | (F.col("size") > 0))).count()
        return {"candidate_count": wanted.count(), "record_count": lines.count(), "slot_count": slots, "match_count": found.count()}

    def with_payload(self, matches: DataFrame) -> DataFrame:
        return packed.with_payload(matches, self.path)

    def payload(self, data_file: str, offset: int, size: int) -> bytes:
        return packed.read_range(f"{self.path}/{text.safe_name(data_file)}", offset, size)

    def verify(self) -> DataFrame:
        """Items whose header in the data file isn't what their line says."""
        return packed.verify(with_header(self.lines(), self.n, self.name_bytes), self.path, self.n, self.name_bytes)

    def dump(self, matches: DataFrame, path: str) -> DataFrame:
        """matches with rnk: a file for each below path."""
        return packed.dump(self.with_payload(matches.withColumn("name", dump_name())), path)


def to_us(seconds: float) -> int:
    """As seconds_to_us does, on the driver."""
    from decimal import ROUND_HALF_UP, Decimal

    return int((Decimal(seconds) * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP))


def dump_name() -> Column:
    """The name of a match's file: rank, item, slot, sequence, type, time."""
    head = F.format_string("match_%04d_item%08d_slot%03d_seq%04d_dtype%d_", F.col("rnk").cast("int"), "item_no", "slot", "seq", "dtype_id")
    return F.concat(head, timecode.safe_timestamp(F.col("ts")), text.type_extension(F.col("dtype_id")))


def match_lines(matches: list[dict]) -> str:
    """Matches for reading by eye."""
    out = [
        f"[{m['rnk']}] item={m['item_no']} slot={m['slot']}\n    seq={m['seq']} dtype={m['dtype_id']}\n    timestamp={m['ts']:.9f} diff_us={m.get('diff_us', 0)} size={m['size']}\n"
        f"    data_file={m['data_file']}\n    index_copy_offset={m['index_copy_offset']}\n    payload_abs_offset={m['payload_offset']}\n"
        for m in matches
    ]
    return "\n".join(out) or "No matches."
