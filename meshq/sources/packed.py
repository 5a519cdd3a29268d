"""Packed data files of the sensor index: headers of a fixed size before each group's payloads, and reads by range."""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME_BYTES = 32


def header_size(slots: int = 1, name_bytes: int = NAME_BYTES) -> int:
    return 4 * 8 + 1 + 1 + 8 * slots + 1 + name_bytes + 8 + 8 * (slots + 1)


def header_format(slots: int = 1, name_bytes: int = NAME_BYTES) -> str:
    return f"<4dBB{slots}dB{name_bytes}sQ{slots + 1}Q"


def fixed_name(name: str, name_bytes: int = NAME_BYTES) -> bytes:
    """The name with zero bytes up to its width; a longer one raises."""
    raw = name.encode()
    if len(raw) > name_bytes:
        raise ValueError(f"{name!r} is longer than {name_bytes} bytes")
    return raw.ljust(name_bytes, b"\0")


def read_fixed_name(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode()


def encode_header(vector, slots: int, dtype_id: int, seconds, seq: int, name: str, at: int, offsets, name_bytes: int = NAME_BYTES) -> bytes:
    """Little-endian: the index vector, slots, type, each slot's seconds, sequence, file name, place of the header, offsets."""
    return struct.pack(header_format(slots, name_bytes), *vector, slots, dtype_id, *seconds, seq, fixed_name(name, name_bytes), at, *offsets)


def _local(path: str) -> str | None:
    return re.sub(r"^file:/*", "/", path) if re.match(r"file:|/", path) else None


@contextmanager
def opened(path: str, mode: str = "rb"):
    """A file of the local system, or of any that pyarrow knows, to read by place or to write."""
    if (own := _local(path)) is not None:
        with open(own, mode) as f:
            yield f
    else:
        from pyarrow.fs import FileSystem

        fs, inner = FileSystem.from_uri(path)
        with fs.open_output_stream(inner) if "w" in mode else fs.open_input_file(inner) as f:
            yield f


def move(old: str, new: str) -> None:
    if _local(old) is not None:
        os.replace(_local(old), _local(new))
    else:
        from pyarrow.fs import FileSystem

        fs, a = FileSystem.from_uri(old)
        fs.move(a, FileSystem.from_uri(new)[1])


def ready(path: str) -> None:
    if (own := _local(path)) is not None:
        os.makedirs(own, exist_ok=True)
    else:
        from pyarrow.fs import FileSystem

        fs, inner = FileSystem.from_uri(path)
        fs.create_dir(inner, recursive=True)


def file_size(path: str) -> int:
    if (own := _local(path)) is not None:
        return os.path.getsize(own)
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    return fs.get_file_info(inner).size


def read_range(path: str, at: int, size: int) -> bytes:
    """Bytes of a file; a range beyond its end raises."""
    if at < 0 or size < 0 or at + size > file_size(path):
        raise ValueError(f"{path}: {size} bytes from {at} lie beyond its end")
    with opened(path) as f:
        f.seek(at)
        return f.read(size)


def place_groups(sizes: DataFrame, max_bytes: int, items_each: int = 1_000_000) -> DataFrame:
    """sizes (item_no, total), read several times: data_no and base. Groups fill data files one after the other, a new one where the next
    group doesn't fit. Ranges of items_each groups are placed side by side, each from the file and place where the one before it ends:
    a range that the file has room for adds its bytes, and one in which a file ends is filled by itself first."""
    d = sizes.select(F.floor(F.col("item_no") / items_each).cast("long").alias("part"), F.col("item_no").cast("long").alias("item_no"), F.col("total").cast("long").alias("total"))

    def filled(some: DataFrame, begins: dict[int, tuple[int, int]]) -> DataFrame:
        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = file = at = None
            for b in batches:
                rows = []
                for own, item, total in zip(*(b.column(c).to_pylist() for c in ("part", "item_no", "total")), strict=True):
                    if own != part:
                        part, (file, at) = own, begins[own]
                    if total > max_bytes:
                        raise ValueError(f"group {item} is larger than a data file")
                    if at and at + total > max_bytes:
                        file, at = file + 1, 0
                    rows.append((item, file, at, total))
                    at += total
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["item_no", "data_no", "base", "total"])

        return some.repartition("part").sortWithinPartitions("part", "item_no").mapInArrow(fill, "item_no long, data_no long, base long, total long")

    begins, file, at = {}, 0, 0
    for part, total in sorted(d.groupBy("part").agg(F.sum("total")).collect()):  # a row for each items_each groups
        begins[part] = (file, at)
        if at + total <= max_bytes:
            at += total
        else:
            end = filled(d.filter(F.col("part") == part), {part: (file, at)}).agg(F.max(F.struct("item_no", "data_no", "base", "total")).alias("e")).first().e
            file, at = end.data_no, end.base + end.total
    return filled(d, begins).drop("total")


def remove(spark: SparkSession, path: str) -> None:
    """A folder in Spark's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_data_files(slots: DataFrame, path: str, n: int, name_bytes: int = NAME_BYTES) -> DataFrame:
    """slots (data_file, base, item_no, header, slot, payload): data_file and bytes of the files written below path. A file is one task's,
    written under a name of its own and then moved, so that a task that runs again leaves a whole file."""
    ready(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {"name": None, "temp": None, "open": None, "f": None, "size": 0, "item": None}

        def close():
            held["open"].__exit__(None, None, None)
            move(held["temp"], f"{path}/{held['name']}")
            return pa.RecordBatch.from_arrays([pa.array([held["name"]]), pa.array([held["size"]], pa.int64())], names=["data_file", "bytes"])

        for b in batches:
            for name, base, item, header, payload in zip(*(b.column(c) for c in ("data_file", "base", "item_no", "header", "payload")), strict=True):
                if name.as_py() != held["name"]:
                    if held["name"] is not None:
                        yield close()
                    held |= {"name": name.as_py(), "temp": f"{path}/.{name.as_py()}.{uuid.uuid4().hex}", "size": 0, "item": None}
                    held["open"] = opened(held["temp"], "wb")
                    held["f"] = held["open"].__enter__()
                if item.as_py() != held["item"]:
                    if base.as_py() != held["size"]:
                        raise ValueError(f"{held['name']}: group {item.as_py()} doesn't begin at {base.as_py()}")
                    held["f"].write(header.as_py())
                    held["size"], held["item"] = held["size"] + len(header.as_py()), item.as_py()
                body = payload.as_py() or b""
                held["f"].write(body)
                held["size"] += len(body)
        if held["name"] is not None:
            yield close()

    d = slots.select("data_file", "base", "item_no", "header", "slot", "payload").repartition("data_file").sortWithinPartitions("data_file", "base", "slot")
    return d.mapInArrow(run, "data_file string, bytes long")


def with_payload(matches: DataFrame, path: str) -> DataFrame:
    """matches (data_file, payload_offset, size and others): adds payload, read by range, in the order of files and places. Ranges that
    touch are read at once."""
    kinds = matches.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, at, size = (b.column(kinds.names.index(c)).to_pylist() for c in ("data_file", "payload_offset", "size"))
            out: list[bytes] = [b""] * b.num_rows
            order = sorted(range(b.num_rows), key=lambda i: (files[i], at[i]))
            i = 0
            while i < len(order):
                j, end = i, at[order[i]] + size[order[i]]
                while j + 1 < len(order) and files[order[j + 1]] == files[order[i]] and at[order[j + 1]] <= end:
                    j += 1
                    end = max(end, at[order[j]] + size[order[j]])
                start = at[order[i]]
                span = read_range(f"{path}/{files[order[i]]}", start, end - start)
                for k in order[i : j + 1]:
                    out[k] = span[at[k] - start : at[k] - start + size[k]]
                i = j + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*kinds.names, "payload"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields)
    return matches.repartitionByRange("data_file", "payload_offset").sortWithinPartitions("data_file", "payload_offset").mapInArrow(run, f"{fields}, payload binary")


def verify(lines: DataFrame, path: str, n: int, name_bytes: int = NAME_BYTES) -> DataFrame:
    """lines (item_no, header, data_file, base): the groups whose header in the data file isn't the one that their line gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = []
            for item, want, name, at in zip(*(b.column(c).to_pylist() for c in ("item_no", "header", "data_file", "base")), strict=True):
                try:
                    same = read_range(f"{path}/{name}", at, len(want)) == want
                except (OSError, ValueError):
                    same = False
                if not same:
                    bad.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], names=["item_no"])

    return lines.select("item_no", "header", "data_file", "base").mapInArrow(run, "item_no long")


def dump(matches: DataFrame, path: str) -> DataFrame:
    """matches (name, payload): one file for each match below path; gives name and bytes."""
    ready(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = []
            for name, body in zip(*(b.column(c).to_pylist() for c in ("name", "payload")), strict=True):
                with opened(f"{path}/{name}", "wb") as f:
                    f.write(body or b"")
                sizes.append(len(body or b""))
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return matches.select("name", "payload").mapInArrow(run, "name string, bytes long")


def text_file(spark: SparkSession, path: str, body: str) -> None:
    """One small file written by the driver in Spark's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()
