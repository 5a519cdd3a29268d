"""Names, sizes and positions written as text. What can't be read raises an error; with strict=False it is null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of sizes, those with an i in powers of 1024.
UNITS = {"b": 1, "kb": 1000, "kib": 1024, "mb": 1000**2, "mib": 1024**2, "gb": 1000**3, "gib": 1024**3}
# What the packed payloads of a type are called.
EXTENSIONS = {0: ".png", 1: ".npy", 2: ".npy", 3: ".npy", 4: ".coord.bin"}
BLANK = r"[\x09-\x0D\x20]"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_raise(value: Column, kind: str, message: str, text: Column, strict: bool) -> Column:
    return F.coalesce(value, F.when(text.isNotNull(), F.raise_error(F.concat(F.lit(f"{message}: "), text)).cast(kind))) if strict else value


def trim(c: Column | str) -> Column:
    """Without white space of ASCII at either end."""
    return F.regexp_replace(column(c), rf"^{BLANK}++|{BLANK}++$", "")


def strip_mark(c: Column | str) -> Column:
    """Without a byte-order mark."""
    return F.regexp_replace(column(c), "^﻿", "")


def lower_ascii(c: Column | str) -> Column:
    return F.translate(column(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse_seq(name: Column, strict: bool = True) -> Column:
    """seq0012 -> 12, up to 255."""
    n = F.regexp_extract(name, r"^seq0*(\d{1,3})$", 1).try_cast("int")
    return or_raise(F.when(n <= 255, n), "int", "no sequence of 0 to 255", name, strict)


def parse_size(text: Column, strict: bool = True) -> Column:
    """'8MiB' -> bytes. A unit may stand behind the number without a blank, in any case; none is bytes. Sizes beyond a long raise too."""
    s = lower_ascii(trim(text))
    number = F.regexp_extract(s, r"^(\d+)([a-z]*)$", 1).try_cast("long")
    unit = F.regexp_extract(s, r"^(\d+)([a-z]*)$", 2)
    factor = F.create_map(*[F.lit(x) for u, n in UNITS.items() for x in (u, F.lit(n).cast("long"))])
    return or_raise(F.try_multiply(number, F.try_element_at(factor, F.when(unit == "", "b").otherwise(unit))), "long", "no size", text, strict)


def parse_position(text: Column) -> Column:
    """'[x, y, z]' -> three doubles; null unless there are exactly three."""
    v = F.from_json(text, "array<double>")
    return F.when((F.size(v) == 3) & ~F.exists(v, lambda x: x.isNull()), v)


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dataset_name(path: Column) -> Column:
    """The file name up to its first underscore, or all of it; empty behind a last slash."""
    return F.regexp_extract(_file_name(path), r"^([^_]*)", 1)


def _range_part(path: Column) -> Column:
    """Between the last underscore and the next point."""
    return F.regexp_extract(F.regexp_extract(path, r"([^_]*)$", 1), r"^([^.]*)", 1)


def range_percentage(path: Column, strict: bool = True) -> Column:
    """The whole number that the part behind the last underscore begins with."""
    return or_raise(F.regexp_extract(_range_part(path), rf"^{BLANK}*([+-]?\d+)", 1).try_cast("int"), "int", "no percentage", path, strict)


def range_label(path: Column) -> Column:
    """set_50-3.txt -> 50%^3=12.50%, the share of the volume that three sides of half the length cover; set_7.txt -> 7%."""
    part = _range_part(path)
    whole = lambda i: F.regexp_extract(part, rf"^{BLANK}*([+-]?\d+)[^-]*-{BLANK}*([+-]?\d+)", i).cast("int")
    share = F.pow(whole(1) / 100.0, whole(2)) * 100
    return F.when(F.contains(part, F.lit("-")), F.format_string("%d%%^%d=%.2f%%", whole(1), whole(2), F.bround(share, 2))).otherwise(F.concat(part, F.lit("%")))


def extension(path: Column) -> Column:
    """With its point, lower case; none for names that only begin with one."""
    return lower_ascii(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def type_extension(dtype_id: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, dtype_id), F.lit(".bin"))


def parse_ratios(text: str) -> list[int]:
    """'100,50' -> [100, 50]."""
    parts = [x.strip() for x in text.split(",")]
    if not all(re.fullmatch(r"0*[1-9]\d*", x) for x in parts):
        raise ValueError(f"ratios must be positive whole numbers: {text!r}")
    return [int(x) for x in parts]


def parse_seqs(*texts: str) -> list[int]:
    """'1,seq0003' -> [1, 3], sorted and distinct; empty parts are passed over."""
    out = set()
    for x in (x.strip() for text in texts for x in text.split(",")):
        if not x:
            continue
        if not (m := re.fullmatch(r"(?:seq)?(\d+)", x)) or int(m[1]) > 255:
            raise ValueError(f"no sequence of 0 to 255: {x!r}")
        out.add(int(m[1]))
    return sorted(out)


def size_in_bytes(text: str) -> int:
    """What parse_size gives, on the driver."""
    if not (m := re.fullmatch(r"(\d+)([a-z]*)", text.strip().lower())) or (m[2] or "b") not in UNITS or int(m[1]) * UNITS[m[2] or "b"] >= 2**63:
        raise ValueError(f"no size: {text!r}")
    return int(m[1]) * UNITS[m[2] or "b"]


def safe_name(name: str) -> str:
    """Refuses what could leave the folder."""
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z0-9._-]+", name) or name in (".", ".."):
        raise ValueError(f"no name: {name!r}")
    return name
