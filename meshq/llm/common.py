"""What several operators share: tables in the cluster's shared folder, words, and dealing rows by an ordered key."""

from __future__ import annotations

import atexit
import gc
import math
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_caches: dict = {}


def worker_cache(name: str, make):
    """An object kept in a Python worker for the tasks that follow. A worker keeps one: another operator's goes."""
    if name not in _caches:
        _caches.clear()
        _caches[name] = make()
    return _caches[name]


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a session of one machine, as in tests, gets a folder of its own; a
    cluster raises an error, for its machines wouldn't see each other's folders."""
    global _own
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if "_own" not in globals():
        _own = tempfile.mkdtemp(prefix="meshq-")
    return f"file://{_own}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: its lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame | None) -> None:
    """Removes tables that materialize has written, when what was made of them is written too and nothing reads them again."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            _delete(df.sparkSession, path)
            _written.remove((df.sparkSession, path))
            del df._written_to


def release(spark: SparkSession) -> None:
    """Lets go of what earlier queries hold. Their plans, broadcasts and shuffle files stay until the driver collects its garbage, which it
    puts off while its heap may grow; native memory that was freed stays with its C library."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Has the driver's JVM give the native memory that it has freed back to the system, and says whether it could. Compilers and the
    threads of many exchanges leave some hundreds of MB, which the C library keeps. Of JVMs only newer ones on Linux can."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def array(kind, values: list):
        out = new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    named = jvm.java.lang.Class.forName
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # By the interface's method, for the class of the server isn't exported.
        takes = array(jvm.java.lang.Class, [named(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")])
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = array(jvm.java.lang.Object, [command, "systemTrimNativeHeap", array(jvm.java.lang.Object, []), array(jvm.java.lang.String, [])])
        named("javax.management.MBeanServer").getMethod("invoke", takes).invoke(server, given)
    except Py4JError:
        return False
    return True


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def all_columns(df: DataFrame) -> list[Column]:
    """Every column of df, whatever marks its name holds."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


SPACE = "\\x20\\x09-\\x0D"


def words(text: Column) -> Column:
    """The runs of `[^\\x20\\x09-\\x0D]`; null or blank text has none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{SPACE}]+"))


def word_count(text: Column) -> Column:
    """The number of runs of `[^\\x20\\x09-\\x0D]`."""
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit(*parts: Column) -> Column:
    """A number in (0, 1), fixed by its parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def bounds_of(df: DataFrame, key: str, rows_each: int = 256, most: int = 20_000) -> tuple[int, list]:
    """The table's row count and sorted distinct values of key that cut it into parts of about equal size. Their number
    follows the rows; most bounds what reaches the driver, not what is dealt."""
    n = df.count()
    parts = max(1, min(most, math.ceil(n / rows_each)))
    if parts == 1:
        return n, []
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0]
    return n, sorted(set(cuts or []))


def part_of(key: Column, bounds: list) -> Column:
    """How many bounds are at most key (null: 0): a search in two steps, over every s-th bound and then within s."""
    if not bounds:
        return F.lit(0)
    s = max(1, math.isqrt(len(bounds)))
    at_most = lambda values: F.size(F.filter(values, lambda b: b <= key))
    coarse = at_most(F.array(*[F.lit(b) for b in bounds[::s]]))
    fine = F.array(*[F.lit(b) for b in bounds])
    return F.when(key.isNull() | (key < bounds[0]), 0).otherwise((coarse - 1) * s + at_most(F.slice(fine, (coarse - 1) * s + 1, F.lit(s))))
