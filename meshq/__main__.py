"""python -m meshq build|generate|knn|range|sensor-build|sensor-query|serve: the indexes from the command line."""

from __future__ import annotations

import argparse
import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshq.functions.text import parse_ratios, parse_seqs, size_in_bytes
from meshq.functions.vectors import log_volume
from meshq.operators import stats
from meshq.plans.index import MeshIndex
from meshq.service import RATIOS, PointService, SensorService, build_sensors, serve
from meshq.sources import sensors
from meshq.sources.catalog import append_statistics
from meshq.sources.points import read_knn_queries, read_points, read_range_queries, synthetic


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="meshq", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build", help="an index of a point matrix")
    b.add_argument("--points", required=True)
    g = sub.add_parser("generate", help="an index of made points, whose hierarchy is known")
    for name, kind, value in (("--n", int, 1_000_000), ("--dims", int, 3), ("--min", float, 1.0), ("--max", float, 100.0), ("--seed", int, 12345), ("--sigma-divisor", float, 3.0)):
        g.add_argument(name, type=kind, default=value)
    g.add_argument("--whole", action="store_true", help="whole coordinates")
    for x in (b, g):
        x.add_argument("--ratios", default=RATIOS)
        x.add_argument("--height", type=int, help="levels, the points' included: one more than the ratios")
    for name in ("knn", "range"):
        q = sub.add_parser(name, help=f"a batch of {name} queries")
        q.add_argument("--queries", required=True)
        q.add_argument("--max-queries", type=int, default=10)
        q.add_argument("--log", help="folder of the batch log")
        if name == "knn":
            q.add_argument("-k", type=int, default=10)
    s = sub.add_parser("sensor-build", help="an index of sensor files and a coordinate table")
    s.add_argument("root")
    s.add_argument("csv")
    s.add_argument("--group-size", type=int, default=1)
    s.add_argument("--max-data-file-size", default="1GiB")
    s.add_argument("--verify", action="store_true")
    s = sub.add_parser("sensor-query")
    s.add_argument("--mode", choices=("knn", "range"), default="knn")
    for name in ("--timestamp", "--start", "--end"):
        s.add_argument(name, type=float)
    s.add_argument("--seq", action="append", default=[], help="1, seq0001, or a list with commas")
    s.add_argument("--knn-k", type=int, default=10)
    s.add_argument("--range-limit", type=int, default=0, help="0: all")
    s.add_argument("--include-padding", action="store_true")
    s.add_argument("--dump-dir")
    for x in sub.choices.values():
        x.add_argument("--index", required=True)
    w = sub.add_parser("serve")
    w.add_argument("kind", choices=("points", "sensors"))
    w.add_argument("--root", required=True)
    w.add_argument("--host", default="127.0.0.1")
    w.add_argument("--port", type=int, default=8080)
    return p


def levels(a: argparse.Namespace) -> list[int]:
    ratios = parse_ratios(a.ratios)
    if a.height is not None and (a.height < 2 or len(ratios) != a.height - 1):
        raise ValueError("the height must be 2 or more, and there must be one ratio less")
    return ratios


def write_log(spark: SparkSession, a: argparse.Namespace, index: MeshIndex, timed: list[tuple[int, float, int]], label: str) -> DataFrame:
    kind, parameter = ("POINT (KNN)", f"k={a.k}") if a.what == "knn" else ("RANGE", label)
    batch = stats.batch_statistics(spark.createDataFrame(timed, "time_us long, log_volume double, candidates long"))
    rows = stats.log_rows(batch, a.index.rstrip("/").split("/")[-1], index.points.count(), index.dim, kind, parameter, "spark")
    append_statistics(rows, a.log)
    return rows


def batch(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    """The first queries of a file, at most max-queries; with a log, one after the other, and timed."""
    index = MeshIndex.load(spark, a.index)
    q = (read_knn_queries if a.what == "knn" else read_range_queries)(spark, a.queries)
    q = q.filter(q.qid < a.max_queries).orderBy("qid").collect()  # max-queries rows
    out, timed = [], []
    for r in q:
        began = time.perf_counter()
        if a.what == "knn":
            out += [{"qid": r.qid, "id": x.id, "d2": x.d2, "rnk": i + 1} for i, x in enumerate(index.knn(r.q, a.k).collect())]
        else:
            out.append({"qid": r.qid, "ids": [x.id for x in index.range(r.lo, r.hi).select("id").orderBy("id").toLocalIterator()]})
        us = round((time.perf_counter() - began) * 1e6)
        if a.log:
            sizes = index.pruned_sizes(r.q, a.k) if a.what == "knn" else index.pruned_sizes(lo=r.lo, hi=r.hi)
            volume = 1.0 if a.what == "knn" else spark.range(1).select(log_volume(F.array(*map(F.lit, r.lo)), F.array(*map(F.lit, r.hi)))).first()[0]
            timed.append((us, volume, sizes.orderBy(F.desc("level")).first().n_nodes))
    if a.log and timed:
        write_log(spark, a, index, timed, q[0].label if a.what == "range" else "")
    return out


def sensor_query(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    index, seqs = sensors.SensorIndex(spark, a.index), parse_seqs(*a.seq)
    if a.mode == "knn":
        if a.timestamp is None or len(seqs) != 1:
            raise ValueError("knn needs --timestamp and one --seq")
        found = index.knn(seqs[0], a.timestamp, a.knn_k, a.include_padding).orderBy("rnk")
    else:
        if a.start is None or a.end is None or not seqs:
            raise ValueError("range needs --start, --end and --seq")
        found = index.range(seqs, a.start, a.end, a.range_limit, a.include_padding).orderBy("ts_us", "item_no", "slot")
    rows = [r.asDict() | {"rnk": i} for i, r in enumerate(found.collect())]
    print(sensors.match_lines(rows))
    if a.dump_dir and rows:
        kept = spark.createDataFrame([(r["item_no"], r["slot"], r["rnk"]) for r in rows], "item_no long, slot int, rnk int")
        index.dump(found.drop("rnk").join(kept, ["item_no", "slot"]), a.dump_dir).collect()
    return rows


def main(args: list[str] | None = None) -> list[dict]:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.what in ("build", "generate"):
        if a.what == "build":
            index = MeshIndex.build(read_points(spark, a.points), "id", "coords", levels(a))
        else:
            index = MeshIndex.from_levels(synthetic(spark, a.n, a.dims, a.min, a.max, levels(a), a.whole, a.seed, a.sigma_divisor))
        index.save(a.index)
        index.release()
    elif a.what in ("knn", "range"):
        out = batch(spark, a)
        for r in out:
            print(json.dumps(r))
        return out
    elif a.what == "sensor-build":
        build_sensors(spark, a.root, a.csv, a.index, a.group_size, size_in_bytes(a.max_data_file_size), a.verify)
    elif a.what == "sensor-query":
        return sensor_query(spark, a)
    else:
        serve((PointService if a.kind == "points" else SensorService)(spark, a.root), a.host, a.port)
        threading.Event().wait()
    return []


if __name__ == "__main__":
    main()
