"""Exact top-k search by inner product, with KD-trees over shards and a KD-tree in each.

A sample of the rows (about SAMPLE_VALUES components, by hash of the id) is split at medians into regions; every row, sampled or not,
goes to its region, and a region with more rows than a shard may hold is dealt to several shards by hash. Each region's tight bounding
box is gathered over all its rows. A query's bound on a box, its greatest product with any point of the box, orders regions, inner
nodes and leaves alike. The first wave searches each query in the region of its best bound; the kth score found there goes with the
query to those other regions whose bound reaches it, and to no more. Within a shard a tree of median splits with tight boxes is descended best first:
each query opens the node of its greatest bound, and ends when that is under its kth score. Queries of a shard come in blocks of
bounded size; a shard's rows are sent once for each block that its queries fill.

Components become floor(64 * x). Products are whole numbers: exact in doubles below 2**53, in 64-bit integers below 2**63, and in
Python's beyond, where a score that no long can hold counts as the nearest that does. Rows take no part if their id is null, or if their vector is null, empty or holds a null or non-finite component. A query meets rows of its
own length whose id isn't its own; an id that is a query more than once is one query, by its least vector; repeated rows are each
found. Ties go to the smaller id. Empty tables give no rows; columns other than the id and the vector aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshq.llm.common import drop, materialize

LEAF, BLOCK, AT_ONCE = 256, 8_192, 512
#: Rows that a shard holds at most, components sampled, rows of the sample for each region, regions at most and at least.
ROWS_EACH, SAMPLE_VALUES, SAMPLE_EACH, MOST_REGIONS, LEAST_REGIONS = 65_536, 1 << 22, 16, 4_096, 24
#: Rows of each length are searched by themselves.
KEY = ("dim", "region")


@dataclass
class Tree:
    """Nodes in the order of their making, the root first; left is -1 at leaves. Boxes are tight."""

    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    axis: np.ndarray
    cut: np.ndarray
    rows: list[np.ndarray | None]

    @staticmethod
    def of(points: np.ndarray, leaf: int = LEAF) -> Tree:
        """Median splits of the widest component. Equal points are cut by position, so that the depth stays logarithmic."""
        low, high, left, right, axis, cut, rows = [], [], [], [], [], [], []
        todo = [(np.arange(len(points)), -1, False)]
        while todo:
            own, parent, is_right = todo.pop()
            here, p = len(left), points[own]
            if parent >= 0:
                (right if is_right else left)[parent] = here
            low.append(p.min(axis=0))
            high.append(p.max(axis=0))
            left.append(-1)
            right.append(-1)
            wide = int(np.argmax(high[-1] - low[-1]))
            axis.append(wide)
            cut.append(high[-1][wide])
            if len(own) <= leaf:
                rows.append(own)
                continue
            rows.append(None)
            half = len(own) // 2
            order = np.argpartition(p[:, wide], half) if p.dtype != object else np.argsort(p[:, wide], kind="stable")
            cut[-1] = p[order[half], wide]
            todo += [(own[order[half:]], here, True), (own[order[:half]], here, False)]
        return Tree(np.array(low), np.array(high), np.array(left), np.array(right), np.array(axis), np.array(cut), rows)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): the greatest product of a query with any point of a node's box."""
        return box_bounds(queries, self.low, self.high)

    def region(self, points: np.ndarray) -> np.ndarray:
        """The number, from 0, of the leaf on whose side of all cuts a point lies."""
        number = np.cumsum(self.left < 0) - 1
        at = np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(self.left[at] >= 0)).size:
            node = at[inner]
            at[inner] = np.where(points[inner, self.axis[node]] < self.cut[node], self.left[node], self.right[node])
        return number[at]


def as_longs(x: np.ndarray) -> np.ndarray:
    """Python's whole numbers kept within those of a long, of which the least stays free; others are left as they are."""
    return np.minimum(np.maximum(x, 1 - 2**63), 2**63 - 1) if x.dtype == object else x


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return as_longs(np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T)


def nothing(dtype):
    """Less than any score."""
    return np.iinfo(np.int64).min if dtype == np.int64 else -np.inf


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (queries, k) of the best rows that reach each query's floor; unfilled places have the score nothing(). seen, if given,
    gets the number of leaves that queries opened and of those there are."""
    tree = Tree.of(points)
    none, every = nothing(points.dtype), np.arange(len(queries))
    best = np.full((len(queries), k), none, points.dtype)
    names = np.full((len(queries), k), np.iinfo(np.int64).max)
    kth, known = floor.copy(), tree.bounds(queries)
    waiting = np.full(known.shape, none, points.dtype)  # bounds of the nodes that a query may open next
    waiting[:, 0] = known[:, 0]
    opened = 0
    while len(every):
        at = waiting[every].argmax(axis=1)
        top = waiting[every, at]
        goes = (top >= kth[every]) & (top != none)
        every, at = every[goes], at[goes]
        waiting[every, at] = none
        inner = tree.left[at] >= 0
        for side in (tree.left, tree.right):
            q, n = every[inner], side[at[inner]]
            waiting[q, n] = known[q, n]
        q, n = every[~inner], at[~inner]
        opened += len(q)
        by = np.argsort(n, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(n[by])) + 1) if len(by) else ():
            own, rows = q[group], tree.rows[n[group[0]]]
            score = as_longs(queries[own] @ points[rows].T)
            score[ids[rows][None, :] == query_ids[own][:, None]] = none
            hit = ((score >= kth[own][:, None]) & (score != none)).any(axis=1)
            own, score = own[hit], score[hit]
            if not len(own):
                continue
            scores = np.concatenate([best[own], score], axis=1)
            found = np.concatenate([names[own], np.broadcast_to(ids[rows], score.shape)], axis=1)
            found = np.where(scores == none, np.iinfo(np.int64).max, found)
            order = np.argsort(found, axis=1, kind="stable")
            by_id = np.take_along_axis(scores, order, axis=1)
            # ~x falls as x rises, and no 64-bit integer overflows by it.
            falling = np.argsort(~by_id if by_id.dtype == np.int64 else -by_id, axis=1, kind="stable")[:, :k]
            order = np.take_along_axis(order, falling, axis=1)
            best[own] = np.take_along_axis(scores, order, axis=1)
            names[own] = np.take_along_axis(found, order, axis=1)
            kth[own] = np.maximum(kth[own], best[own][:, -1])
    if seen is not None:
        seen += [opened, len(queries) * int((tree.left < 0).sum())]
    best[best < floor[:, None]] = none
    return best, names


def _flat(v: pa.ChunkedArray | pa.Array) -> np.ndarray:
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """The matrices in a type in which all their products are exact."""
    widest = [max((abs(int(m.max())), abs(int(m.min()))), default=0) if m.size else 0 for m in matrices]
    most = matrices[0].shape[1] * max(widest) ** 2
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    return [m.astype(kind) for m in matrices]


def _meet(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            points, queries = exact(_flat(left.column("v")), _flat(right.column("v")))
            ids, qid = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
            none = nothing(points.dtype)
            floor = np.array([none if x is None else x for x in right.column("floor").to_pylist()], points.dtype)
            for i in range(0, len(qid), AT_ONCE):
                part = slice(i, i + AT_ONCE)
                best, names = search(points, ids, queries[part], qid[part], floor[part], k)
                r, c = np.nonzero(best != none)
                for name, x in (("query_id", qid[part][r]), ("vec_id", names[r, c]), ("score", best[r, c].astype(np.int64))):
                    out[name].append(x)
        return pa.table({name: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for name, x in out.items()})

    return run


def regions_of(rows: DataFrame) -> dict[int, Tree]:
    """A tree over a sample of the rows for each length of vectors; its leaves are the regions."""
    n, values = rows.agg(F.count("*"), F.sum(F.size("v"))).first()
    if not n:
        return {}
    share = SAMPLE_VALUES / values
    sample = rows if share >= 1 else rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * int(share * n) + 1)
    t = sample.select("v").toArrow().column(0).combine_chunks()
    lens = t.value_lengths().to_numpy()
    out = {}
    for dim in np.unique(lens):
        points = _flat(t.filter(pa.array(lens == dim))).astype(np.float64)
        regions = min(MOST_REGIONS, max(LEAST_REGIONS, -(-n // ROWS_EACH)), max(1, len(points) // SAMPLE_EACH))
        out[int(dim)] = Tree.of(points, max(1, -(-len(points) // regions)))
    return out


def with_region(rows: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """rows (vec_id, v): adds dim and region; lengths that the sample lacks have one region."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # at most MOST_REGIONS leaves for each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens = b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            region = np.zeros(len(lens), np.int64)
            for dim in np.unique(lens):
                if (tree := shared.value.get(int(dim))) is not None:
                    mine = lens == dim
                    region[mine] = tree.region(_flat(b.column(1).filter(pa.array(mine))).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lens.astype(np.int32)), pa.array(region)], names=["vec_id", "v", "dim", "region"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, dim int, region long")


def boxes_of(rows: DataFrame) -> DataFrame:
    """dim, region, low, high: the least and greatest of each component. A task sends one box for each region that it has met."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for b in batches:
            dims, regions = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                low, high = (_flat(b.column(i).take(pa.array(mine))) for i in (2, 3))
                order = np.argsort(regions[mine], kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(regions[mine][order]) != 0])
                for s, lo, hi in zip(regions[mine][order][starts], np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts), strict=True):
                    got = held.setdefault((int(dim), int(s)), [lo, hi])
                    got[0], got[1] = np.minimum(got[0], lo), np.maximum(got[1], hi)
        if held:
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            cols = [[k[0] for k in held], [k[1] for k in held], [x[0].tolist() for x in held.values()], [x[1].tolist() for x in held.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["dim", "region", "low", "high"])

    kind = "dim int, region long, low array<long>, high array<long>"
    parts = rows.select(*KEY, F.col("v").alias("low"), F.col("v").alias("high")).mapInArrow(merge, kind)
    return parts.repartition(*KEY).mapInArrow(merge, kind)


def sent(queries: DataFrame, boxes: DataFrame, home: bool) -> DataFrame:
    """queries (query_id, v, dim, and floor and home unless home is asked for): a row for each region that the query goes to. home: the
    region of its best bound; else all others whose bound reaches the floor."""
    t = boxes.toArrow()  # a row for each region, and no more than SAMPLE_VALUES components
    table = {}
    dims = t.column("dim").to_numpy()
    for dim in np.unique(dims):
        mine = t.filter(pa.array(dims == dim))
        table[int(dim)] = (mine.column("region").to_numpy(), _flat(mine.column("low")), _flat(mine.column("high")))
    shared = queries.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens = b.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(lens):
                regions, low, high = shared.value[int(dim)]
                for mine in np.array_split(np.flatnonzero(lens == dim), max(1, b.num_rows // AT_ONCE)):
                    if not len(mine):
                        continue
                    part = b.take(pa.array(mine))
                    q, lo, hi = exact(_flat(part.column("v")), low, high)
                    bound = box_bounds(q, lo, hi)
                    if home:
                        r, c = np.arange(len(mine)), bound.argmax(axis=1)
                    else:
                        none = nothing(bound.dtype)
                        floor = np.array([none if x is None else x for x in part.column("floor").to_pylist()], bound.dtype)
                        own = part.column("home").to_numpy(zero_copy_only=False)
                        r, c = np.nonzero((bound >= floor[:, None]) & (regions[None, :] != own[:, None]))
                    for i in range(0, len(r), 65_536):
                        at = pa.array(r[i : i + 65_536])
                        chosen = pa.array(regions[c[i : i + 65_536]], pa.int64())
                        floors = pa.nulls(len(at), pa.int64()) if home else part.column("floor").take(at)
                        yield pa.RecordBatch.from_arrays([part.column("query_id").take(at), part.column("v").take(at), part.column("dim").take(at), floors, chosen], names=["query_id", "v", "dim", "floor", "region"])

    cols = ["query_id", "v", "dim", *([] if home else ["floor", "home"])]
    return queries.select(*cols).mapInArrow(run, "query_id long, v array<long>, dim int, floor long, region long")


def meet(rows: DataFrame, queries: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """rows (dim, region, part, vec_id, v), queries (dim, region, query_id, v, floor): the best k of each query in each shard of its regions."""
    blocks = queries.groupBy(*KEY).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")).join(parts, [*KEY])
    q = queries.join(F.broadcast(blocks), [*KEY]).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    r = rows.join(F.broadcast(blocks), [*KEY]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = (*KEY, "part", "block")
    return r.select(*key, "vec_id", "v").groupBy(*key).cogroup(q.select(*key, "query_id", "v", "floor").groupBy(*key)).applyInArrow(_meet(k), "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, shares: dict | None = None) -> DataFrame:
    """rows (vec_id, v), queries (query_id, v), v whole numbers: query_id, rank, vec_id, score. shares, if given, gets the number of pairs
    of query and region that were searched and of those there are."""
    placed = with_region(rows, regions_of(rows))
    n = rows.count()
    most = min(ROWS_EACH, max(1, -(-2 * n // LEAST_REGIONS)))
    parts = materialize(placed.groupBy(*KEY).agg(F.ceil(F.count("*") / most).cast("long").alias("parts")), "topk-parts")
    placed = placed.join(F.broadcast(parts), [*KEY]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), "parts"))
    placed = materialize(placed.select(*KEY, "part", "vec_id", "v"), "topk-rows")
    boxes = materialize(boxes_of(placed), "topk-boxes")
    q = queries.select("query_id", "v", F.size("v").alias("dim"))
    q = q.join(F.broadcast(boxes.select("dim").distinct()), "dim", "left_semi")
    homes = materialize(sent(q, boxes, True), "topk-homes")
    first = materialize(meet(placed, homes, parts, k), "topk")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.withColumn("rank", F.row_number().over(w))
    full = ranked.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    others = homes.select("query_id", "v", "dim", F.col("region").alias("home")).join(full, "query_id", "left")
    others = materialize(sent(others, boxes, False), "topk-others")
    if shares is not None:
        shares |= {"searched": homes.count() + others.count(), "all": homes.count() * boxes.count()}
    found = materialize(first.unionByName(meet(placed, others, parts, k)), "topk-found")
    drop(placed, parts, boxes, homes, first, others)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, for rows that take part."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = embeddings.filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~bad)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def search_table(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    rows = whole_vectors(embeddings)
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    return top_k(rows, queries, k)
