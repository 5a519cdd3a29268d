import random

from pyspark.sql import functions as F

from meshq.operators import cluster
from meshq.operators.parts import against
from meshq.operators.prune import step_limit, step_select
from meshq.plans.index import MeshIndex, plan_levels


def points(spark, n=600, d=3, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(i, [r.random() for _ in range(d)]) for i in range(n)], "id long, v array<double>")


def test_plan_levels():
    assert plan_levels(1000, [10, 10, 10, 10]) == [100, 10, 1]


def test_index_loses_nothing(spark, tmp_path):
    pts = points(spark)
    MeshIndex.build(pts, "id", "v", [20, 5]).save(str(tmp_path / "ix"))
    ix = MeshIndex.load(spark, str(tmp_path / "ix"))
    rows = [(r.id, r.v) for r in pts.collect()]
    q = [0.3, 0.6, 0.1]
    d2 = lambda v: sum((a - b) ** 2 for a, b in zip(v, q))
    for k in (1, 7, 700):
        assert [r.id for r in ix.knn(q, k).collect()] == [i for i, v in sorted(rows, key=lambda x: (d2(x[1]), x[0]))[:k]]
    lo, hi = [0.2, 0.1, 0.4], [0.5, 0.9, 0.6]
    assert {r.id for r in ix.range(lo, hi).collect()} == {i for i, v in rows if all(a <= x <= b for x, a, b in zip(v, lo, hi))}
    batch = ix.knn_batch(spark.createDataFrame([(0, q), (1, lo)], "qid int, q array<double>"), 5)
    assert [r.id for r in batch.filter("qid = 0").orderBy("rnk").collect()] == [i for i, v in sorted(rows, key=lambda x: (d2(x[1]), x[0]))[:5]]
    assert ix.level_sizes().agg(F.min("n_points"), F.max("n_points")).first() == (600, 600)


def test_step_equals_loop(spark):
    r = random.Random(3)
    for case in range(6):
        rows = [(i, float(r.randint(0, 8)), r.random(), r.randint(0, 4)) for i in range(15)]
        k = r.choice([1, 5, 20, 100])
        took, seen, top = [], 0, 0.0
        for i, lb, rad, n in sorted(rows, key=lambda x: (x[1], x[0])):
            if seen < k:
                top = max(top, lb + 2 * rad)
            elif lb > top:
                break
            took.append(i)
            seen += n
        df = spark.createDataFrame(rows, "node_id int, lb double, radius double, n int")
        assert sorted(x.node_id for x in step_select(df, k).collect()) == sorted(took), case
        full = df.filter("n > 0")
        limit = step_limit(full, k)
        assert sorted(x.node_id for x in full.filter(F.col("lb") <= limit).collect()) == sorted(x.node_id for x in step_select(full, k).collect()), case


def test_saved_points_are_the_input(spark, tmp_path):
    """Every point that an index returns has the coordinates of the input, in any layout of the files."""
    pts = points(spark, 300, 4, 8)
    want = {r.id: r.v for r in pts.collect()}
    for i, parts in enumerate((1, 5)):
        ix = MeshIndex.build(pts.repartition(parts), "id", "v", [15, 4])
        ix.save(str(tmp_path / f"ix{i}"))
        ix.release()
        again = MeshIndex.load(spark, str(tmp_path / f"ix{i}"))
        got = again.range([0.1] * 4, [0.7] * 4).collect() + again.knn_candidates([0.5] * 4, 20).collect()
        assert got and all(max(abs(a - b) for a, b in zip(r.coords, want[r.id])) <= 1e-6 for r in got)


def test_step_by_query_equals_single(spark):
    r = random.Random(5)
    rows = [(q, i, float(r.randint(0, 8)), r.random(), r.randint(0, 4)) for q in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "qid int, node_id int, lb double, radius double, n int")
    got = {(x.qid, x.node_id) for x in step_select(df, 6, by=("qid",)).collect()}
    assert got == {(q, x.node_id) for q in range(3) for x in step_select(df.filter(F.col("qid") == q).drop("qid"), 6).collect()}


def test_many_queries_meet_rows_in_blocks(spark):
    rows, queries = spark.range(30), spark.range(25).withColumnRenamed("id", "q")
    assert sorted(map(tuple, against(rows, queries, most=4).collect())) == sorted(map(tuple, against(rows, queries).collect()))


def test_seeding(spark):
    pts = points(spark, 200, 2, 4)
    got = cluster.plus_plus(pts, "id", "v", 6)
    assert len({tuple(c) for c in got}) == 6 and got == cluster.plus_plus(pts, "id", "v", 6)
    assert len(cluster.plus_plus(pts.limit(1), "id", "v", 3)) == 1
    fine = cluster.lloyd(pts, "v", got, 5)
    cost = lambda c: cluster.assign(pts, "v", c).agg(F.sum("d2")).first()[0]
    assert cost(fine) <= cost(got)
