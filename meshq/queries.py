"""The registered queries on points, boxes, clusters and sensor records, each with its SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshq.functions import text, timecode, vectors
from meshq.operators import cluster, parts, prune, search, sensor, stats, tensor
from meshq.plans.index import MeshIndex, plan_levels
from meshq.service import PointService, SensorService
from meshq.shared import scratch
from meshq.sources import packed, points, sensors
from meshq.sources.catalog import Catalog, append_statistics

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Q = [[((i * m) % 7 - 3) / 64 for i in range(64)] for m in (1, 2, 3, 5)]
LO, HI = [-0.125] * 64, [0.125] * 64


def _sql_vec(v) -> str:
    return "[" + ",".join(f"{x:.10f}" for x in v) + "]::DOUBLE[]"


def _sql_d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]-z[2])*(z[1]-z[2])))"


@query(f"select vec_id, round({_sql_d2('embedding::DOUBLE[]', _sql_vec(Q[0]))}, 9) as d2 from embeddings order by {_sql_d2('embedding::DOUBLE[]', _sql_vec(Q[0]))}, vec_id limit 10")
def knn_exact(spark, sf_dir):
    return search.knn(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", Q[0], 10).withColumn("d2", F.round("d2", 9))


def _queries(spark) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in enumerate(Q)], "qid int, q array<double>")


_Q_SQL = " union all ".join(f"select {i} as qid, {_sql_vec(q)} as q" for i, q in enumerate(Q))


@query(f"""with q as ({_Q_SQL}), d as (select qid, vec_id, {_sql_d2('embedding::DOUBLE[]', 'q')} as d2 from embeddings, q),
r as (select *, row_number() over (partition by qid order by d2, vec_id) as rnk from d) select qid, vec_id, round(d2, 9) as d2, rnk::int as rnk from r where rnk <= 10""")
def knn_batch(spark, sf_dir):
    return search.knn_batch(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", _queries(spark), 10).withColumn("d2", F.round("d2", 9))


@query("select p_partkey, p_size, p_retailprice from part where p_size between 10 and 20 and p_retailprice between 905 and 950")
def range_exact(spark, sf_dir):
    return search.box(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], [10, 905.0], [20, 950.0]).select("p_partkey", "p_size", "p_retailprice")


_BOXES = [(0, 1.0, 3.0, 0.0, 0.02, 0.0, 0.01), (1, 10.0, 12.0, 0.03, 0.05, 0.02, 0.03), (2, 50.0, 50.0, 0.1, 0.1, 0.08, 0.08)]


@query("""with q(qid, a, b, c, d, e, f) as (values """ + ", ".join(str(b) for b in _BOXES) + """) select qid, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity
from lineitem, q where l_quantity between a and b and l_discount between c and d and l_tax between e and f""")
def range_batch(spark, sf_dir):
    cols = ["l_quantity", "l_discount", "l_tax"]
    q = spark.createDataFrame(_BOXES, "qid int, " + ", ".join(f"lo_{c} double, hi_{c} double" for c in cols))
    return search.box_batch(table(spark, sf_dir, "lineitem"), cols, q).select("qid", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query("""select vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: greatest(-0.125::DOUBLE - x, x - 0.125::DOUBLE, 0.0::DOUBLE) * greatest(-0.125::DOUBLE - x, x - 0.125::DOUBLE, 0.0::DOUBLE))), 9) as d2 from embeddings""")
def point_box_distance(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.box_distance_squared(vectors.as_double("embedding"), vectors.vector(LO), vectors.vector(HI)), 9).alias("d2"))


@query("select vec_id from embeddings where len(list_filter(embedding::DOUBLE[], lambda x: x < -0.35 or x > 0.35)) = 0")
def range_array(spark, sf_dir):
    """A box over coordinates that are one array."""
    return search.box_array(table(spark, sf_dir, "embeddings"), "embedding", [-0.35] * 64, [0.35] * 64).select("vec_id")


# A fixed tree over part: 50 leaves by size, 5 tops of ten sizes each, points (size, price). Centroids are rounded, so that
# the order of summing doesn't show.
_TREE = """pts as (select p_partkey, p_size::DOUBLE as x, p_retailprice as y, p_size as leaf, ((p_size - 1) // 10)::INT as top from part),
leaf as (select leaf as node_id, any_value(top) as parent_id, round(avg(x), 6) as cx, round(avg(y), 6) as cy, count(*) as n from pts group by leaf),
leafr as (select l.*, (select max(sqrt((p.x - l.cx) * (p.x - l.cx) + (p.y - l.cy) * (p.y - l.cy))) from pts p where p.leaf = l.node_id) as radius from leaf l),
top as (select top as node_id, round(avg(x), 6) as cx, round(avg(y), 6) as cy, count(*) as n from pts group by top),
topr as (select t.*, (select max(sqrt((p.x - t.cx) * (p.x - t.cx) + (p.y - t.cy) * (p.y - t.cy))) from pts p where p.top = t.node_id) as radius from top t)"""


def _points(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.col("p_size").alias("leaf"), F.floor((F.col("p_size") - 1) / 10).cast("int").alias("top"))


def _nodes(pts: DataFrame, by: str) -> DataFrame:
    up = [F.min("top").alias("parent_id")] if by == "leaf" else []
    c = pts.groupBy(F.col(by).alias("node_id")).agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"), F.count("*").alias("n"), *up)
    d = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    r = pts.join(c, F.col(by) == F.col("node_id")).groupBy("node_id").agg(F.max(d).alias("radius"))
    return c.join(r, "node_id")


_BOX = ([12.0, 905.0], [18.0, 920.0])
_BOX_D2 = "greatest(12 - cx, cx - 18, 0) * greatest(12 - cx, cx - 18, 0) + greatest(905 - cy, cy - 920, 0) * greatest(905 - cy, cy - 920, 0)"
_AT = (17.0, 930.0)
_D = "sqrt((cx - 17) * (cx - 17) + (cy - 930) * (cy - 930))"


def _hit(t):
    return t.filter(prune.box_may_hit(vectors.flat_box_distance_squared([F.col("cx"), F.col("cy")], *_BOX), F.col("radius")))


def _bounded(t):
    return t.withColumn("lb", prune.knn_bounds(F.sqrt(vectors.flat_l2_squared([F.col("cx"), F.col("cy")], _AT)), F.col("radius"))[0])


@query(f"with {_TREE} select node_id, n, round(radius, 6) as radius from leafr where {_BOX_D2} <= radius * radius")
def range_prune(spark, sf_dir):
    return _hit(_nodes(_points(spark, sf_dir), "leaf")).select("node_id", "n", F.round("radius", 6).alias("radius"))


@query(f"with {_TREE} select node_id, round({_D} - radius, 6) as lb, round({_D} + radius, 6) as ub from leafr")
def knn_lower_bound(spark, sf_dir):
    return _bounded(_nodes(_points(spark, sf_dir), "leaf")).select("node_id", F.round("lb", 6).alias("lb"), F.round(F.col("lb") + 2 * F.col("radius"), 6).alias("ub"))


_STEP = """b as (select *, coalesce(sum(n) over (order by lb, node_id rows between unbounded preceding and 1 preceding), 0) as before from a),
c as (select *, greatest(0, max(case when before < 25 then lb + 2 * radius end) over ()) as t from b)"""


@query(f"with {_TREE}, a as (select *, {_D} - radius as lb from leafr), {_STEP} select node_id, n from c where before < 25 or lb <= t")
def step_select(spark, sf_dir):
    return prune.step_select(_bounded(_nodes(_points(spark, sf_dir), "leaf")), 25).select("node_id", "n")


@query(f"""with {_TREE}, tk as (select node_id from topr where {_BOX_D2} <= radius * radius),
lk as (select node_id from leafr where parent_id in (select node_id from tk) and {_BOX_D2} <= radius * radius) select p_partkey, x, y from pts where leaf in (select node_id from lk)""")
def candidates_range(spark, sf_dir):
    pts = _points(spark, sf_dir)
    top = _hit(_nodes(pts, "top")).select(F.col("node_id").alias("parent_id"))
    leaf = _hit(_nodes(pts, "leaf").join(top, "parent_id", "left_semi"))
    return pts.join(leaf.select(F.col("node_id").alias("leaf")), "leaf", "left_semi").select("p_partkey", "x", "y")


@query(f"""with {_TREE}, a as (select *, {_D} - radius as lb from topr), {_STEP}, tk as (select node_id from c where before < 25 or lb <= t),
a2 as (select *, {_D} - radius as lb from leafr where parent_id in (select node_id from tk)), {_STEP.replace("b as", "b2 as").replace("from a)", "from a2)").replace("c as (select", "c2 as (select").replace("from b)", "from b2)")},
lk as (select node_id from c2 where before < 25 or lb <= t) select p_partkey, x, y from pts where leaf in (select node_id from lk)""")
def candidates_knn(spark, sf_dir):
    pts = _points(spark, sf_dir)
    top = prune.step_select(_bounded(_nodes(pts, "top")), 25).select(F.col("node_id").alias("parent_id"))
    leaf = prune.step_select(_bounded(_nodes(pts, "leaf").join(top, "parent_id", "left_semi")), 25)
    return pts.join(leaf.select(F.col("node_id").alias("leaf")), "leaf", "left_semi").select("p_partkey", "x", "y")


@query(f"with {_TREE} select t.node_id as parent_id, l.node_id as child_id, l.n from topr t join leafr l on l.parent_id = t.node_id")
def expand_children(spark, sf_dir):
    pts = _points(spark, sf_dir)
    top = _nodes(pts, "top").select(F.col("node_id").alias("parent_id"))
    return _nodes(pts, "leaf").join(top, "parent_id").select("parent_id", F.col("node_id").alias("child_id"), "n")


@query(f"with {_TREE} select l.node_id as child_id, t.node_id as parent_id, round(l.cx / t.cx, 6) as rx, round(l.cy / t.cy, 6) as ry from leaf l join top t on t.node_id = l.parent_id")
def prolong_ratio(spark, sf_dir):
    pts = _points(spark, sf_dir)
    kids = _nodes(pts, "leaf").select(F.col("node_id").alias("child_id"), "parent_id", F.array("cx", "cy").alias("coords"))
    e = cluster.edges(kids, _nodes(pts, "top").select(F.col("node_id").alias("parent_id"), F.array("cx", "cy").alias("centroid")))
    return e.select("child_id", "parent_id", F.round(F.col("ratio")[0], 6).alias("rx"), F.round(F.col("ratio")[1], 6).alias("ry"))


@query(f"with {_TREE} select l.node_id as child_id, round(l.cx / t.cx * t.cx, 5) as x, round(l.cy / t.cy * t.cy, 5) as y from leaf l join top t on t.node_id = l.parent_id")
def prolong_apply(spark, sf_dir):
    pts = _points(spark, sf_dir)
    kids = _nodes(pts, "leaf").select(F.col("node_id").alias("child_id"), "parent_id", F.array("cx", "cy").alias("coords"))
    up = _nodes(pts, "top").select(F.col("node_id").alias("parent_id"), F.array("cx", "cy").alias("centroid"))
    e = cluster.edges(kids, up).join(up, "parent_id").withColumn("v", vectors.prolong(F.col("ratio"), F.col("centroid")))
    return e.select("child_id", F.round(F.col("v")[0], 5).alias("x"), F.round(F.col("v")[1], 5).alias("y"))


_START = [[5.0, 905.0], [15.0, 915.0], [25.0, 925.0], [35.0, 935.0], [45.0, 945.0]]
_C = ", ".join(f"({i}, {c[0]}::DOUBLE, {c[1]}::DOUBLE)" for i, c in enumerate(_START))
_ASSIGN = f"""c(label, cx, cy) as (values {_C}), d as (select p_partkey, p_size::DOUBLE as x, p_retailprice as y, label, (p_size - cx) * (p_size - cx) + (p_retailprice - cy) * (p_retailprice - cy) as d2 from part, c),
a as (select * from (select *, row_number() over (partition by p_partkey order by d2, label) as rn from d) where rn = 1)"""


def _assigned(spark, sf_dir):
    return cluster.assign(_points(spark, sf_dir).select("p_partkey", F.array("x", "y").alias("coords")), "coords", _START)


@query(f"with {_ASSIGN} select p_partkey, label::int as label, round(d2, 6) as d2 from a")
def kmeans_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("p_partkey", "label", F.round("d2", 6).alias("d2"))


@query(f"with {_ASSIGN} select label::int as label, round(avg(x), 6) as mx, round(avg(y), 6) as my from a group by label")
def centroid_mean(spark, sf_dir):
    return cluster.means(_assigned(spark, sf_dir), "coords").select("label", F.round(F.col("centroid")[0], 6).alias("mx"), F.round(F.col("centroid")[1], 6).alias("my"))


@query(f"with {_ASSIGN}, m as (select label, avg(x) as mx, avg(y) as my from a group by label) select a.label::int as label, round(max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))), 6) as radius from a join m on a.label = m.label group by a.label")
def max_radius(spark, sf_dir):
    a = _assigned(spark, sf_dir)
    return cluster.radii(a, cluster.means(a, "coords")).select("label", F.round("radius", 6).alias("radius"))


@query(f"with {_ASSIGN} select label::int as label, count(*) as n from a group by label")
def cluster_sizes(spark, sf_dir):
    return _assigned(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query(f"with {_TREE} select 0 as level, count(*) as n_nodes, sum(n)::bigint as n_points from top union all select 1, count(*), sum(n)::bigint from leaf")
def level_sizes(spark, sf_dir):
    pts = _points(spark, sf_dir)
    t = [_nodes(pts, by).select(F.lit(i).alias("level"), "node_id", "n") for i, by in enumerate(("top", "leaf"))]
    return t[0].unionByName(t[1]).groupBy("level").agg(F.count("*").alias("n_nodes"), F.sum("n").alias("n_points"))


def _records(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id"), F.col("user_id").cast("int").alias("seq"), F.col("event_type").alias("dtype"), timecode.timestamp_to_us(F.col("ts")).alias("ts_us"), F.octet_length("props").cast("long").alias("size"))


_REC = "r as (select event_id, user_id::int as seq, event_type as dtype, epoch_us(ts) as ts_us, strlen(props) as size from events)"
_CH = _REC + ", p as (select *, row_number() over (partition by seq, dtype order by ts_us, event_id) - 1 as pos from r), c as (select *, pos // 8 as chunk, (pos % 8)::int as slot from p)"


@query("select event_id, epoch_us(ts) as ts_us from events")
def timestamp_us(spark, sf_dir):
    return _records(spark, sf_dir).select("event_id", "ts_us")


@query("select event_id, ((epoch_us(ts) >> 42) & 2097151)::double + 1 as l0, ((epoch_us(ts) >> 21) & 2097151)::double + 1 as l1, (epoch_us(ts) & 2097151)::double + 1 as l2 from events")
def time_limbs(spark, sf_dir):
    a, b, c = timecode.limbs(F.col("ts_us"))
    return _records(spark, sf_dir).select("event_id", a.alias("l0"), b.alias("l1"), c.alias("l2"))


_GR = _CH + ", g as (select seq, dtype, chunk, count(*) as valid_count, min(ts_us) as first_us, max(ts_us) as last_us, (sum(ts_us::hugeint) // count(*))::bigint as avg_us, sum(size)::bigint as bytes from c group by all)"


def _groups(spark, sf_dir):
    return sensor.groups(sensor.chunk(_records(spark, sf_dir), 8, "event_id"))


@query(f"with {_GR} select * from g")
def sensor_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


@query(f"with {_GR} select seq, dtype, chunk, row_number() over (order by seq, avg_us, dtype, chunk) - 1 as item_no from g")
def sensor_item_no(spark, sf_dir):
    return sensor.item_numbers(_groups(spark, sf_dir)).select("seq", "dtype", "chunk", "item_no")


@query(f"with {_CH} select event_id, chunk, slot, coalesce(sum(size) over (partition by seq, dtype, chunk order by slot rows between unbounded preceding and 1 preceding), 0)::bigint as off from c")
def slot_offsets(spark, sf_dir):
    return sensor.slot_offsets(sensor.chunk(_records(spark, sf_dir), 8, "event_id"), "event_id").select("event_id", "chunk", "slot", "off")


@query(f"with {_CH}, g as (select seq, dtype, chunk, max(ts_us) as last_us from c group by all), s as (select *, unnest(range(8))::int as slot from g) select s.seq, s.dtype, s.chunk, s.slot, coalesce(c.ts_us, s.last_us) as ts_us, coalesce(c.size, 0)::bigint as size from s left join c on s.seq = c.seq and s.dtype = c.dtype and s.chunk = c.chunk and s.slot = c.slot")
def slot_padding(spark, sf_dir):
    return sensor.padded_slots(sensor.chunk(_records(spark, sf_dir), 8, "event_id"), 8)


_AT_US = 1705320000000000


@query(f"with {_REC}, t as (select event_id, dtype, ts_us, abs(ts_us - {_AT_US}) as diff_us from r where seq = 8 and size > 0 order by diff_us, ts_us, event_id limit 10) select *, (row_number() over (order by diff_us, ts_us, event_id) - 1)::int as rnk from t")
def sensor_knn(spark, sf_dir):
    return sensor.nearest(_records(spark, sf_dir), 8, _AT_US, 10, "event_id").select("event_id", "dtype", "ts_us", "diff_us", "rnk")


@query(f"with {_REC} select event_id, seq, ts_us from r where seq in (3, 8, 21) and size > 0 and ts_us between {_AT_US} and {_AT_US + 400_000_000_000}")
def sensor_range(spark, sf_dir):
    return sensor.interval(_records(spark, sf_dir), [3, 8, 21], _AT_US, _AT_US + 400_000_000_000, "event_id").select("event_id", "seq", "ts_us")


@query(f"with {_REC} select event_id, seq, ts_us from r where seq in (3, 8, 21) and size > 0 and ts_us between {_AT_US} and {_AT_US + 400_000_000_000} order by ts_us, event_id limit 5")
def sensor_range_limit(spark, sf_dir):
    return sensor.interval(_records(spark, sf_dir), [3, 8, 21], _AT_US, _AT_US + 400_000_000_000, "event_id", limit=5).select("event_id", "seq", "ts_us")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")
def candidate_semi(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return sensor.candidates(table(spark, sf_dir, "orders"), c, "o_custkey").select("o_orderkey", "o_custkey")


@query("select distinct c_custkey as o_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 200000)")
def candidate_missing(spark, sf_dir):
    """Wanted keys that no record has; the records are the dear orders, so that many customers are missing."""
    dear = table(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    return sensor.missing(dear, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("select distinct o_custkey from orders where o_totalprice > 200000 order by 1")
def candidate_ids(spark, sf_dir):
    """Distinct candidates in order."""
    return table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select("o_custkey").distinct().orderBy("o_custkey")


_VOL = "case when p_size - 1 <= 0 or p_retailprice - 905 <= 0 then '-inf'::double else ln((p_size - 1)::double) + ln(p_retailprice - 905) end"


def _volume():
    return vectors.log_volume(vectors.vector([1, 905]), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")))


@query(f"select p_partkey, round({_VOL}, 6) as log_volume from part")
def range_log_volume(spark, sf_dir):
    v = _volume()
    return table(spark, sf_dir, "part").select("p_partkey", F.when(v == float("-inf"), v).otherwise(F.round(v, 6)).alias("log_volume"))


@query("select round(case when count(p_retailprice) > 2 then (sum(p_retailprice) - max(p_retailprice) - min(p_retailprice)) / (count(p_retailprice) - 2) else avg(p_retailprice) end, 6) as trimmed_mean from part")
def trimmed_mean(spark, sf_dir):
    return stats.trimmed_mean(table(spark, sf_dir, "part"), "p_retailprice").withColumn("trimmed_mean", F.round("trimmed_mean", 6))


@query(f"select round(median({_VOL}), 6) as median_log_volume from part where p_size > 1 and p_retailprice > 905")
def median_volume(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size > 1 and p_retailprice > 905").agg(F.round(F.median(_volume()), 6).alias("median_log_volume"))


@query("select n_nationkey, ((n_nationkey * 10) % 256)::int as seq, case when n_nationkey < 20 then n_nationkey end as zeros from nation")
def parse_seq(spark, sf_dir):
    zeros = F.concat(F.when(F.col("n_nationkey") < 20, "seq").otherwise("sequence"), F.lit("0" * 12), F.col("n_nationkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.parse_seq(F.format_string("seq%04d", (F.col("n_nationkey") * 10) % 256)).alias("seq"), text.parse_seq(zeros, strict=False).alias("zeros"))


@query("select n_nationkey, n_nationkey + 0.5::double as x, (-n_nationkey)::double as y, n_regionkey::double as z from nation")
def parse_position(spark, sf_dir):
    p = text.parse_position(F.concat(F.lit("["), F.col("n_nationkey") + 0.5, F.lit(", "), -F.col("n_nationkey"), F.lit(", "), F.col("n_regionkey"), F.lit("]")))
    return table(spark, sf_dir, "nation").withColumn("p", p).select("n_nationkey", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("p")[2].alias("z"))


# Every unit as a user may write it, with the bytes it stands for.
_SIZES = {"": 1, "b": 1, "B": 1, "kb": 1000, "KB": 1000, "KiB": 1024, "mb": 1000000, "MiB": 1048576, "Gb": 1000000000, "gib": 1073741824}


@query("select n_nationkey, u as unit, (n_nationkey + 1)::bigint * f as bytes from nation, (values " + ", ".join(f"('{u}', {f}::bigint)" for u, f in _SIZES.items()) + ") t(u, f) union all select n_nationkey, u, null from nation, (values (' kb'), ('k'), ('tb'), ('-')) t(u)")
def parse_size(spark, sf_dir):
    units = F.explode(F.array(*[F.lit(u) for u in [*_SIZES, " kb", "k", "tb", "-"]])).alias("unit")
    d = table(spark, sf_dir, "nation").select("n_nationkey", units)
    return d.select("n_nationkey", "unit", text.parse_size(F.concat(F.lit(" "), (F.col("n_nationkey") + 1).cast("string"), "unit", F.lit("\t")), strict=False).alias("bytes"))


@query("select n_nationkey, split_part(n_name, '_', 1) as dataset, split_part(n_name, '_', 1) || '.txt' as whole, '' as slash from nation")
def dataset_name(spark, sf_dir):
    name = F.split_part("n_name", F.lit("_"), F.lit(1))
    path = lambda tail: F.concat(F.lit("/da_ta/"), name, F.lit(tail))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.dataset_name(path("_50_7-3.txt")).alias("dataset"), text.dataset_name(path(".txt")).alias("whole"), text.dataset_name(path("/")).alias("slash"))


@query("""select n_nationkey, printf('%d%%^%d=%.2f%%', 4 * (n_nationkey + 1), n_regionkey + 1, pow(4 * (n_nationkey + 1) / 100.0::double, n_regionkey + 1) * 100) as label,
(n_nationkey + 1) || '%' as plain, n_nationkey + 1 as percentage from nation""")
def coverage_label(spark, sf_dir):
    """The labels that names of query files stand for."""
    n = F.col("n_nationkey") + 1
    dashed = F.concat(F.lit("/q/set_a_"), (4 * n).cast("string"), F.lit("-"), (F.col("n_regionkey") + 1).cast("string"), F.lit(".txt"))
    plain = F.concat(F.lit("/q/set_"), n.cast("string"), F.lit(".2.txt"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.range_label(dashed).alias("label"), text.range_label(plain).alias("plain"), text.range_percentage(plain).alias("percentage"))


@query()
def mesh_index_knn(spark, sf_dir):
    """The nearest through a fitted index; equal to knn_exact."""
    ix = MeshIndex.build(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", [50, 5])
    return ix.knn(Q[0], 10).select(F.col("id").alias("vec_id"), F.round("d2", 9).alias("d2"))


SQL["mesh_index_knn"] = SQL["knn_exact"]


_LABEL = "case when v is null then 'nan' when v = '-inf'::double then '0' when v = 'inf'::double then 'inf' else printf('%.2f', pow(10::double, v / ln(10::double) - floor(v / ln(10::double)))) || 'E' || case when v >= 0 then '+' else '' end || floor(v / ln(10::double))::bigint end"


@query(f"select p_partkey, {_LABEL} as label from (select p_partkey, case when p_partkey % 50 = 1 then 'inf'::double when p_partkey % 50 = 2 then null when v = '-inf'::double then v else v * (p_partkey % 7 - 3) * 11 end as v from (select p_partkey, {_VOL} as v from part))")
def volume_labels(spark, sf_dir):
    """Volumes of all sizes as text, and those that are no numbers."""
    key, v = F.col("p_partkey") % 50, _volume()
    v = F.when(key == 1, float("inf")).when(key == 2, float("nan")).when(v == float("-inf"), v).otherwise(v * (F.col("p_partkey") % 7 - 3) * 11)
    return table(spark, sf_dir, "part").select("p_partkey", vectors.volume_label(v).alias("label"))


@query("select p_partkey, case when p_size <= 25 then '0' else 'inf' end as label from part")
def volume_label_ends(spark, sf_dir):
    """A side that is empty, and one without end."""
    flat = vectors.log_volume(vectors.vector([1, 0]), F.array(F.lit(1.0), F.lit(5.0)))
    return table(spark, sf_dir, "part").select("p_partkey", vectors.volume_label(F.when(F.col("p_size") <= 25, flat).otherwise(float("inf"))).alias("label"))


_SEC = "(p_partkey - 1000) * 0.3333335"


@query(f"select p_partkey, (sign({_SEC}) * (floor(abs({_SEC})) * 1000000 + round((abs({_SEC}) - floor(abs({_SEC}))) * 1000000)))::bigint as us from (select p_partkey::double as p_partkey from part)")
def seconds_us(spark, sf_dir):
    """Seconds on either side of zero, many with half a microsecond."""
    p = F.col("p_partkey").cast("double")
    return table(spark, sf_dir, "part").select(p.alias("p_partkey"), timecode.seconds_to_us((p - 1000) * 0.3333335).alias("us"))


@query("select n_nationkey, n_nationkey * 1000.5::double as seconds, printf('%.6f', n_nationkey * 1000.5::double) as plain, replace(printf('%.6f', n_nationkey * 1000.5::double), '.', '_') as safe, '.npy' as ext from nation")
def file_times(spark, sf_dir):
    stem = F.format_string("%.6f", F.col("n_nationkey") * 1000.5)
    d = table(spark, sf_dir, "nation").withColumn("path", F.concat(F.lit("/a.b/seq0001/Image/"), stem, F.lit(".NPY")))
    return d.select("n_nationkey", timecode.stem_seconds(F.col("path")).alias("seconds"), stem.alias("plain"), timecode.safe_timestamp(timecode.stem_seconds(F.col("path"))).alias("safe"), text.extension(F.col("path")).alias("ext"))


@query("select n_nationkey, lower(n_name) as name, n_name as plain from nation")
def text_clean(spark, sf_dir):
    dirty = F.concat(F.lit("\ufeff \t"), "n_name", F.lit("\r\n "))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.lower_ascii(text.trim(text.strip_mark(dirty))).alias("name"), text.trim(text.strip_mark(dirty)).alias("plain"))


@query("select unnest([1, 3, 21, 255])::int as seq")
def sequence_list(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in text.parse_seqs(" 21,seq0003, ,255", "1,seq0021")], "seq int")


@query("select * from (values (0, 100::bigint, 10000::bigint), (1, 50, 200), (2, 20, 10), (3, 10, 1)) t(level, ratio, nodes)")
def level_plan(spark, sf_dir):
    """Ratios as text, and the sizes of levels over a million points; the plan ends at the first level of one node."""
    ratios = text.parse_ratios("100, 50,20,10,7")
    return spark.createDataFrame([(i, r, n) for i, (r, n) in enumerate(zip(ratios, plan_levels(1_000_000, ratios), strict=False))], "level int, ratio long, nodes long")


@query("select vec_id, list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))) < 9 as near, list_aggregate(embedding::DOUBLE[], 'max') < 0.2 as equal, abs(embedding[1]::double) < 0.05 as zero from embeddings")
def closeness(spark, sf_dir):
    """Numbers and vectors that are equal within a bound."""
    e = vectors.as_double("embedding")
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + F.abs(x))
    most = F.array(F.array_max(e))
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.near(total, F.lit(0.0), 9).alias("near"), (vectors.near_vectors(most, F.array(F.lit(0.0)), 0.2) | (F.array_max(e) < 0)).alias("equal"), vectors.is_zero(F.get(e, F.lit(0)), 0.05).alias("zero"))


@query("select p_partkey, abs(p_retailprice - (900 + p_size)) <= 10 or abs(p_retailprice - (900 + p_size)) / greatest(1, abs(900 + p_size)) <= 0.02 as ok from part")
def close_values(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", vectors.close(F.col("p_retailprice"), 900.0 + F.col("p_size"), 10, 0.02).alias("ok"))


@query("select c_custkey from customer where ('0x' || substr(md5(c_custkey::varchar || '#7'), 1, 8))::bigint / 4294967296.0::double < 0.3")
def bernoulli_sample(spark, sf_dir):
    return cluster.sample(table(spark, sf_dir, "customer"), "c_custkey", 0.3, "7").select("c_custkey")


@query(f"with {_TREE}, c as (select parent_id, count(*) as n from leaf group by parent_id) select parent_id, n, (select max(n) from c) as most from c")
def children_counts(spark, sf_dir):
    return cluster.children(_nodes(_points(spark, sf_dir), "leaf"))


@query(f"with {_TREE} select count(*) filter (where {_BOX_D2} <= radius * radius) as selected, count(*) as total from leafr")
def selected_count(spark, sf_dir):
    hit = prune.box_may_hit(vectors.flat_box_distance_squared([F.col("cx"), F.col("cy")], *_BOX), F.col("radius"))
    return _nodes(_points(spark, sf_dir), "leaf").agg(F.count_if(hit).alias("selected"), F.count("*").alias("total"))


@query(f"with {_TREE} select node_id, row_number() over (order by round({_D}, 6), node_id)::int as place from leaf")
def clusters_sorted(spark, sf_dir):
    """Clusters in the order of their distance."""
    d = _nodes(_points(spark, sf_dir), "leaf").withColumn("d", F.round(F.sqrt(vectors.flat_l2_squared([F.col("cx"), F.col("cy")], _AT)), 6))
    return parts.with_position(d.withColumn("all", F.lit(0)), ["all"], "d", ["node_id"], "p").select("node_id", (F.col("p") + 1).cast("int").alias("place"))


@query(f"with {_TREE} select p_partkey, leaf as node_id, (row_number() over (partition by leaf order by p_partkey) - 1) as place from pts")
def label_order(spark, sf_dir):
    """Points in the order of their clusters."""
    return parts.with_position(_points(spark, sf_dir).withColumnRenamed("leaf", "node_id"), ["node_id"], "p_partkey", [], "place").select("p_partkey", "node_id", "place")


@query(f"with {_TREE}, m as (select node_id, row_number() over (order by node_id) - 1 as own from leaf) select p_partkey, own as position from pts join m on leaf = node_id")
def id_refactor(spark, sf_dir):
    """Ids replaced by what a table gives for them."""
    pts = _points(spark, sf_dir)
    m = tensor.with_starts(_nodes(pts, "leaf").select("node_id", F.lit(1).cast("long").alias("one")), "node_id", "one").select(F.col("node_id").alias("leaf"), F.col("start").alias("position"))
    return pts.join(F.broadcast(m), "leaf").select("p_partkey", "position")


@query(f"with {_TREE}, e as (select parent_id as col, node_id as row from leaf) select col, count(*) as n, coalesce(sum(count(*)) over (order by col rows between unbounded preceding and 1 preceding), 0)::bigint as start, list(row order by row)::varchar as rows from e group by col")
def tensor_columns(spark, sf_dir):
    """Links in coordinate form brought to column form."""
    e = _nodes(_points(spark, sf_dir), "leaf").select(F.col("parent_id").alias("col"), F.col("node_id").alias("row"), F.array("cx", "cy").alias("values"))
    return tensor.to_columns(e).select("col", "n", "start", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r.cast("string")), ", "), F.lit("]")).alias("rows"))


@query(f"with {_TREE} select true as equal, count(*) as entries from leaf")
def tensor_forms(spark, sf_dir):
    """Whether both forms of the links hold the same."""
    e = _nodes(_points(spark, sf_dir), "leaf").select(F.col("parent_id").alias("col"), F.col("node_id").alias("row"), F.array("cx", "cy").alias("values")).cache()
    return e.agg(F.lit(tensor.equal(e, tensor.to_columns(e))).alias("equal"), F.count("*").alias("entries"))


@query(f"with {_TREE}, c as (select leaf as col, count(*) as n from pts group by leaf) select col, n, coalesce(sum(n) over (order by col rows between unbounded preceding and 1 preceding), 0)::bigint as start from c")
def tensor_starts(spark, sf_dir):
    counts = _points(spark, sf_dir).groupBy(F.col("leaf").alias("col")).agg(F.count("*").alias("n"))
    return tensor.with_starts(counts, "col", "n").select("col", "n", "start")


@query(f"with {_TREE} select parent_id || ' ' || node_id || ' ' || n || '.0' as line from leaf")
def tensor_dump(spark, sf_dir):
    e = _nodes(_points(spark, sf_dir), "leaf").select(F.col("parent_id").alias("col"), F.col("node_id").alias("row"), F.array(F.col("n").cast("double")).alias("values"))
    return tensor.dump_lines(e).select("line")


_LLOYD = _ASSIGN + """, m as (select label, avg(x) as cx, avg(y) as cy from a group by label),
c2 as (select c.label, coalesce(m.cx, c.cx) as cx, coalesce(m.cy, c.cy) as cy from c left join m on c.label = m.label),
d2 as (select p_partkey, p_size::DOUBLE as x, p_retailprice as y, label, (p_size - cx) * (p_size - cx) + (p_retailprice - cy) * (p_retailprice - cy) as d2 from part, c2),
a2 as (select * from (select *, row_number() over (partition by p_partkey order by d2, label) as rn from d2) where rn = 1),
m2 as (select label, avg(x) as cx, avg(y) as cy from a2 group by label)"""


@query(f"with {_LLOYD} select c2.label::int as label, round(coalesce(m2.cx, c2.cx), 6) as mx, round(coalesce(m2.cy, c2.cy), 6) as my from c2 left join m2 on c2.label = m2.label")
def lloyd_steps(spark, sf_dir):
    """Two steps from given centroids; an empty cluster keeps its own."""
    got = cluster.lloyd(_points(spark, sf_dir).select("p_partkey", F.array("x", "y").alias("coords")), "coords", _START, 2)
    return spark.createDataFrame([(i, round(c[0], 6), round(c[1], 6)) for i, c in enumerate(got)], "label int, mx double, my double")


@query(f"with {_ASSIGN} select p_partkey, label::int as label, round(d2, 6) as d2 from a")
def kmeans_assign_table(spark, sf_dir):
    """The nearest centroid, with the centroids as a table and not as literals."""
    d = cluster.assign(_points(spark, sf_dir).select("p_partkey", F.array("x", "y").alias("coords")), "coords", _START, most=0)
    return d.select("p_partkey", "label", F.round("d2", 6).alias("d2"))


@query("select 5::bigint as starts, true as distinct_points")
def kmeans_starts(spark, sf_dir):
    """Seeding draws points of the table, none twice."""
    pts = _points(spark, sf_dir).select("p_partkey", F.array("x", "y").alias("coords")).cache()
    got = spark.createDataFrame([(c,) for c in cluster.plus_plus(pts, "p_partkey", "coords", 5)], "coords array<double>").distinct()
    found = got.join(pts.select("coords").distinct(), "coords", "left_semi")
    return found.agg(F.count("*").alias("starts"), (F.count("*") == 5).alias("distinct_points"))


def _tree_levels(spark, sf_dir) -> list[DataFrame]:
    pts = _points(spark, sf_dir)
    top = _nodes(pts, "top").select(F.col("node_id").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.array("cx", "cy").alias("coords"))
    leaf = _nodes(pts, "leaf").select(F.col("node_id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent_id"), F.array("cx", "cy").alias("coords"))
    return [top, leaf, pts.select(F.col("p_partkey").alias("id"), F.col("leaf").cast("long").alias("parent_id"), F.array("x", "y").alias("coords"))]


def _saved(spark, sf_dir) -> MeshIndex:
    """The fixed tree as an index whose nodes are known, written and read again."""
    path, index = scratch(spark, "mesh"), MeshIndex.from_levels(_tree_levels(spark, sf_dir))
    index.save(path)
    index.release()
    return MeshIndex.load(spark, path)


@query(f"with {_TREE} select 0 as level, node_id::bigint as node_id, n, round(radius, 6) as radius from topr union all select 1, node_id, n, round(radius, 6) from leafr")
def index_nodes(spark, sf_dir):
    return _saved(spark, sf_dir).nodes.select("level", "node_id", "n", F.round("radius", 6).alias("radius"))


@query("select p_partkey as id, (p_size - 17) * (p_size - 17) + (p_retailprice - 930) * (p_retailprice - 930) as d2 from part order by d2, id limit 25")
def index_knn(spark, sf_dir):
    return _saved(spark, sf_dir).knn(_AT, 25)


SQL["index_knn"] = "select id, round(d2, 6) as d2 from (" + SQL["index_knn"] + ")"
_index_knn = QUERIES["index_knn"]
QUERIES["index_knn"] = lambda spark, sf_dir: _index_knn(spark, sf_dir).withColumn("d2", F.round("d2", 6))


@query("select p_partkey as id from part where p_size between 12 and 18 and p_retailprice between 905 and 920")
def index_range(spark, sf_dir):
    return _saved(spark, sf_dir).range(*_BOX).select("id")


@query("""with q as (select s_suppkey as qid, (s_suppkey % 50)::double as x, 900 + (s_suppkey % 97)::double as y from supplier where s_suppkey <= 12),
d as (select qid, p_partkey as id, (p_size - x) * (p_size - x) + (p_retailprice - y) * (p_retailprice - y) as d2 from part, q),
r as (select *, row_number() over (partition by qid order by d2, id)::int as rnk from d) select qid, id, rnk from r where rnk <= 7""")
def index_knn_batch(spark, sf_dir):
    """A batch through the index, no more queries than the cap."""
    k = F.col("s_suppkey")
    q = table(spark, sf_dir, "supplier").filter(k <= 12).select(k.alias("qid"), F.array((k % 50).cast("double"), 900.0 + k % 97).alias("q"))
    return _saved(spark, sf_dir).knn_batch(q, 7).select("qid", "id", "rnk")


@query(f"""with {_TREE}, tk as (select node_id from topr where {_BOX_D2} <= radius * radius),
lk as (select node_id from leafr where parent_id in (select node_id from tk) and {_BOX_D2} <= radius * radius)
select 0 as level, count(*) as n_nodes from tk union all select 1, count(*) from lk union all select 2, count(*) from pts where leaf in (select node_id from lk)""")
def pruned_sizes(spark, sf_dir):
    """What a box query keeps of each level, and its candidates."""
    return _saved(spark, sf_dir).pruned_sizes(lo=_BOX[0], hi=_BOX[1])


@query(f"with {_TREE} select 0 as level, (count(*) * 40)::bigint as bytes from top union all select 1, count(*) * 40 from leaf")
def index_bytes(spark, sf_dir):
    return _saved(spark, sf_dir).byte_sizes()


@query(f"with {_TREE} select leaf::bigint as node_id, p_partkey as id from pts")
def index_points(spark, sf_dir):
    return _saved(spark, sf_dir).sorted_points()


@query("select unnest(['a-1', 'b.2']) as name")
def index_names(spark, sf_dir):
    """Complete indexes of a folder; one without its nodes isn't listed."""
    root = scratch(spark, "catalog")
    index = MeshIndex.from_levels(_tree_levels(spark, sf_dir))
    catalog = Catalog(spark, root)
    for name in ("b.2", "a-1"):
        catalog.save(name, index)
    index.points.write.parquet(f"{root}/half/points")
    index.release()
    return spark.createDataFrame([(n,) for n in catalog.names()], "name string")


@query("select (row_number() over (order by p_partkey) - 1)::bigint as id, p_size::double as x, p_retailprice as y from part")
def matrix_round_trip(spark, sf_dir):
    """Points written as a text matrix and read again; ids are the order of lines."""
    path = scratch(spark, "matrix")
    points.write_matrix(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("coords")), path)
    return points.read_points(spark, path).select("id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))


@query("select (n_nationkey)::bigint as qid, n_regionkey::double as a, 0.5::double as b, n_regionkey + 2::double as c, 7.25::double as d from nation")
def range_file(spark, sf_dir):
    """Boxes written as a query file and read again."""
    path, r = scratch(spark, "ranges"), F.col("n_regionkey").cast("double")
    points.write_range_queries(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.array(r, F.lit(0.5)).alias("lo"), F.array(r + 2, F.lit(7.25)).alias("hi")), path)
    return points.read_range_queries(spark, path).select("qid", F.col("lo")[0].alias("a"), F.col("lo")[1].alias("b"), F.col("hi")[0].alias("c"), F.col("hi")[1].alias("d"))


@query("select qid, x, y from (select n_nationkey::bigint as qid, n_regionkey::double as x, n_nationkey / 4.0::double as y from nation) where qid < 10")
def knn_file(spark, sf_dir):
    """Query points written and read again, up to the cap of a batch."""
    path = scratch(spark, "queries")
    points.write_matrix(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.col("n_regionkey").cast("double"), F.col("n_nationkey") / 4.0).alias("coords")), path)
    return points.read_knn_queries(spark, path).filter("qid < 10").select("qid", F.col("q")[0].alias("x"), F.col("q")[1].alias("y"))


@query("select * from (values (0, 8::bigint, 1::bigint, 0::bigint), (1, 40, 8, 0), (2, 1000, 40, 0)) t(level, n, parents, outside)")
def made_levels(spark, sf_dir):
    """A made hierarchy: sizes, distinct parents, and points beyond the bounds."""
    out = []
    for i, t in enumerate(points.synthetic(spark, 1000, 2, 1, 100, [25, 5], whole=True)):
        outside = F.count_if(F.exists("coords", lambda x: (x < 1) | (x > 100) | (x != F.round(x))))
        out.append(t.agg(F.lit(i).alias("level"), F.count("*").alias("n"), F.countDistinct(F.coalesce("parent_id", F.lit(-1))).alias("parents"), outside.alias("outside")))
    return out[0].unionByName(out[1]).unionByName(out[2])


_PAR = "select p_partkey * 10 as time_us, ln(p_size + 1.5::double) as v, p_size as c from part"


@query(f"""with q as ({_PAR}), m as (select median(v) as v from q) select 'part' as "Dataset", '7' as "Size", '2' as "Dim", 'RANGE' as "Query Type", '5%' as "Query Parameter", (count(*) - 2)::varchar as "Query Count",
printf('%.3f', (sum(time_us) - max(time_us) - min(time_us)) / 1000.0::double) as "Total Time (ms)", printf('%.6f', (sum(time_us) - max(time_us) - min(time_us)) / 1000.0::double / (count(*) - 2)) as "Avg Time (ms)", 'spark' as "Memory Policy",
printf('%.3f', (select v from m)) as "Median Log Volume", printf('%.2f', pow(10::double, (select v from m) / ln(10::double) - floor((select v from m) / ln(10::double)))) || 'E+' || floor((select v from m) / ln(10::double))::int as "Avg Range Volume",
printf('%.1f', avg(c)) as "Avg Fine Mesh" from q""")
def batch_log(spark, sf_dir):
    """A batch's row of the log, appended to its folder and read again."""
    q = table(spark, sf_dir, "part").select((F.col("p_partkey") * 10).alias("time_us"), F.ln(F.col("p_size") + 1.5).alias("log_volume"), F.col("p_size").alias("candidates"))
    path = scratch(spark, "log")
    append_statistics(stats.log_rows(stats.batch_statistics(q), "part", 7, 2, "RANGE", "5%", "spark"), path)
    return spark.read.option("header", True).csv(path)


# Events as sensor records: the sequence is the user's, the type the kind of event, the payload its properties.
_KINDS = ["click", "error", "purchase", "signup", "view"]
_BUILT: dict[tuple, sensors.SensorIndex] = {}


def _sensor_records(spark, sf_dir) -> DataFrame:
    kind = F.array_position(F.array(*[F.lit(k) for k in _KINDS]), F.col("event_type")).cast("int") - 1
    us, seq = timecode.timestamp_to_us(F.col("ts")), (F.col("user_id") % 256).cast("int")
    names = F.array(*[F.lit(n) for n in sensors.TYPES])
    # As text, in the order of the ids, whatever long they are.
    path = F.coalesce(F.lpad((F.col("event_id").cast("decimal(20,0)") + F.lit(Decimal(1 << 63))).cast("string"), 20, "0"), F.lit("null"))
    return table(spark, sf_dir, "events").select(
        seq.alias("seq"), F.format_string("seq%04d", seq).alias("seq_name"), F.get(names, kind).alias("dtype"), kind.alias("dtype_id"), (us / 1e6).alias("ts"), us.alias("ts_us"),
        F.octet_length("props").cast("long").alias("size"), path.alias("path"), F.encode("props", "UTF-8").alias("payload"),
    )


def _sensors(spark, sf_dir) -> sensors.SensorIndex:
    """The events' index, of groups of four, built once for a session, a folder and the files that it holds: other files, another index."""
    files = table(spark, sf_dir, "events").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    key = (spark.sparkContext.applicationId, sf_dir, *files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first())
    if key not in _BUILT:
        path = scratch(spark, "sensors")
        sensors.build(_sensor_records(spark, sf_dir), path, 4)
        _BUILT[key] = sensors.SensorIndex(spark, path)
    return _BUILT[key]


# 147 is the size of a header: vector, slots, type, four times, sequence, name, place, five offsets.
_IX = """r as (select event_id, (user_id % 256)::int as seq, case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as dtype_id, epoch_us(ts) as ts_us, strlen(props)::bigint as size, props from events),
p as (select *, row_number() over (partition by seq, dtype_id order by ts_us, event_id) - 1 as pos from r), c as (select *, pos // 4 as chunk, (pos % 4)::int as slot from p),
g as (select seq, dtype_id, chunk, count(*)::int as valid_count, min(ts_us) as first_us, max(ts_us) as last_us, sum(ts_us::hugeint) / count(*) as mean, sum(size)::bigint as bytes from c group by all),
n as (select *, row_number() over (order by seq, mean, dtype_id, chunk) - 1 as item_no from g),
i as (select *, coalesce(sum(147 + bytes) over (order by item_no rows between unbounded preceding and 1 preceding), 0)::bigint as base from n),
z as (select item_no, i.seq, i.dtype_id, c.slot, ts_us, size, base + 147 + coalesce(sum(size) over (partition by item_no order by c.slot rows between unbounded preceding and 1 preceding), 0)::bigint as payload_offset, props
  from i join c on i.seq = c.seq and i.dtype_id = c.dtype_id and i.chunk = c.chunk)"""
_IN = f"seq in (3, 8, 21) and ts_us between {_AT_US} and {_AT_US + 400_000_000_000}"
_RANGE = ([3, 8, 21], _AT_US / 1e6, _AT_US / 1e6 + 400_000)


@query(f"with {_IX} select item_no, seq, dtype_id, valid_count, 4 as slot_count, base as index_copy_offset, base + 147 as data_base_offset, bytes, 'data_0000.bin' as file_name from i")
def sensor_lines(spark, sf_dir):
    """All lines of the index, counted and checked."""
    return _sensors(spark, sf_dir).lines().select("item_no", "seq", "dtype_id", "valid_count", "slot_count", "index_copy_offset", "data_base_offset", F.element_at("data_offsets", -1).alias("bytes"), "file_name")


@query(f"with {_IX} select item_no, ((mean::bigint >> 42) & 2097151)::double + 1 as l0, seq::double as l3 from i")
def sensor_vectors(spark, sf_dir):
    """The first and last coordinate of each group's index vector."""
    v = F.col("index_vector")
    return _sensors(spark, sf_dir).lines().select("item_no", F.get(v, F.lit(0)).alias("l0"), F.get(v, F.lit(3)).alias("l3"))


@query(f"with {_IX}, s as (select item_no, last_us, unnest(range(4))::int as slot, base + 147 + bytes as past from i) select s.item_no, s.slot, coalesce(z.ts_us, last_us) as ts_us, coalesce(z.size, 0) as size, coalesce(z.payload_offset, past) as payload_offset from s left join z on s.item_no = z.item_no and s.slot = z.slot")
def sensor_slots(spark, sf_dir):
    return _sensors(spark, sf_dir).records().select("item_no", "slot", "ts_us", "size", "payload_offset")


@query(f"with {_IX}, t as (select item_no, slot, ts_us, abs(ts_us - {_AT_US}) as diff_us, payload_offset from z where seq = 8 order by diff_us, ts_us, item_no, slot limit 10) select *, (row_number() over (order by diff_us, ts_us, item_no, slot) - 1)::int as rnk from t")
def sensor_index_knn(spark, sf_dir):
    """The nearest through the index: pruned groups, their lines, their slots."""
    return _sensors(spark, sf_dir).knn(8, _AT_US / 1e6, 10).select("item_no", "slot", "ts_us", "diff_us", "payload_offset", "rnk")


@query(f"with {_IX} select item_no, seq, slot, ts_us from z where {_IN}")
def sensor_index_range(spark, sf_dir):
    return _sensors(spark, sf_dir).range(*_RANGE).select("item_no", "seq", "slot", "ts_us")


@query(f"with {_IX} select item_no, seq from i where seq in (3, 8, 21) and first_us <= {_AT_US + 400_000_000_000} and last_us >= {_AT_US}")
def sensor_candidates(spark, sf_dir):
    """The lines of the groups that a range may touch."""
    ix = _sensors(spark, sf_dir)
    return ix.candidate_lines(ix.range_candidates(*_RANGE)).select("item_no", "seq")


@query(f"with {_IX} select item_no, slot, props as payload from z where {_IN}")
def sensor_payloads(spark, sf_dir):
    """Payloads of a range, read from the data files."""
    ix = _sensors(spark, sf_dir)
    return ix.with_payload(ix.range(*_RANGE)).select("item_no", "slot", F.decode("payload", "UTF-8").alias("payload"))


@query(f"with {_IX} select count(*) as items, 0::bigint as faulty from i")
def sensor_verify(spark, sf_dir):
    """Headers in the data files that aren't what their lines say."""
    ix = _sensors(spark, sf_dir)
    return ix.lines().agg(F.count("*").alias("items")).join(F.broadcast(ix.verify().agg(F.count("*").alias("faulty"))))


@query(f"""with {_IX}, k as (select * from i where seq in (3, 8, 21) and first_us <= {_AT_US + 400_000_000_000} and last_us >= {_AT_US})
select (select count(*) from k) as candidate_count, (select count(*) from k) as record_count, (select sum(valid_count)::bigint from k) as slot_count, (select count(*) from z where {_IN}) as match_count""")
def sensor_counts(spark, sf_dir):
    ix = _sensors(spark, sf_dir)
    got = ix.counts(ix.range(*_RANGE), ix.range_candidates(*_RANGE), _RANGE[0])
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} long" for k in got))


@query(f"""with {_IX}, t as (select *, abs(ts_us - {_AT_US}) as diff_us from z where seq = 8 order by diff_us, ts_us, item_no, slot limit 10), u as (select *, row_number() over (order by diff_us, ts_us, item_no, slot) - 1 as rnk from t)
select printf('match_%04d_item%08d_slot%03d_seq%04d_dtype%d_%d_%06d', rnk, item_no, slot, seq, dtype_id, ts_us // 1000000, ts_us % 1000000) || case dtype_id when 0 then '.png' when 4 then '.coord.bin' else '.npy' end as name, size as bytes from u""")
def sensor_dump(spark, sf_dir):
    """The files that the nearest are written to, one each."""
    ix = _sensors(spark, sf_dir)
    return ix.dump(ix.knn(8, _AT_US / 1e6, 10), scratch(spark, "dump"))


@query(f"with {_IX} select count(*) as index_record_count, 4::bigint as group_size, 32::bigint as name_bytes, 147::bigint as record_size, '<4dBB4dB32sQ5Q' as header from i")
def sensor_meta(spark, sf_dir):
    m = _sensors(spark, sf_dir).meta
    row = (m["index_record_count"], m["group_size_N"], m["file_name_bytes"], m["binary_index_record_size"], m["binary_index_struct_format"])
    return spark.createDataFrame([row], "index_record_count long, group_size long, name_bytes long, record_size long, header string")


@query(f"with {_IX}, f as (select item_no, base + 147 + bytes as after from i) select 'data_0000.bin' as data_file, max(after)::bigint as bytes, count(*) as items from f")
def sensor_files(spark, sf_dir):
    """The data files and how long they are."""
    ix = _sensors(spark, sf_dir)
    sizes = [(f, packed.file_size(f"{ix.path}/{f}")) for f in ix.meta["data_files"]]
    return spark.createDataFrame(sizes, "data_file string, bytes long").join(F.broadcast(ix.raw.agg(F.count("*").alias("items"))))


@query("select n_nationkey::int as seq, 1700000000000000 + n_nationkey * 1000001 as ts_us, 32::bigint as size, 4 as dtype_id from nation")
def coordinate_file(spark, sf_dir):
    """A coordinate table in CSV: quoted positions, columns in another order, one too many."""
    path, k = scratch(spark, "coords"), F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.lit(7).alias("Classification"), F.concat(F.lit("["), k.cast("string"), F.lit(", 2.5, -3]")).alias("Position"), F.format_string("seq%04d", k).alias("Sequence"), F.format_string("%.6f", 1700000000 + k * 1.000001).alias("Timestamp"), F.lit('a "quoted" one').alias("more"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return sensors.read_coords(spark, path).select("seq", "ts_us", "size", "dtype_id")


@query("select (n_nationkey % 3)::int as seq, case n_regionkey % 2 when 0 then 0 else 2 end as dtype_id, 1700000000000000 + n_nationkey * 500000 as ts_us, strlen(case when n_nationkey = 4 then '' else n_name end)::bigint as size from nation")
def sensor_tree(spark, sf_dir):
    """A tree of sensor files, one of them empty, and others that aren't meant."""
    root = scratch(spark, "tree")
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows
        folder, ending = ("Image", ".PNG") if r.n_regionkey % 2 == 0 else ("livox_avia", ".npy")
        packed.text_file(spark, f"{root}/seq{r.n_nationkey % 3:03d}/{folder}/{1700000000 + r.n_nationkey * 0.5:.1f}{ending}", "" if r.n_nationkey == 4 else r.n_name)
    for other in ("seq1/Image/5.npy", "seq1/other/5.png", "more/Image/5.png"):
        packed.text_file(spark, f"{root}/{other}", "x")
    return sensors.read_tree(spark, root).select("seq", "dtype_id", "ts_us", "size")


@query("""select seq, dtype_id, ts_us, size from (select (user_id % 256)::int as seq, case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as dtype_id, epoch_us(ts) as ts_us, strlen(props)::bigint as size from events)
union all select (p_partkey % 256)::int, 4, p_partkey * 1000000, 32::bigint from part""")
def record_union(spark, sf_dir):
    """Records of files and of a coordinate table together."""
    k = F.col("p_partkey")
    coords = table(spark, sf_dir, "part").select((k % 256).cast("int").alias("seq"), F.lit(4).alias("dtype_id"), timecode.seconds_to_us(k.cast("double")).alias("ts_us"), F.octet_length(sensors.pack_coord(F.col("p_retailprice"), F.col("p_retailprice"), F.col("p_retailprice"), (k % 256).cast("int"))).cast("long").alias("size"))
    return _sensor_records(spark, sf_dir).select("seq", "dtype_id", "ts_us", "size").unionByName(coords)


# Requests to the services, and the status of their answers.
_REQUESTS = [
    ("points", "POST", "/query", "not json", 400), ("points", "POST", "/query", "[1]", 400), ("points", "POST", "/query", "{}", 400), ("points", "POST", "/query", '{"dataset_name": "../x", "query_type": "KNN"}', 400), ("points", "POST", "/query", '{"dataset_name": "x", "query_type": "NEAR"}', 400),
    ("points", "POST", "/query", '{"dataset_name": "x", "query_type": "knn"}', 400), ("points", "GET", "/datasets", "", 200), ("points", "POST", "/datasets", "", 200), ("points", "POST", "/build-index", '{"dataset_name": "x"}', 400), ("points", "GET", "/nowhere", "", 404),
    ("sensors", "POST", "/query", '{"dataset_name": "x", "seq": true}', 400), ("sensors", "POST", "/query", '{"dataset_name": "x", "seq": 256}', 400), ("sensors", "POST", "/query", '{"dataset_name": "x", "seq": ["seq1", 2, []]}', 400), ("sensors", "POST", "/query", '{"dataset_name": "x", "seq": "1,2", "timestamp": 5}', 400),
    ("sensors", "POST", "/query", '{"dataset_name": "x", "seq": ["seq1"], "timestamp": "5"}', 400), ("sensors", "POST", "/query", '{"dataset_name": "x", "seq": 1, "timestamp": 5, "knn_k": -1}', 400), ("sensors", "POST", "/query", '{"dataset_name": "x", "seq": 1, "timestamp": 5}', 404),
    ("sensors", "POST", "/query", '{"dataset_name": "x", "seq": "seq0001", "mode": "range", "start": 5, "end": 4}', 400), ("sensors", "GET", "/payload?dataset_name=x&data_file=d&offset=1", "", 400), ("sensors", "GET", "/payload?dataset_name=x&data_file=d&offset=-1&size=2", "", 400), ("sensors", "GET", "/payload?dataset_name=x&data_file=d&offset=1&size=2", "", 404),
    ("sensors", "POST", "/payload", '{"dataset_name": "x", "data_file": "..", "offset": 1, "size": 2}', 400), ("sensors", "POST", "/build-index", '{"dataset_name": "x", "dataset_root": "r", "csv_path": "c", "max_data_file_size": "5 tb"}', 400), ("sensors", "GET", "/datasets", "", 200),
]


@query("select * from (values " + ", ".join(f"({i}, {r[4]})" for i, r in enumerate(_REQUESTS)) + ") t(request, status)")
def request_checks(spark, sf_dir):
    root = scratch(spark, "service")
    services = {"points": PointService(spark, root), "sensors": SensorService(spark, root)}
    got = [(i, services[kind].answer(method, path, body.encode())[0]) for i, (kind, method, path, body, _) in enumerate(_REQUESTS)]
    return spark.createDataFrame(got, "request int, status int")
