"""One query for each operator, and the same in SQL.

The runs are made from orders: logl is a Gaussian in the total price, and each
row is the child of the row N ranks before it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import evidence as ev
from ..operators import ordertest as ot
from ..operators import posterior as po
from ..operators import reactive as rv
from ..operators import region as rg
from ..operators import strategy as st
from ..operators import warmstart as ws
from ..operators.ordered import range_partitioned, ranked, running_sum
from ..sources import points_from, read

N = 400
LOGL = "-0.5D*pow((o_totalprice-250000D)/50000D, 2D)"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _points(spark: SparkSession, sf: str, roots: int = N, ragged: bool = False) -> DataFrame:
    cols = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderdate")
    return points_from(cols, "o_orderkey", F.expr(LOGL), roots, ragged)


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """The same run with the columns that its evidence needs."""
    cols = read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    return points_from(cols, "o_orderkey", F.expr(LOGL), N).select("point_id", "logl", "parent_id", "root_id")


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _run_sql(roots: int = N, ragged: bool = False, logl: str = "-0.5*pow((o_totalprice-250000)/50000,2)") -> str:
    parent = f"CASE WHEN rk > {roots} THEN rk - {roots} END"
    if ragged:
        parent = f"CASE WHEN rk > n // 2 THEN rk - {roots // 2} WHEN rk > {roots} THEN rk - {roots} END"
    return f"""
    o AS (SELECT o_orderkey AS point_id, o_custkey, o_totalprice::DOUBLE AS o_totalprice, o_orderdate, {logl} AS logl FROM orders),
    r AS (SELECT *, row_number() OVER (ORDER BY logl, point_id) AS rk, count(*) OVER () AS n FROM o),
    pa AS (SELECT *, {parent} AS prk, (rk - 1) % {roots} AS root_id FROM r),
    ch AS (SELECT prk AS rk, count(*) AS nchild FROM pa WHERE prk IS NOT NULL GROUP BY prk),
    l0 AS (SELECT pa.*, coalesce(ch.nchild, 0) AS nchild FROM pa LEFT JOIN ch USING (rk)),
    l AS (SELECT *, (SELECT count(*) FROM pa WHERE prk IS NULL)
           + coalesce(sum(nchild - 1) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nlive FROM l0),
    s AS (SELECT *, CASE WHEN nchild = 0 THEN ln(greatest(1 - 1e0 / nlive, 1e-300)) ELSE -1e0 / nlive END AS step FROM l),
    v AS (SELECT *, coalesce(sum(step) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS logvol FROM s),
    w AS (SELECT *, logvol + CASE WHEN nchild = 0 THEN -ln(nlive) ELSE ln(1 - exp(-1e0 / nlive)) END AS logw FROM v),
    z AS (SELECT *, logw + logl AS logwt, max(logw + logl) OVER () AS peak FROM w),
    zz AS (SELECT *, exp(logwt - peak) AS e FROM z),
    t AS (SELECT max(peak) + ln(sum(e)) AS logz FROM zz)"""


SUMMARY = "SELECT count(*) AS n, round(max(peak) + ln(sum(e)), 6) AS logz, round(sum(e) * sum(e) / sum(e * e), 4) AS ess FROM zz"


def _summary(p: DataFrame) -> DataFrame:
    return ev.summary(ev.weighted(p)).select("n", _r(F.col("logz")).alias("logz"), _r(F.col("ess"), 4).alias("ess"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence, its error and the posterior of the total price, from one table of points."""
    p = _points(spark, sf, 100)
    w = ev.weighted(p)
    weights = ev.with_peak(w).withColumn("weight", F.exp(F.col("logwt") - F.col("peak")))
    post = po.moments(weights, ["o_totalprice"]).select("mean", "stdev")
    return ev.summary(w).join(F.broadcast(post))


@query(f"WITH {_run_sql()} {SUMMARY}")
def evidence_static(spark, sf):
    return _summary(_points(spark, sf))


@query(f"WITH {_run_sql(N, True)} {SUMMARY}")
def evidence_ragged(spark, sf):
    return _summary(_points(spark, sf, N, True))


@query(f"WITH {_run_sql()} SELECT rk AS iter, point_id, round(logl, 6) + 0.0 AS logl, nlive::BIGINT AS nlive, round(logvol, 6) AS logvol, round(logwt, 6) AS logwt, nchild = 0 AS is_tail, round(peak + ln(sum(e) OVER (ORDER BY rk)), 6) AS logz FROM zz")
def evidence_sequence(spark, sf):
    s = ev.running_evidence(ev.weighted(_points(spark, sf)))
    return s.select(F.col("rk").alias("iter"), "point_id", (_r("logl") + 0.0).alias("logl"), "nlive", _r("logvol").alias("logvol"), _r("logwt").alias("logwt"), (F.col("nchild") == 0).alias("is_tail"), _r("logz").alias("logz"))


@query(f"WITH {_run_sql(N, True)} SELECT point_id, nlive::BIGINT AS nlive FROM l")
def live_count_sweep(spark, sf):
    """Live points by the sweep over births alone; ties in logl are broken by making births unique."""
    p = _points(spark, sf, N, True)
    r = ranked(p, "logl", "point_id").drop("__part")
    rank = r.select(F.col("point_id").alias("parent_id"), F.col("rk").cast("double").alias("brk"))
    u = r.join(rank, "parent_id", "left").select("point_id", F.col("rk").cast("double").alias("logl"), F.col("brk").alias("birth"))
    return ev.live_points_from_births(u).select("point_id", F.col("nlive").cast("long").alias("nlive"))


@query(f"WITH {_run_sql(N, True)} SELECT count(*) AS n, max(nlive)::BIGINT AS max_nlive, count(*) FILTER (logl BETWEEN -4 AND -1) AS n_between, (max(nlive) FILTER (logl BETWEEN -4 AND -1))::BIGINT AS max_nlive_between FROM l")
def run_width(spark, sf):
    w = ev.live_points(_points(spark, sf, N, True))
    return ev.width_between(w, -4.0, -1.0).select("n", F.col("max_nlive").cast("long").alias("max_nlive"), "n_between", F.col("max_nlive_between").cast("long").alias("max_nlive_between"))


_H = "SELECT sum(e * logl) / sum(e) - (max(peak) + ln(sum(e))) AS h FROM zz WHERE nchild > 0"


@query(f"WITH {_run_sql()} SELECT round(h, 6) AS h FROM ({_H})")
def information_h(spark, sf):
    return ev.summary(ev.weighted(_points(spark, sf))).select(_r("h").alias("h"))


@query(f"""WITH {_run_sql()}, h AS ({_H}), b AS (SELECT sqrt(h / {N}) AS single FROM h), f AS (SELECT sum(e) FILTER (nchild = 0) / sum(e) AS tail FROM zz)
SELECT round((SELECT logz FROM t), 6) AS logz, round(single, 6) AS logzerr_single, round(ln(1 + tail), 6) AS logzerr_tail, round(sqrt(single * single + ln(1 + tail) * ln(1 + tail)), 6) AS logzerr FROM b, f""")
def logz_error_budget(spark, sf):
    w = ev.weighted(_points(spark, sf))
    e = F.exp(F.col("logwt") - F.col("peak"))
    tail = ev.with_peak(w).agg((F.sum(F.when(F.col("nchild") == 0, e)) / F.sum(e)).alias("tail"))
    s = ev.summary(w).join(F.broadcast(tail))
    out = ev.error_budget(s, F.col("logzerr_single"), F.col("tail"))
    return out.select(*[_r(c).alias(c) for c in ("logz", "logzerr_single", "logzerr_tail", "logzerr")])


def _boot(spark, n: int = 8) -> DataFrame:
    """Deterministic masks: bootstrap 0 has all roots, the others about two thirds."""
    b = spark.range(n).select(F.col("id").cast("int").alias("boot_id")).join(F.broadcast(spark.range(N).select(F.col("id").alias("root_id"))))
    return b.where("boot_id = 0 OR ((root_id * 1103515245 + boot_id * 12345 + 12345) % 2147483648) % 1000 < 632")


_BOOT = f"""b AS (SELECT b.i::INT AS boot_id, r.i AS root_id FROM range(8) b(i), range({N}) r(i)
     WHERE b.i = 0 OR ((r.i * 1103515245 + b.i * 12345 + 12345) % 2147483648) % 1000 < 632),
 bl AS (SELECT b.boot_id, l0.*, count(*) FILTER (prk IS NULL) OVER (PARTITION BY boot_id)
    + coalesce(sum(nchild - 1) OVER (PARTITION BY boot_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nl FROM l0 JOIN b USING (root_id)),
 bs AS (SELECT *, CASE WHEN nchild = 0 THEN ln(greatest(1 - 1e0 / nl, 1e-300)) ELSE -1e0 / nl END AS step FROM bl),
 bv AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY boot_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lv FROM bs),
 bw AS (SELECT *, logl + lv + CASE WHEN nchild = 0 THEN -ln(nl) ELSE ln(1 - exp(-1e0 / nl)) END AS bwt FROM bv),
 bz AS (SELECT boot_id, count(*) AS n, max(bwt) + ln(sum(exp(bwt - mx))) AS bz FROM (SELECT *, max(bwt) OVER (PARTITION BY boot_id) AS mx FROM bw) GROUP BY boot_id)"""


@query(f"WITH {_run_sql()}, {_BOOT} SELECT boot_id, n, round(bz, 6) AS logz FROM bz")
def bootstrap_evidence(spark, sf):
    return ev.bootstrap_totals(_tree(spark, sf), _boot(spark)).select("boot_id", "n", _r("logz").alias("logz"))


@query(f"WITH {_run_sql()}, {_BOOT} SELECT round(avg(bz), 6) AS logz_bs, round(stddev_pop(bz), 6) AS logz_bs_std, round(max(bz - (SELECT logz FROM t)), 6) AS logzerr_bs FROM bz WHERE boot_id > 0")
def bootstrap_error(spark, sf):
    """Bootstrap 0 has all roots, so it is the whole run."""
    z = ev.bootstrap_totals(_tree(spark, sf), _boot(spark))
    part, whole = F.when(F.col("boot_id") > 0, F.col("logz")), F.max(F.when(F.col("boot_id") == 0, F.col("logz")))
    return z.agg(_r(F.avg(part)).alias("logz_bs"), _r(F.stddev_pop(part)).alias("logz_bs_std"), _r(F.max(part) - whole).alias("logzerr_bs"))


@query(f"WITH {_run_sql()}, {_BOOT} SELECT boot_id, round(sum(exp(bwt - bz) * (bwt - bz - (zz.logwt - t.logz))), 6) AS kl FROM bw JOIN bz USING (boot_id) JOIN zz USING (point_id), t WHERE boot_id > 0 GROUP BY boot_id")
def bootstrap_kl(spark, sf):
    p = _tree(spark, sf)
    b = ev.bootstrap_evidence(p, _boot(spark).where("boot_id > 0"))
    return ev.bootstrap_kl(ev.weighted(p), b).select("boot_id", _r("kl").alias("kl"))


def _weighted(spark, sf) -> DataFrame:
    w = ev.with_peak(ev.weighted(_points(spark, sf)))
    return w.withColumn("weight", F.exp(F.col("logwt") - F.col("peak")))


@query(f"""WITH {_run_sql()} SELECT param, round(sum(e * x) / sum(e), 4) AS mean, round(sqrt(sum(e * x * x) / sum(e) - pow(sum(e * x) / sum(e), 2)), 4) AS stdev
FROM (SELECT e, unnest(['o_totalprice', 'o_custkey']) AS param, unnest([o_totalprice, o_custkey::DOUBLE]) AS x FROM zz) GROUP BY param""")
def posterior_moments(spark, sf):
    return po.moments(_weighted(spark, sf), ["o_totalprice", "o_custkey"]).select("param", _r("mean", 4).alias("mean"), _r("stdev", 4).alias("stdev"))


@query(f"""WITH {_run_sql()}, c0 AS (SELECT o_totalprice AS x, row_number() OVER q AS k, coalesce(sum(e) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM zz WINDOW q AS (ORDER BY o_totalprice, point_id)),
 c1 AS (SELECT x, c / max(c) OVER () AS c, lead(x) OVER (ORDER BY k) AS x1, lead(c / m) OVER (ORDER BY k) AS cn FROM (SELECT *, max(c) OVER () AS m FROM c0))
SELECT q, round(x + (x1 - x) * (q - c) / (cn - c), 4) AS value FROM c1, (VALUES (0.158655::DOUBLE), (0.5), (0.841345)) qs(q) WHERE cn > c AND c <= q AND q < cn""")
def weighted_quantiles(spark, sf):
    return po.weighted_quantiles(_weighted(spark, sf), "o_totalprice", "weight", "point_id", [0.158655, 0.5, 0.841345]).select("q", _r("value", 4).alias("value"))


@query(f"""WITH {_run_sql()}, p AS (SELECT point_id, rk, e / sum(e) OVER () AS p FROM zz), c AS (SELECT *, sum(p) OVER (ORDER BY rk) AS c FROM p)
SELECT count(*) FILTER (copies > 0) AS rows_kept, sum(copies)::BIGINT AS total, max(copies) AS most, sum(copies * (point_id % 97))::BIGINT AS fingerprint
FROM (SELECT point_id, (ceil(round(1000 * c - 0.5, 9)) - ceil(round(1000 * (c - p) - 0.5, 9)))::BIGINT AS copies FROM c)""")
def resample_counts(spark, sf):
    w = _weighted(spark, sf).select("point_id", "logl", "weight")
    total = w.agg(F.sum("weight").alias("s"))
    p = w.join(F.broadcast(total)).select("point_id", "logl", (F.col("weight") / F.col("s")).alias("p"))
    r = po.resample_counts(p, "p", ["logl", "point_id"], F.lit(1000.0))
    return r.agg(F.count_if(F.col("copies") > 0).alias("rows_kept"), F.sum("copies").alias("total"), F.max("copies").alias("most"), F.sum(F.col("copies") * (F.col("point_id") % 97)).alias("fingerprint"))


@query(f"""WITH {_run_sql()}, u AS (SELECT e, (o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER () + 1) AS u FROM zz),
 h AS (SELECT least(floor(u * 39), 38)::INT AS bin, sum(e) AS w FROM u GROUP BY 1), b AS (SELECT i::INT AS bin FROM range(39) r(i))
SELECT round(sum(log2(1 / ((coalesce(w, 0) / (SELECT sum(w) FROM h) * 39 + 0.001) * 40)) / 40), 6) AS bits FROM b LEFT JOIN h USING (bin)""")
def information_gain(spark, sf):
    w = _weighted(spark, sf)
    ends = w.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    u = w.join(F.broadcast(ends)).withColumn("u", (F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1))
    return po.information_gain(u, ["u"], "weight").select(_r("bits").alias("bits"))


@query(f"WITH {_run_sql()} SELECT point_id, round(logl, 9) + 0.0 AS logl, o_totalprice FROM r ORDER BY r.logl DESC, point_id LIMIT 1")
def max_likelihood(spark, sf):
    return po.max_likelihood(_points(spark, sf), "o_totalprice").select("point_id", (_r("logl", 9) + 0.0).alias("logl"), "o_totalprice")


@query(f"""WITH {_run_sql()}, g AS (SELECT prk AS rk, sum(exp(logl - (SELECT max(logl) FROM o))) AS gain FROM pa WHERE prk IS NOT NULL GROUP BY prk),
 q AS (SELECT zz.*, peak + ln(sum(e) OVER (ORDER BY rk)) AS cz, (SELECT max(logl) FROM o) AS lm,
   (SELECT sum(exp(logl - (SELECT max(logl) FROM o))) FROM pa WHERE prk IS NULL)
   + coalesce(sum(coalesce(gain, 0) - exp(logl - (SELECT max(logl) FROM o))) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS live FROM zz LEFT JOIN g USING (rk))
SELECT rk AS iter, round(1 / (1 + exp(cz - (lm + ln(live) + logvol + step - ln(nlive)))), 6) AS remainder_fraction FROM q WHERE rk <= n - {N}""")
def remainder(spark, sf):
    r = ev.remainder(ev.weighted(_points(spark, sf)))
    return r.where("nchild > 0").select(F.col("rk").alias("iter"), _r("remainder_fraction").alias("remainder_fraction"))


_RANK = """rank_ AS (SELECT p.rk, count(b.rk) AS insert_rank, p.nlive FROM
   (SELECT l.rk, l.nlive, min(c.rk) AS c FROM l JOIN pa c ON c.prk = l.rk GROUP BY l.rk, l.nlive) p
   LEFT JOIN pa b ON b.rk > p.rk AND b.rk < p.c AND coalesce(b.prk, 0) < p.rk GROUP BY p.rk, p.nlive)"""


@query(f"WITH {_run_sql(100)}, {_RANK} SELECT rk AS iter, insert_rank, nlive::BIGINT AS nlive FROM rank_")
def insertion_rank(spark, sf):
    return ot.insertion_ranks(ev.live_points(_points(spark, sf, 100))).select(F.col("rk").alias("iter"), "insert_rank", F.col("nlive").cast("long").alias("nlive"))


@query(f"WITH {_run_sql(100)}, {_RANK} SELECT count(*) AS k, round((sum((insert_rank + 0.5) / nlive) - count(*) / 2e0) / sqrt(count(*) / 12e0), 5) AS z FROM rank_")
def insertion_zscore(spark, sf):
    r = ot.insertion_ranks(ev.live_points(_points(spark, sf, 100)))
    return ot.zscore_total(r, F.col("insert_rank"), F.col("nlive")).select("k", _r("z", 5).alias("z"))


@query("""WITH e AS (SELECT event_id, user_id, value, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS b FROM events),
 r AS (SELECT event_id, user_id, len(list_filter(b, lambda x: x < value)) AS rank, len(b) AS n FROM e WHERE b IS NOT NULL AND len(b) > 0)
SELECT user_id, count(*) AS k, round((sum((rank + 0.5) / (n + 1)) - count(*) / 2e0) / sqrt(count(*) / 12e0), 5) AS z FROM r GROUP BY user_id""")
def order_test_events(spark, sf):
    r = ot.preceding_rank(read(spark, sf, "events"), "value", ["ts", "event_id"], 50, "user_id").where("n > 0")
    k = F.count(F.lit(1))
    return r.groupBy("user_id").agg(k.alias("k"), _r((F.sum((F.col("rank") + 0.5) / (F.col("n") + 1)) - k / 2.0) / F.sqrt(k / 12.0), 5).alias("z"))


@query("""WITH s AS (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS a, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b FROM supplier)
SELECT x.s_nationkey, (SELECT count(*) FROM supplier q WHERE q.s_nationkey = x.s_nationkey) AS n, round(count(*) FILTER (x.b > y.b) * 2e0 / ((SELECT count(*) FROM supplier q WHERE q.s_nationkey = x.s_nationkey) * ((SELECT count(*) FROM supplier q WHERE q.s_nationkey = x.s_nationkey) - 1)), 6) AS distance
FROM s x JOIN s y ON x.s_nationkey = y.s_nationkey AND x.a < y.a GROUP BY x.s_nationkey""")
def kendall_tau(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey")
    s = read(spark, sf, "supplier").select("s_nationkey", F.row_number().over(w.orderBy("s_acctbal", "s_suppkey")).alias("a"), F.row_number().over(w.orderBy("s_suppkey")).alias("b"))
    return ot.kendall_distance(s, "a", "b", "s_nationkey").select("s_nationkey", "n", _r("distance").alias("distance"))


@query("SELECT c_custkey, round((c_acctbal + 500) / 9000, 6) AS u1, round(c_nationkey / 24e0, 6) AS u2 FROM customer WHERE (c_acctbal + 500) / 9000 > 0 AND (c_acctbal + 500) / 9000 < 1 AND c_nationkey / 24e0 > 0 AND c_nationkey / 24e0 < 1")
def unit_cube_filter(spark, sf):
    u = F.array((F.col("c_acctbal").cast("double") + 500) / 9000, F.col("c_nationkey") / 24.0)
    c = read(spark, sf, "customer").select("c_custkey", u.alias("u")).where(fn.within_unit_cube("u"))
    return c.select("c_custkey", _r(F.col("u")[0]).alias("u1"), _r(F.col("u")[1]).alias("u2"))


@query("SELECT p_partkey FROM (SELECT p_partkey, p_size / 51e0 - 0.5 AS a, (p_retailprice - 900) / 1200e0 - 0.5 AS b FROM part) WHERE 12 * a * a + 2 * 3 * a * b + 9 * b * b <= 2")
def ellipsoid_filter(spark, sf):
    u = F.array(F.col("p_size") / 51.0, (F.col("p_retailprice").cast("double") - 900) / 1200.0)
    return read(spark, sf, "part").where(fn.inside_ellipsoid(u, [0.5, 0.5], [[12.0, 3.0], [3.0, 9.0]], 2.0)).select("p_partkey")


def _cloud(spark, sf) -> DataFrame:
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_acctbal").cast("double") + 1000) / 11000).alias("x"), ((F.col("s_suppkey") * 37 % 101) / 101.0).alias("y"))


_CLOUD = "c AS (SELECT s_suppkey AS id, (s_acctbal::DOUBLE + 1000) / 11000 AS x, (s_suppkey * 37 % 101) / 101e0 AS y FROM supplier)"
_NEAR = f"{_CLOUD}, nb AS (SELECT b.id AS b_id, a.id AS a_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy FROM c a JOIN c b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.05 * 0.05)"


def _part_cloud(spark, sf) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 51.0).alias("x"), ((F.col("p_retailprice").cast("double") - 900) / 1200).alias("y"))


_NEAR_PARTS = f"""{_CLOUD}, pc AS (SELECT p_partkey AS id, p_size / 51e0 AS x, (p_retailprice::DOUBLE - 900) / 1200 AS y FROM part),
 nb AS (SELECT b.id AS b_id, a.id AS a_id FROM pc a JOIN c b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.05 * 0.05)"""


@query(f"WITH {_NEAR} SELECT b_id, count(*) AS n FROM nb GROUP BY b_id")
def neighbour_count(spark, sf):
    c = _cloud(spark, sf)
    return rg.count_neighbours(c.withColumnRenamed("id", "a_id"), c.withColumnRenamed("id", "b_id"), 0.05, ["x", "y"])


@query(f"WITH {_NEAR_PARTS} SELECT c.id AS b_id, coalesce(min(a_id), -1) AS a_id FROM c LEFT JOIN nb ON nb.b_id = c.id GROUP BY c.id")
def first_neighbour(spark, sf):
    c = _cloud(spark, sf)
    return rg.first_neighbour(_part_cloud(spark, sf).withColumnRenamed("id", "a_id"), c.withColumnRenamed("id", "b_id"), 0.05, ["x", "y"])


@query(f"WITH {_NEAR} SELECT b_id AS id, round(max(bx) - avg(ax), 6) AS x, round(max(byy) - avg(ay), 6) AS y FROM nb GROUP BY b_id")
def local_center(spark, sf):
    return rg.local_centres(_cloud(spark, sf), 0.05, ["x", "y"]).select("id", _r("x").alias("x"), _r("y").alias("y"))


def _split(spark, sf) -> DataFrame:
    c = _cloud(spark, sf).select("id")
    b = spark.range(8).select(F.col("id").cast("int").alias("boot_id"))
    return c.join(F.broadcast(b)).where("((id * 1103515245 + boot_id * 12345 + 12345) % 2147483648) % 1000 < 632")


@query(f"""WITH {_CLOUD}, k AS (SELECT b.i::INT AS boot_id, c.*, ((c.id * 1103515245 + b.i * 12345 + 12345) % 2147483648) % 1000 < 632 AS kept FROM c, range(8) b(i))
SELECT boot_id, round(max(sq), 9) AS maxsq FROM (SELECT o.boot_id, o.id, min((o.x - k.x) * (o.x - k.x) + (o.y - k.y) * (o.y - k.y)) AS sq FROM k o JOIN k ON k.boot_id = o.boot_id AND k.kept WHERE NOT o.kept GROUP BY o.boot_id, o.id) GROUP BY boot_id""")
def max_radius_bootstrap(spark, sf):
    return rg.max_radius_sq(_cloud(spark, sf), _split(spark, sf), ["x", "y"]).select("boot_id", _r("maxsq", 9).alias("maxsq"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT x.label, count(*) AS pairs, round(avg(list_distance(x.v, y.v)), 6) AS mean_distance FROM e x JOIN e y ON x.label = y.label AND x.vec_id < y.vec_id GROUP BY x.label""")
def mean_pair_distance(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return rg.mean_pair_distance(e, "label", "embedding").select("label", "pairs", _r("mean_distance").alias("mean_distance"))


@query(f"""WITH RECURSIVE {_NEAR}, walk AS (SELECT id, id AS other FROM c UNION SELECT walk.id, nb.a_id FROM walk JOIN nb ON nb.b_id = walk.other)
SELECT id, min(other) AS cluster FROM walk GROUP BY id""")
def clusters(spark, sf):
    return rg.clusters(_cloud(spark, sf), 0.05, ["x", "y"])


@query("""SELECT param, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS param, unnest([l_quantity::DOUBLE, l_extendedprice::DOUBLE / 1000, l_discount::DOUBLE]) AS x FROM lineitem) GROUP BY param""")
def scaling_layer(spark, sf):
    l = read(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), (F.col("l_extendedprice").cast("double") / 1000).alias("l_extendedprice"), F.col("l_discount").cast("double").alias("l_discount"))
    return rg.scaling_layer(l, l.columns).select("param", _r("mean").alias("mean"), _r("std").alias("std"))


@query("""WITH l AS (SELECT l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE / 1000 AS p, l_discount::DOUBLE AS d FROM lineitem)
SELECT 'q' AS i, 'q' AS j, round(covar_samp(q, q) * 5, 5) AS cov FROM l UNION ALL SELECT 'q', 'p', round(covar_samp(q, p) * 5, 5) FROM l UNION ALL SELECT 'q', 'd', round(covar_samp(q, d) * 5, 5) FROM l
UNION ALL SELECT 'p', 'p', round(covar_samp(p, p) * 5, 5) FROM l UNION ALL SELECT 'p', 'd', round(covar_samp(p, d) * 5, 5) FROM l UNION ALL SELECT 'd', 'd', round(covar_samp(d, d) * 5, 5) FROM l""")
def affine_cov(spark, sf):
    l = read(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), (F.col("l_extendedprice").cast("double") / 1000).alias("p"), F.col("l_discount").cast("double").alias("d"))
    return rg.bounding_covariance(l, ["q", "p", "d"]).select("i", "j", _r("cov", 5).alias("cov"))


_DAY = "(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400e0"
_GAP = f"""v AS (SELECT DISTINCT {_DAY} AS u FROM events UNION SELECT 0e0 UNION SELECT 1e0), g AS (SELECT u, lead(u) OVER (ORDER BY u) AS nx FROM v),
 gap AS (SELECT nx - u AS gap, (nx + u) / 2 AS cut FROM g WHERE nx IS NOT NULL ORDER BY round(nx - u, 12) DESC, u LIMIT 1)"""


def _circle(spark, sf) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select("event_id", ((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 86400.0).alias("u"))


@query(f"WITH {_GAP} SELECT round(gap, 9) AS gap, round(cut, 9) AS cut FROM gap")
def largest_gap(spark, sf):
    return rg.largest_gap(_circle(spark, sf), "u").select(_r("gap", 9).alias("gap"), _r("cut", 9).alias("cut"))


@query(f"SELECT event_id, round(({_DAY} + (1 - 0.3125)) % 1, 9) AS t, round((({_DAY} + (1 - 0.3125)) % 1 + 0.3125) % 1, 9) AS u FROM events")
def wrap_transform(spark, sf):
    c = _circle(spark, sf)
    return c.select("event_id", _r(fn.wrap("u", 0.3125), 9).alias("t"), _r(fn.unwrap(fn.wrap("u", 0.3125), 0.3125), 9).alias("u"))


@query(f"""WITH {_run_sql()}, u AS (SELECT point_id, e, unnest(['o_totalprice', 'o_custkey']) AS param, unnest([o_totalprice, o_custkey::DOUBLE]) AS u FROM zz),
 c AS (SELECT param, u, round(sum(e) OVER (PARTITION BY param ORDER BY u, point_id ROWS UNBOUNDED PRECEDING) / sum(e) OVER (PARTITION BY param), 9) AS c FROM u)
SELECT level, param, min(u) AS lo, max(u) AS hi FROM c, (VALUES (1e-1::DOUBLE), (1e-3), (1e-5)) q(level) WHERE c >= level AND c <= 1 - level GROUP BY level, param""")
def quantile_boxes(spark, sf):
    w = _weighted(spark, sf).withColumn("o_custkey", F.col("o_custkey").cast("double"))
    return ws.quantile_boxes(w, ["o_totalprice", "o_custkey"], "weight", "point_id", [1e-1, 1e-3, 1e-5])


@query(f"""WITH {_run_sql()}, n AS (SELECT logw - 0.5 * pow((o_totalprice - 245000) / 48000, 2) AS lw FROM zz), m AS (SELECT *, max(lw) OVER () AS mx FROM n)
SELECT count(*) AS n, round(max(mx) + ln(sum(exp(lw - mx))), 6) AS logz, round(pow(sum(exp(lw - mx)), 2) / sum(exp(2 * (lw - mx))), 4) AS ess FROM m""")
def importance_reuse(spark, sf):
    w = ev.weighted(_points(spark, sf))
    return ws.reuse(w, F.expr("-0.5D*pow((o_totalprice-245000D)/48000D, 2D)")).select("n", _r("logz").alias("logz"), _r("ess", 4).alias("ess"))


_BOXES = [(0, "a", 0.45, 0.55), (1, "a", 0.3, 0.7), (2, "a", 0.0, 1.0), (0, "b", 0.2, 0.25), (1, "b", 0.1, 0.5), (2, "b", 0.0, 1.0)]


@query(f"""WITH g AS (SELECT s_suppkey, (s_suppkey * 37 % 101) / 101e0 AS s, (s_suppkey * 53 % 97) / 97e0 AS u FROM supplier),
 b(step, param, lo, hi) AS (VALUES {", ".join(f"({s}, '{p}', {lo}::DOUBLE, {hi}::DOUBLE)" for s, p, lo, hi in _BOXES)}),
 j AS (SELECT g.*, b.param, s * 2 - floor(s * 2) AS f, b.lo, b.hi, c.lo AS lo1, c.hi AS hi1 FROM g JOIN b ON b.step = floor(s * 2) JOIN b c ON c.step = b.step + 1 AND c.param = b.param),
 k AS (SELECT *, lo + (lo1 - lo) * f AS l, hi + (hi1 - hi) * f AS h FROM j)
SELECT s_suppkey, param, round(l + (h - l) * u, 6) AS v, round(ln(h - l), 6) AS logweight FROM k""")
def contbox_transform(spark, sf):
    g = read(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37 % 101) / 101.0).alias("s"), ((F.col("s_suppkey") * 53 % 97) / 97.0).alias("u"))
    b = spark.createDataFrame(_BOXES, "step int, param string, lo double, hi double")
    return ws.through_boxes(g, b).select("s_suppkey", "param", _r("v").alias("v"), _r("logweight").alias("logweight"))


@query("""WITH u AS (SELECT c_custkey, (c_custkey * 37 % 997 + 0.5e0) / 997 AS a, (c_custkey * 53 % 991 + 0.5e0) / 991 AS b FROM customer)
SELECT c_custkey, round(-5 + 15 * a, 6) AS uniform, round(pow(10e0, -2 + 4 * a), 6) AS loguniform, round(1 + 2 * tan(pi() * (b - 0.5)), 5) AS cauchy, round(-ln(a) / (-ln(a) - ln(b)), 6) AS dirichlet1 FROM u""")
def prior_transforms(spark, sf):
    u = read(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") * 37 % 997 + 0.5) / 997.0).cast("double").alias("a"), ((F.col("c_custkey") * 53 % 991 + 0.5) / 991.0).cast("double").alias("b"))
    return u.select("c_custkey", _r(fn.uniform_prior("a", -5, 10)).alias("uniform"), _r(fn.log_uniform_prior("a", 0.01, 100)).alias("loguniform"), _r(fn.cauchy_prior("b", 1, 2), 5).alias("cauchy"), _r(fn.dirichlet_flat("a", "b")[0]).alias("dirichlet1"))


@query("""WITH j AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 10 AS r FROM events)
SELECT user_id, count(*) AS n, round(exp(avg(ln(r + 1e-10))), 5) AS mean_jump, round(avg((r > 1)::INT), 6) AS far_enough FROM j WHERE r IS NOT NULL GROUP BY user_id""")
def step_diagnostics(spark, sf):
    j = rg.jumps(read(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")
    return rg.jump_diagnostics(j, 10.0, "user_id").select("user_id", "n", _r("mean_jump", 5).alias("mean_jump"), _r("far_enough").alias("far_enough"))


@query("""SELECT x, round(quantile_cont(y, 0.16), 5) AS lo, round(quantile_cont(y, 0.5), 5) AS mid, round(quantile_cont(y, 0.84), 5) AS hi
FROM (SELECT x.i::INT AS x, s_acctbal::DOUBLE / 1000 + x.i * (s_suppkey % 7)::DOUBLE AS y FROM supplier, range(11) x(i)) GROUP BY x""")
def prediction_band(spark, sf):
    xs = spark.range(11).select(F.col("id").cast("int").alias("x"))
    y = read(spark, sf, "supplier").join(F.broadcast(xs)).select("x", (F.col("s_acctbal").cast("double") / 1000 + F.col("x") * (F.col("s_suppkey") % 7)).alias("y"))
    return y.groupBy("x").agg(*[_r(F.percentile("y", q), 5).alias(n) for n, q in (("lo", 0.16), ("mid", 0.5), ("hi", 0.84))])


@query(f"""WITH {_run_sql()}, u AS (SELECT e, o_totalprice / 600000 AS u FROM zz), h0 AS (SELECT least(floor(u * 60), 59)::INT AS bin, sum(e) AS m FROM u GROUP BY 1),
 h AS (SELECT i::INT AS bin, coalesce(m, 0) AS m FROM range(60) r(i) LEFT JOIN h0 ON h0.bin = r.i),
 q AS (SELECT *, coalesce(sum(m) OVER (ORDER BY m DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, sum(m) OVER () AS tt FROM h)
SELECT min(bin) AS lo_bin, max(bin) AS hi_bin, round(sum(m) / max(tt), 6) AS mass FROM q WHERE round(bf / tt, 9) < 0.68""")
def hdi_histogram(spark, sf):
    h = po.histogram(_weighted(spark, sf), F.col("o_totalprice") / 600000.0, F.col("weight"), 60)
    return po.highest_density(h, 0.68).select("lo_bin", "hi_bin", _r("mass").alias("mass"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2e0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2e0 AS b, p_partkey::DOUBLE AS c FROM part)
SELECT 'p_size' AS a, 'p_retailprice' AS b, round(corr(a, b), 6) AS rho FROM r UNION ALL SELECT 'p_partkey', 'p_retailprice', round(corr(c, b), 6) FROM r""")
def degeneracy(spark, sf):
    p = read(spark, sf, "part")
    return ot.spearman(p, [("p_size", "p_retailprice"), ("p_partkey", "p_retailprice")], "p_partkey").select("a", "b", _r("rho").alias("rho"))


@query(f"""WITH {_run_sql()}, q AS (SELECT rk AS seq, logl, lag(logl, {N}) OVER (ORDER BY rk) AS birth FROM r)
SELECT t.threshold, min(seq) AS seq FROM (SELECT (-i / 4e0)::DOUBLE AS threshold FROM range(1, 30) x(i)) t JOIN q ON coalesce(birth, '-infinity'::DOUBLE) <= threshold AND logl > threshold GROUP BY t.threshold""")
def interval_join_pop(spark, sf):
    stored = ranked(_points(spark, sf).drop("rk"), "logl", "point_id", name="seq")
    t = spark.range(1, 30).select((-F.col("id") / 4.0).alias("threshold"))
    return ws.usable_points(stored, t)


_PLAN = [(0.0, 10.0, 400), (2.0, 5.0, 800), (4.0, 8.0, 600), (1.0, 3.0, 500)]


@query(f"""WITH i(lo, hi, width) AS (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {w}::BIGINT)" for a, b, w in _PLAN)}), e AS (SELECT lo AS edge FROM i UNION SELECT hi FROM i),
 o AS (SELECT edge, coalesce(max(width), 0) AS w FROM e LEFT JOIN i ON lo <= edge AND edge < hi GROUP BY edge)
SELECT edge, least(max(w) OVER (ORDER BY edge), max(w) OVER (ORDER BY edge DESC))::BIGINT AS width FROM o""")
def width_sequence(spark, sf):
    return ws.width_steps(spark.createDataFrame(_PLAN, "lo double, hi double, width long"))


@query(f"""SELECT round(a - b, 6) AS log_bayes_factor FROM (WITH {_run_sql()} SELECT logz AS a FROM t), (WITH {_run_sql(N, False, "-0.5*pow((o_totalprice-200000)/60000,2)")} SELECT logz AS b FROM t)""")
def bayes_factor(spark, sf):
    a = ev.summary(ev.weighted(_points(spark, sf))).select(F.col("logz").alias("a"))
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    b = ev.summary(ev.weighted(points_from(o, "o_orderkey", F.expr("-0.5D*pow((o_totalprice-200000D)/60000D, 2D)"), N))).select(F.col("logz").alias("b"))
    return a.join(F.broadcast(b)).select(_r(F.col("a") - F.col("b")).alias("log_bayes_factor"))


def _gauss(center: float = 0.5, sigma: float = 0.1, dims: int = 2):
    from ..operators.sampler import Problem

    return Problem([f"x{i + 1}" for i in range(dims)], _Gauss(center, sigma, dims))


class _Gauss:
    """A normalised Gaussian in the unit cube: the evidence is close to 1."""

    def __init__(self, center: float, sigma: float, dims: int):
        self.center, self.sigma, self.norm = center, sigma, -dims * math.log(sigma * math.sqrt(2 * math.pi))

    def __call__(self, p):
        return -0.5 * (((p - self.center) / self.sigma) ** 2).sum(axis=1) + self.norm


@query()
def sampler_gauss(spark, sf):
    from ..operators.sampler import NestedSampler, results

    s = NestedSampler(spark, _gauss(), 200, seed=3, tasks=4).run(0.05)
    return results(s.points(), ["x1", "x2"])[0]


@query()
def slice_sampler_gauss(spark, sf):
    from ..operators.sampler import NestedSampler, results

    s = NestedSampler(spark, _gauss(), 200, seed=4, tasks=4, stepper="slice", nsteps=6).run(0.05)
    return results(s.points(), ["x1", "x2"])[0]


@query()
def stream_order_test(spark, sf):
    """Running order tests of users' values within a hundred, as a stateful stream."""
    from ..streaming import drain, order_test

    schema = read(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    ranks = events.select((F.col("user_id") % 16).alias("run_id"), F.col("event_id").alias("seq"), F.pmod(F.floor("value"), F.lit(100)).alias("rank"), F.lit(100).cast("long").alias("n"))
    return drain(order_test(ranks), spark)


def _shares(spark, sf) -> DataFrame:
    w = _weighted(spark, sf)
    return w.join(F.broadcast(w.agg(F.sum("weight").alias("s")))).withColumn("p", F.col("weight") / F.col("s"))


@query(f"WITH {_run_sql()}, c AS (SELECT rk, round(sum(e) OVER (ORDER BY rk) / sum(e) OVER (), 9) AS c FROM zz) SELECT min(rk) FILTER (c >= 0.0025) AS first, max(rk) FILTER (c <= 0.9975) AS last FROM c")
def cumulative_range(spark, sf):
    return st.cumulative_range(_shares(spark, sf).select("logl", "point_id", "p"), "p", ["logl", "point_id"], 0.0025)


@query(f"WITH {_run_sql()}, c AS (SELECT point_id, round(sum(e) OVER (ORDER BY rk) / sum(e) OVER (), 12) AS c FROM zz) SELECT count(*) AS n, min(point_id) AS first_id FROM c WHERE c > 1e-4")
def min_weight_filter(spark, sf):
    kept = st.drop_light_head(_shares(spark, sf).select("logl", "point_id", "p"), "p", ["logl", "point_id"])
    return kept.agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("first_id"))


@query("""WITH e AS (SELECT event_id, value AS a, unnest([value * 3 + 1, value * value]) AS b, unnest([1, 2]) AS f FROM events),
 p AS (SELECT f, x.a AS a0, x.b AS b0, y.a AS a1, y.b AS b1 FROM e x JOIN e y USING (f) WHERE x.event_id % 2 = 0 AND y.event_id = x.event_id + 1 AND x.a <> y.a),
 s AS (SELECT f, (b1 - b0) / (a1 - a0) AS slope, b0 - (b1 - b0) / (a1 - a0) * a0 AS offset_ FROM p),
 r AS (SELECT f, max(slope) - min(slope) <= 1e-6 * greatest(1, max(abs(slope))) AND max(offset_) - min(offset_) <= 1e-6 * greatest(1, max(abs(offset_))) AS affine FROM s GROUP BY f)
SELECT (SELECT affine FROM r WHERE f = 1) AS linear, (SELECT affine FROM r WHERE f = 2) AS square""")
def affine_check(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.col("value").alias("a"), (F.col("value") * 3 + 1).alias("b"), (F.col("value") * F.col("value")).alias("c"))
    x = st.is_affine(e, "a", "b", "event_id", 1e-6).select(F.col("affine").alias("linear"))
    return x.join(F.broadcast(st.is_affine(e, "a", "c", "event_id", 1e-6).select(F.col("affine").alias("square"))))


@query(f"""WITH {_run_sql()}, b AS (SELECT rk, 1 - exp(logw - lag(logw) OVER (ORDER BY rk)) AS r FROM w), q AS (SELECT rk, CASE WHEN r > 0 AND 1 - 4 * r >= 0 THEN (1 - sqrt(1 - 4 * r)) / (2 * r) END AS q FROM b WHERE r IS NOT NULL)
SELECT rk AS iter, round(CASE WHEN q > 1 AND 1 / ln(q) > 1 THEN 1 / ln(q) ELSE 1 END, 2) AS nlive FROM q""")
def live_number_backout(spark, sf):
    w = ev.weighted(_points(spark, sf))
    return st.live_number_from_weights(w).select(F.col("rk").alias("iter"), _r("nlive", 2).alias("nlive"))


@query(f"WITH {_run_sql()} SELECT c_nationkey AS cluster_id, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1".replace(f"WITH {_run_sql()} ", ""))
def cluster_sizes(spark, sf):
    return read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_FORKED = _run_sql().replace(f"CASE WHEN rk > {N} THEN rk - {N} END", "CASE WHEN rk > 800 THEN rk - 400 WHEN rk > 200 THEN (rk - 1) // 4 + 1 END")


@query(f"""WITH RECURSIVE {_FORKED}, f AS (SELECT rk, nchild, 1::BIGINT AS weight FROM l0 WHERE prk IS NULL UNION ALL SELECT l0.rk, l0.nchild, f.weight * f.nchild FROM f JOIN l0 ON l0.prk = f.rk)
SELECT f.weight, count(*) AS n FROM f GROUP BY f.weight""")
def fork_weights(spark, sf):
    """A run whose first 200 rows have up to four children each."""
    r = ranked(_points(spark, sf).select("point_id", "logl"), "logl", "point_id").drop("__part")
    parent = F.when(F.col("rk") > 800, F.col("rk") - 400).when(F.col("rk") > 200, F.floor((F.col("rk") - 1) / 4) + 1)
    r = r.select(F.col("rk").alias("point_id"), "logl", parent.alias("parent_id"))
    return st.fork_weights(r).groupBy(F.round(F.exp("log_weight")).cast("long").alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT -abs(s_acctbal::DOUBLE) / 1000 AS logl FROM supplier), s AS (SELECT min(logl) AS lo, max(logl) AS top, quantile_cont(logl, 0.5) AS mid, count(*) AS n FROM l),
 q AS (SELECT logl AS second FROM l ORDER BY logl LIMIT 1 OFFSET 1)
SELECT round(lo, 6) AS lo, round(greatest(least(-5 - (-3 + ln(0.01)) - ln(n), mid), second), 6) AS hi FROM s, q""")
def advice_range(spark, sf):
    live = read(spark, sf, "supplier").select((-F.abs(F.col("s_acctbal").cast("double")) / 1000).alias("logl"))
    return st.advice_range(live, -6.0, -5.0, -3.0).select(_r("lo").alias("lo"), _r("hi").alias("hi"))


@query(f"WITH {_run_sql(N, True)} SELECT f.i AS floor, round(sqrt(sum(1e0 / pow(greatest(nlive, f.i), 2))), 6) AS error, sqrt(sum(1e0 / pow(greatest(nlive, f.i), 2))) < 0.3 AS enough FROM l, (VALUES (200::BIGINT), (400), (800)) f(i) GROUP BY f.i")
def width_for_error(spark, sf):
    return st.width_for_error(ev.live_points(_points(spark, sf, N, True)), 0.3, [200, 400, 800]).select("floor", _r("error").alias("error"), "enough")


@query(f"""WITH {_run_sql()}, q AS (SELECT rk, (rk - 1) // 100 AS block, -0.5 * pow((o_totalprice - 245000) / 48000, 2) AS nl FROM r),
 d AS (SELECT a.block, count(*) FILTER (a.nl > b.nl) * 2e0 AS k FROM q a JOIN q b ON a.block = b.block AND a.rk < b.rk GROUP BY a.block), n AS (SELECT block, count(*) AS n FROM q GROUP BY block),
 e AS (SELECT block, k / (n * (n - 1)) AS distance FROM d JOIN n USING (block))
SELECT block, round(distance, 6) AS distance, coalesce(block < (SELECT min(block) FROM e WHERE distance > 0.3), true) AS good FROM e""")
def replay_blocks(spark, sf):
    return st.replay_blocks(_points(spark, sf).select("point_id", "logl", "o_totalprice"), F.expr("-0.5D*pow((o_totalprice-245000D)/48000D, 2D)"), 100, 0.3).select("block", _r("distance").alias("distance"), "good")


@query(f"WITH {_NEAR_PARTS}, k AS (SELECT b_id, min(1 + a_id % 3) AS lo, max(1 + a_id % 3) AS hi FROM nb GROUP BY b_id) SELECT id, CASE WHEN lo = hi THEN lo ELSE 0 END AS cluster FROM c LEFT JOIN k ON k.b_id = id")
def match_clusters(spark, sf):
    c = _cloud(spark, sf)
    return st.match_clusters(c, _part_cloud(spark, sf).withColumn("cluster", 1 + F.col("id") % 3), 0.05, ["x", "y"])


@query("""WITH u AS (SELECT s_suppkey, tan(pi() * ((s_suppkey * 37 % 101 + 0.5e0) / 102 - 0.5)) AS t1, tan(pi() * ((s_suppkey * 53 % 97 + 0.5e0) / 98 - 0.5)) AS t2 FROM supplier)
SELECT s_suppkey, round(0.5 + 0.1 * t1 + 0.02 * t2, 5) AS x1, round(0.4 + 0.05 * t2, 5) AS x2, round(ln(1 + t1 * t1) + ln(1 + t2 * t2), 5) AS logweight FROM u""")
def student_t_start(spark, sf):
    s = read(spark, sf, "supplier")
    u = [((F.col("s_suppkey") * 37 % 101 + 0.5) / 102.0).cast("double"), ((F.col("s_suppkey") * 53 % 97 + 0.5) / 98.0).cast("double")]
    x, w = st.student_t_start(u, [0.5, 0.4], [[0.1, 0.02], [0.0, 0.05]])
    return s.select("s_suppkey", _r(x[0], 5).alias("x1"), _r(x[1], 5).alias("x2"), _r(w, 5).alias("logweight"))


@query("SELECT user_id, event_id // 20 AS block, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY user_id, event_id // 20")
def step_smoothing(spark, sf):
    return st.smoothed(read(spark, sf, "events"), "event_id", "value", 20, ["user_id"]).select("user_id", "block", _r("mean").alias("mean"), "n")


@query(f"WITH {_run_sql()}, h AS (SELECT least(floor(o_totalprice / 600000 * 30), 29)::INT AS bin, sum(e) AS m FROM zz GROUP BY 1) SELECT i::INT AS bin, round(coalesce(m, 0), 6) AS mass FROM range(30) r(i) LEFT JOIN h ON h.bin = r.i")
def marginal_histogram(spark, sf):
    return po.histogram(_weighted(spark, sf), F.col("o_totalprice") / 600000.0, F.col("weight"), 30).select("bin", _r("mass").alias("mass"))


@query(f"""WITH {_run_sql()}, eq AS (SELECT unnest(generate_series(1, copies)) AS k, o_totalprice AS x FROM (SELECT o_totalprice, (ceil(round(1000 * c - 0.5, 9)) - ceil(round(1000 * (c - p) - 0.5, 9)))::BIGINT AS copies
  FROM (SELECT o_totalprice, p, sum(p) OVER (ORDER BY rk) AS c FROM (SELECT *, e / sum(e) OVER () AS p FROM zz))) WHERE copies > 0)
SELECT 'o_totalprice' AS param, round(avg(x), 3) AS mean, round(stddev_pop(x), 3) AS stdev, round(quantile_cont(x, 0.5), 3) AS median, round(quantile_cont(x, 0.158655), 3) AS errlo, round(quantile_cont(x, 0.841345), 3) AS errup FROM eq""")
def equal_weight_summary(spark, sf):
    s = po.resample_equal(_shares(spark, sf).select("logl", "point_id", "o_totalprice", "p"), "p", ["logl", "point_id"], F.lit(1000.0))
    return po.equal_weight_summary(s, ["o_totalprice"]).select("param", *[_r(c, 3).alias(c) for c in ("mean", "stdev", "median", "errlo", "errup")])


_TIES = """ties AS (SELECT DISTINCT l.rk FROM l JOIN pa b ON b.rk BETWEEN l.rk AND l.rk + 99 AND coalesce(b.prk, 0) < l.rk JOIN pa d ON d.rk BETWEEN b.rk + 1 AND l.rk + 99 AND coalesce(d.prk, 0) < l.rk AND d.logl = b.logl)"""


@query(f"""WITH {_run_sql(100)}, {_RANK}, {_TIES} SELECT l.point_id, round(CASE WHEN t.rk IS NULL THEN 2e0 * (r.nlive - r.insert_rank) / r.nlive END, 6) AS insert_order
FROM l LEFT JOIN rank_ r USING (rk) LEFT JOIN ties t USING (rk)""")
def rank_sequence(spark, sf):
    return ot.rank_sequence(ev.live_points(_points(spark, sf, 100))).select("point_id", _r("insert_order").alias("insert_order"))


@query(f"WITH {_run_sql()} SELECT point_id, round(logvol, 6) AS logvol, round(logl - max(logl) OVER (), 6) + 0.0 AS logl_relative, round(logwt - (SELECT logz FROM t), 6) AS logwt_relative FROM zz")
def evidence_view(spark, sf):
    v = ev.evidence_view(ev.weighted(_points(spark, sf)))
    return v.select("point_id", _r("logvol").alias("logvol"), (_r("logl_relative") + 0.0).alias("logl_relative"), _r("logwt_relative").alias("logwt_relative"))


_H_BOOT = "bh AS (SELECT boot_id, sum(exp(bwt - mx) * logl) / sum(exp(bwt - mx)) - max(mx) - ln(sum(exp(bwt - mx))) AS h FROM (SELECT *, max(bwt) OVER (PARTITION BY boot_id) AS mx FROM bw) WHERE nchild > 0 AND boot_id > 0 GROUP BY boot_id)"


@query(f"""WITH {_run_sql()}, {_BOOT}, {_H_BOOT}, h0 AS ({_H}), hh AS (SELECT h FROM bh UNION ALL SELECT h FROM h0),
 b0 AS (SELECT avg(bz) AS m, stddev_pop(bz) AS s, max(bz - (SELECT logz FROM t)) AS e FROM bz WHERE boot_id > 0),
 f AS (SELECT ln(1 + sum(e) FILTER (nchild = 0) / sum(e)) AS tail, sum(e) * sum(e) / sum(e * e) AS ess, count(*) AS n, max(logl) AS top FROM zz)
SELECT n, round((SELECT logz FROM t), 6) AS logz, round(sqrt(b0.e * b0.e + tail * tail), 6) AS logzerr, round(b0.m, 6) AS logz_bs, round(b0.s, 6) AS logz_bs_std, round(b0.e, 6) AS logzerr_bs,
 round(sqrt((SELECT h FROM h0) / {N}), 6) AS logzerr_single, round(tail, 6) AS logzerr_tail, round(ess, 4) AS ess, round((SELECT h FROM h0), 6) AS h, round((SELECT stddev_pop(h) FROM hh), 6) AS herr, round(top, 6) + 0.0 AS max_logl FROM b0, f""")
def result_table(spark, sf):
    r = rv.result_table(_points(spark, sf), _boot(spark).where("boot_id > 0"))
    return r.select("n", *[_r(c, 4 if c == "ess" else 6).alias(c) for c in r.columns if c not in ("n", "max_logl")], (_r("max_logl") + 0.0).alias("max_logl"))


@query(f"""WITH {_run_sql().replace("pa AS (SELECT *,", "p0 AS (SELECT *,").replace("ch AS (", "fi AS (SELECT logl, min(rk) AS m FROM r GROUP BY logl), pa AS (SELECT p0.* REPLACE (fi.m AS prk) FROM p0 LEFT JOIN r x ON x.rk = p0.prk LEFT JOIN fi ON fi.logl = x.logl), ch AS (", 1)} {SUMMARY}""")
def read_run_results(spark, sf):
    """A run is stored as rows that know only their threshold of birth, and read, rebuilt and integrated again."""
    import uuid

    from ..operators.ordered import materialise
    from ..sources import store

    materialise(spark.range(1))  # names the shared folder
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/run-{uuid.uuid4().hex}"
    rows = materialise(_points(spark, sf)).select("birth", "logl", F.lit(0.0).alias("quality"), (F.col("o_totalprice") / 600000).alias("u_1"), F.col("o_totalprice").alias("p_1"), "point_id")
    kept = store.ParquetPointStore(spark, path, store.columns(1, 1))
    kept.append(rows.orderBy("logl", "point_id"), 2 * rows.count())
    points = rv.rebuild_tree(store.ParquetPointStore(spark, path, store.columns(1, 1)).stored())
    return _summary(points.withColumn("root_id", F.lit(0)))


@query("""WITH RECURSIVE st AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS seq, s_acctbal::DOUBLE / 1000 AS logl, s_acctbal::DOUBLE / 1000 - (s_suppkey % 7) AS birth FROM supplier),
 th AS (SELECT i AS k, -1 + i / 4e0 AS t FROM range(1, 41) r(i)),
 w AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS seq
   UNION ALL SELECT w.k + 1, list_append(w.used, m.seq), m.seq FROM w, LATERAL (SELECT min(st.seq) AS seq FROM st, th WHERE th.k = w.k + 1 AND st.birth <= th.t AND st.logl > th.t AND NOT coalesce(list_contains(w.used, st.seq), false)) m WHERE w.k < 40)
SELECT w.k, th.t AS threshold, coalesce(w.seq, -1) AS seq FROM w JOIN th USING (k)""")
def pop_consume_once(spark, sf):
    """Forty rising thresholds, each of which uses up the row it takes."""
    s = ranked(read(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal").cast("double") / 1000).alias("logl")), "s_suppkey", name="seq")
    s = s.select("seq", "logl", (F.col("logl") - F.col("s_suppkey") % 7).alias("birth"))
    t = spark.range(1, 41).select(F.col("id").alias("k"), (F.lit(-1) + F.col("id") / 4.0).alias("threshold"))
    return ws.pop_sequence(s, t).withColumn("seq", F.coalesce("seq", F.lit(-1).cast("long")))


@query(f"""WITH {_run_sql()}, {_BOOT}, m AS (SELECT (SELECT logz FROM t) AS z, (SELECT count(*) FROM zz) AS n),
 c AS (SELECT logl, sum(p) OVER (ORDER BY rk) AS c, p FROM (SELECT rk, logl, exp(logwt - m.z) AS p FROM zz, m)),
 d AS (SELECT min(logl) AS lo, max(logl) AS hi FROM c WHERE ceil(round(20000 * c - 0.5, 9)) > ceil(round(20000 * (c - p) - 0.5, 9))),
 es AS (SELECT sum(e) * sum(e) / sum(e * e) AS ess FROM zz),
 g0 AS (SELECT boot_id, bw.rk, bw.logl, exp(bwt - bz) * (bwt - bz - (zz.logwt - m.z)) AS g FROM bw JOIN bz USING (boot_id) JOIN zz USING (point_id), m WHERE boot_id > 0),
 kl AS (SELECT boot_id, sum(g) AS kl FROM g0 GROUP BY boot_id), ap AS (SELECT boot_id, abs(kl - avg(kl) OVER ()) AS apart FROM kl),
 gc AS (SELECT logl, round(sum(greatest(g, 0)) OVER (PARTITION BY boot_id ORDER BY rk) / sum(greatest(g, 0)) OVER (PARTITION BY boot_id), 9) AS c FROM g0 JOIN ap USING (boot_id) WHERE apart > 0.001),
 ks AS (SELECT min(logl) FILTER (c >= 0.0025) AS lo, max(logl) FILTER (c <= 0.9975) AS hi FROM gc),
 zz1 AS (SELECT greatest(max(abs(bz - m.z)), sqrt((SELECT h FROM ({_H})) / {N})) AS v FROM bz, m WHERE boot_id > 0)
SELECT 'ess' AS goal, round(ess, 4) AS value, ess >= 20000 AS met, round(lo, 6) AS lo, round(hi, 6) + 0.0 AS hi, 0::BIGINT AS width FROM es, d
UNION ALL SELECT 'kl', round((SELECT max(apart) FROM ap), 4), false, round(lo, 6), round(hi, 6) + 0.0, 0 FROM ks
UNION ALL SELECT 'logz', round(v, 4), false, NULL, NULL, ceil(sqrt(n) / 0.005)::BIGINT FROM zz1, m""")
def strategy_goals(spark, sf):
    g = rv.goals(_points(spark, sf), _boot(spark).where("boot_id > 0"), 20000, 0.001, 0.005)
    return g.select("goal", _r("value", 4).alias("value"), "met", _r("lo").alias("lo"), (_r("hi") + 0.0).alias("hi"), "width")


@query(f"""WITH {_run_sql(N, True)}, tie AS (SELECT logl, count(*) AS k FROM l GROUP BY logl)
SELECT point_id, k = 1 AND logl <= -1 AND (rk = 1 OR rk <= 5000) AND nchild < 1 + point_id % 3 AND (rk = 1 OR nlive <= 300) AS expand FROM l JOIN tie USING (logl)""")
def expandable_nodes(spark, sf):
    w = ev.live_points(_points(spark, sf, N, True)).withColumn("wanted", 1 + F.col("point_id") % 3)
    return rv.expandable(w, -10.0, -1.0, 300, max_iters=5000, min_children="wanted").select("point_id", "expand")


@query("SELECT count(*) * 40 AS width FROM (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 1)")
def cluster_width_goal(spark, sf):
    return rv.cluster_width(read(spark, sf, "customer"), "c_nationkey", 40)


@query("SELECT count(*) - 1 AS to_add FROM part WHERE p_size = (SELECT min(p_size) FROM part)")
def plateau_roots(spark, sf):
    return rv.plateau_roots(read(spark, sf, "part").select(F.col("p_size").cast("double").alias("logl")))


@query("""WITH k AS (SELECT l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS e, l_discount::DOUBLE AS d FROM lineitem),
 r AS (SELECT rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2e0 AS q, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2e0 AS e, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2e0 AS d FROM k),
 c AS (SELECT 'q' AS a, 'e' AS b, corr(q, e) AS rho FROM r UNION ALL SELECT 'q', 'd', corr(q, d) FROM r UNION ALL SELECT 'e', 'd', corr(e, d) FROM r)
SELECT a, b, round(rho, 6) AS rho, abs(rho) > 0.75 AS report FROM c""")
def degenerate_pairs(spark, sf):
    l = read(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("e"), F.col("l_discount").cast("double").alias("d"))
    return rv.degenerate_pairs(l, ["q", "e", "d"]).select("a", "b", _r("rho").alias("rho"), "report")
