"""Queries of replays, rank tests, clusters, densities and distributions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import priors as pr
from ..functions import student
from ..operators import chained as ch
from ..operators import clustering as cl
from ..operators import density as de
from ..operators import dominance as do
from ..operators import evidence as ev
from ..operators import reactive as rv
from ..operators import report as rp
from ..operators import reweight as rw
from ..operators.ordered import lagged, ranked
from ..sources import read
from .queries import LOGL, N, _points, _r, _run_sql, query

# a value is left out if the highest one kept below it is below its threshold; rounds from all values kept until none is left out any more
_ROUNDS = "v0 AS (SELECT *, true AS fits FROM vals)," + ",".join(
    f" v{k + 1} AS (SELECT logl, birth, birth = '-infinity'::DOUBLE OR birth <= coalesce(max(CASE WHEN fits THEN logl END) OVER (ORDER BY logl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE) AS fits FROM v{k})" for k in range(12)
)
_PARTIAL = f"""
 st AS (SELECT r.point_id, r.rk, r.logl, CASE WHEN r.o_custkey % 5 = 0 THEN (r.logl + coalesce(b.logl, r.logl)) / 2 WHEN r.o_custkey % 7 = 0 THEN b.logl ELSE a.logl END AS birth
   FROM r LEFT JOIN r a ON a.rk = r.rk - {N} LEFT JOIN r b ON b.rk = r.rk - 1),
 vals AS (SELECT DISTINCT logl, min(coalesce(birth, '-infinity'::DOUBLE)) OVER (PARTITION BY logl) AS birth FROM st),
 {_ROUNDS},
 top AS (SELECT logl FROM v12 WHERE fits),
 fits AS (SELECT st.*, t.logl AS below FROM st ASOF LEFT JOIN top t ON st.logl > t.logl),
 tree AS (SELECT * FROM fits WHERE birth IS NULL OR birth <= below),
 firsts AS (SELECT logl, min(point_id) AS point_id FROM tree GROUP BY logl)"""


@query(f"""WITH {_run_sql()}, {_PARTIAL}
SELECT t.point_id, CASE WHEN t.birth IS NOT NULL THEN f.point_id ELSE -1 END AS parent_id FROM tree t ASOF LEFT JOIN firsts f ON t.birth <= f.logl""")
def read_run_partial(spark, sf):
    """A stored run in which a fifth of the rows never fit, and others hang under rows that may be gone: the tree that is left."""
    base = read(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), "o_custkey", F.expr(LOGL.replace("o_totalprice", "cast(o_totalprice as double)")).alias("logl"))
    r = lagged(lagged(ranked(base, "logl", "seq").drop("__part"), N, "rk", far="logl"), 1, "rk", near="logl")
    birth = F.when(F.col("o_custkey") % 5 == 0, (F.col("logl") + F.coalesce("near", "logl")) / 2).when(F.col("o_custkey") % 7 == 0, F.col("near")).otherwise(F.col("far"))
    return rv.rebuild_tree(r.select("seq", "logl", birth.alias("birth"))).select("point_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))


@query("""WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, (event_id * 48271 % 2147483647 % 120 + 0.5) / 120 - 0.5 AS d FROM events),
 c AS (SELECT i, sum(d) OVER (ORDER BY i) AS c FROM e UNION ALL SELECT 0, 0),
 walk(i) AS (SELECT 0::BIGINT UNION ALL
   SELECT (SELECT min(b.i) FROM c b, c a WHERE a.i = walk.i AND b.i > walk.i AND abs(b.c - a.c) > 0.6 * sqrt((b.i - a.i) / 12e0)) FROM walk WHERE walk.i IS NOT NULL)
SELECT i - lag(i) OVER (ORDER BY i) AS length, i AS at FROM walk WHERE i IS NOT NULL QUALIFY lag(i) OVER (ORDER BY i) IS NOT NULL""")
def run_lengths(spark, sf):
    """Runs that a rank test with a threshold of 0.6 ends, over all events as one sequence."""
    e = read(spark, sf, "events").select("ts", "event_id", (F.col("event_id") * 48271 % 2147483647 % 120).alias("rank"), F.lit(120).alias("n"))
    return ch.run_lengths_table(e, "rank", "n", "ts", "event_id", threshold=0.6).select("length", "at")


_CUSTOMERS = "c AS (SELECT c_custkey AS id, (c_acctbal::DOUBLE + 1000) / 11000 AS x, (c_custkey * 37 % 1009) / 1009e0 AS y, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 40) + 1 END AS was FROM customer)"


@query(f"""WITH RECURSIVE {_CUSTOMERS}, nb AS (SELECT a.id AS i, b.id AS j FROM c a JOIN c b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.012 * 0.012),
 walk AS (SELECT id, id AS other FROM c UNION SELECT walk.id, nb.j FROM walk JOIN nb ON nb.i = walk.other),
 m AS (SELECT id, min(other) AS first FROM walk GROUP BY id),
 k AS (SELECT count(DISTINCT first) AS k FROM m),
 seeds AS (SELECT was, min(id) AS id FROM c WHERE was IS NOT NULL GROUP BY was),
 claims AS (SELECT first, min(was) AS cluster FROM seeds JOIN m USING (id), k WHERE was <= k GROUP BY first),
 rest AS (SELECT first, row_number() OVER (ORDER BY first) AS p FROM (SELECT DISTINCT first FROM m WHERE first NOT IN (SELECT first FROM claims))),
 free AS (SELECT i AS cluster, row_number() OVER (ORDER BY i) AS p FROM k, range(1, k + 1) t(i) WHERE i NOT IN (SELECT cluster FROM claims)),
 named AS (SELECT first, cluster FROM claims UNION ALL SELECT first, cluster FROM rest JOIN free USING (p)),
 o AS (SELECT c.*, cluster, count(*) OVER q AS n, avg(x) OVER q AS mx, avg(y) OVER q AS my, avg(x) OVER () AS ax, avg(y) OVER () AS ay FROM c JOIN m USING (id) JOIN named USING (first) WINDOW q AS (PARTITION BY cluster))
SELECT id, cluster::BIGINT AS cluster, k AS nclusters, round(x - CASE WHEN n > 1 THEN mx ELSE ax END, 9) + 0.0 AS x, round(y - CASE WHEN n > 1 THEN my ELSE ay END, 9) + 0.0 AS y FROM o, k""")
def clusters_kept(spark, sf):
    """Clusters of all customers with the numbers that a third of them had before, centred."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_acctbal").cast("double") + 1000) / 11000).alias("x"), ((F.col("c_custkey") * 37 % 1009) / 1009.0).alias("y"))
    old = c.where("id % 3 = 0").select("id", (F.col("id") % 40 + 1).alias("cluster"))
    return cl.update_clusters(c, 0.012, ["x", "y"], old).select("id", "cluster", "nclusters", (_r("x", 9) + 0.0).alias("x"), (_r("y", 9) + 0.0).alias("y"))


_H = 30_000.0
_KERNEL = f"exp(-(b.x - a.x) * (b.x - a.x) / (2 * {_H} * {_H}))"


@query(f"""WITH e AS (SELECT o_totalprice::DOUBLE AS v, 1 + o_custkey % 3 AS w FROM orders WHERE o_totalprice <= 500000),
 g AS (SELECT i AS bin, (i + 0.5) * 500000 / 256 AS x, coalesce(m, 0) / sum(m) OVER () AS m FROM range(256) r(i) LEFT JOIN (SELECT least(greatest(floor(v / (500000e0 / 256)), 0), 255)::BIGINT AS bin, sum(w) AS m FROM e GROUP BY 1) ON bin = i),
 k AS (SELECT a.bin, a.x, a.m, b.bin AS bin2, {_KERNEL} AS k, (b.x - a.x) / {_H} AS u FROM g a JOIN g b ON abs(b.x - a.x) / {_H} <= 4),
 s AS (SELECT a.bin, a.x, a.m, sum(k) AS s0, sum(k * u) AS s1, sum(k * u * u) AS s2, sum(k * b.m) AS t0, sum(k * u * b.m) AS t1 FROM k a JOIN g b ON b.bin = a.bin2 GROUP BY a.bin, a.x, a.m),
 f AS (SELECT *, least(bin, 255 - bin) < ceil(4 * {_H} / (500000e0 / 256)) AS near, s0 * s2 - s1 * s1 AS det, sqrt(2 * pi()) * {_H} / (500000e0 / 256) AS whole FROM s),
 p AS (SELECT bin, x, m, CASE WHEN NOT near THEN t0 / whole WHEN det > 0 AND s2 * t0 - s1 * t1 > 0 THEN (s2 * t0 - s1 * t1) / det ELSE t0 / s0 END AS pilot FROM f),
 s2 AS (SELECT a.bin, sum(k) AS s0, sum(k * u) AS s1, sum(k * u * u) AS s2, sum(k * CASE WHEN b.pilot > 1e-12 THEN b.m / b.pilot ELSE 0 END) AS t0, sum(k * u * CASE WHEN b.pilot > 1e-12 THEN b.m / b.pilot ELSE 0 END) AS t1 FROM k a JOIN p b ON b.bin = a.bin2 GROUP BY a.bin),
 f2 AS (SELECT p.*, s0, s1, t0, t1, s2.s2, least(bin, 255 - bin) < ceil(4 * {_H} / (500000e0 / 256)) AS near, s0 * s2.s2 - s1 * s1 AS det, sqrt(2 * pi()) * {_H} / (500000e0 / 256) AS whole FROM p JOIN s2 USING (bin)),
 d0 AS (SELECT bin, x, pilot * CASE WHEN NOT near THEN t0 / whole WHEN det > 0 AND s2 * t0 - s1 * t1 > 0 THEN (s2 * t0 - s1 * t1) / det ELSE t0 / s0 END AS q FROM f2),
 d AS (SELECT bin, x, q / sum(q) OVER () AS p, row_number() OVER (ORDER BY q DESC, bin) AS r FROM d0),
 c AS (SELECT *, sum(p) OVER (ORDER BY bin) AS c FROM d),
 w AS (SELECT a.r, min(b.bin) AS l, max(b.bin) AS h FROM c a JOIN c b ON b.r <= a.r GROUP BY a.r),
 z AS (SELECT w.r, lo.x AS lo, hi.x AS hi, hi.c - lo.c + lo.p AS mass FROM w JOIN c lo ON lo.bin = w.l JOIN c hi ON hi.bin = w.h WHERE round(hi.c - lo.c + lo.p, 12) >= 0.68)
SELECT 'v' AS param, round((SELECT x FROM c WHERE r = 1), 3) AS mode, round(arg_min(lo, r), 3) AS lo, round(arg_min(hi, r), 3) AS hi, round(arg_min(mass, r), 6) AS mass FROM z""")
def hdi_density(spark, sf):
    """The densest interval of all weighted prices up to 500,000, from a density with hard ends and a given bandwidth."""
    v = read(spark, sf, "orders").where("o_totalprice <= 500000").select(F.col("o_totalprice").cast("double").alias("v"), (1 + F.col("o_custkey") % 3).alias("w"))
    grid = de.materialise(de.mass_grid(v, ["v"], "w", 256, {"v": (0.0, 500_000.0)}))
    d = de.density_grid(grid, grid.select("param").distinct().withColumn("h", F.lit(_H)))
    return de.highest_density_intervals(de.materialise(d)).select("param", *[_r(c, 3).alias(c) for c in ("mode", "lo", "hi")], _r("mass").alias("mass"))


@query("""WITH y AS (SELECT x::INT AS x, s_acctbal::DOUBLE / 1000 + x * (s_suppkey % 7) AS y FROM supplier, range(11) r(x)),
 k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY y) AS k, count(*) OVER (PARTITION BY x) AS n FROM y),
 q AS (SELECT unnest([0.159, 0.5, 0.841])::DOUBLE AS q),
 a AS (SELECT DISTINCT x, q, n, n * q + 0.4 + 0.2 * q AS place, floor(greatest(least(n * q + 0.4 + 0.2 * q, n - 1), 1)) AS f FROM k, q)
SELECT a.x, a.q, round(max(k.y) FILTER (k.k = f) * (1 - greatest(least(place - f, 1), 0)) + max(k.y) FILTER (k.k = least(f + 1, a.n)) * greatest(least(place - f, 1), 0), 6) AS value
FROM a JOIN k ON k.x = a.x AND k.k IN (f, least(f + 1, a.n)) GROUP BY a.x, a.q, f, place, a.n""")
def band_quantiles(spark, sf):
    """Median and one-sigma band of eleven predictions of every supplier, by plotting positions."""
    xs = spark.range(11).select(F.col("id").cast("int").alias("x"))
    y = read(spark, sf, "supplier").join(F.broadcast(xs)).select("x", (F.col("s_acctbal").cast("double") / 1000 + F.col("x") * (F.col("s_suppkey") % 7)).alias("y"))
    return de.plotting_quantiles(y, "x", "y", [0.159, 0.5, 0.841]).select("x", "q", _r("value").alias("value"))


# the distribution function of five degrees of freedom in closed form, and Newton steps from the middle, which rise to the quantile
_T5 = "(atan(t / sqrt(5e0)) + (t / sqrt(5e0)) / (1 + t * t / 5) * (1 + 2e0 / 3 / (1 + t * t / 5))) / pi()"
_T5_PDF = "8 / (3 * pi() * sqrt(5e0)) * pow(1 + t * t / 5, -3)"


@query(f"""WITH RECURSIVE p AS (SELECT o_orderkey, (((o_orderkey * 7919) % 100003) + 0.5) / 100003 AS p FROM orders),
 w AS (SELECT o_orderkey, p, 0 AS step, 0e0 AS t FROM p UNION ALL
  SELECT o_orderkey, p, step + 1, t + (abs(p - 0.5) - {_T5}) / ({_T5_PDF}) FROM w WHERE step < 40)
SELECT o_orderkey, round(sign(p - 0.5) * t, 6) + 0.0 AS t, round(0.5 + sign(p - 0.5) * {_T5}, 8) AS back FROM w WHERE step = 40""")
def t_quantiles(spark, sf):
    """Student t draws with five degrees of freedom, one an order, and their distribution function back."""
    p = ((F.col("o_orderkey") * 7919) % 100003 + 0.5) / 100003
    t = read(spark, sf, "orders").select("o_orderkey", student.t_ppf(p, 5).alias("t"))
    t = t.withColumn("back", student.t_cdf("t", 5))
    return t.select("o_orderkey", (_r("t") + 0.0).alias("t"), _r("back", 8).alias("back"))


@query(f"""WITH {_run_sql()}, q AS (SELECT point_id, logl, logw, o_totalprice, row_number() OVER (ORDER BY logl + logw DESC, point_id) - 1 AS i, count(*) OVER () AS n FROM zz),
 b AS (SELECT *, i // 64 AS b, logw - 0.5 * pow((o_totalprice - 240000) / 45000, 2) AS lw FROM q),
 tb AS (SELECT b, max(lw) AS top, any_value(n) AS n FROM b GROUP BY b),
 sb AS (SELECT min(b) AS stop FROM (SELECT b, top, n, max(top) OVER (ORDER BY b) AS peak FROM tb) WHERE top < peak - ln(n) - 10),
 k AS (SELECT b.*, max(lw) OVER () AS m FROM b, sb WHERE stop IS NULL OR b <= stop),
 z2 AS (SELECT any_value(n) AS n, count(*) AS used, any_value(m) + ln(sum(exp(lw - m))) AS logz, sum(exp(2 * (lw - m))) / pow(sum(exp(lw - m)), 2) AS s2 FROM k)
SELECT n, used, round(logz, 6) AS logz, round(ln(1 + sqrt(greatest(s2 - 1e0 / n, 0) / (n - 1))), 8) AS logzerr, round(1 / s2, 4) AS ess FROM z2""")
def reuse_early_stop(spark, sf):
    """All weighted points of a run under a likelihood moved and narrowed, in batches of 64 until the rest cannot matter."""
    new = -0.5 * (F.col("o_totalprice") - 240000.0) * (F.col("o_totalprice") - 240000.0) / (45000.0 * 45000.0)
    w = ev.weighted(_points(spark, sf)).select("point_id", "logl", "logw", "o_totalprice")
    _, result = rw.reuse_in_batches(w, new, "point_id", batch=64)
    return result.select("n", "used", _r("logz").alias("logz"), _r("logzerr", 8).alias("logzerr"), _r("ess", 4).alias("ess"))


@query("""WITH o AS (SELECT o_custkey AS a, o_totalprice::DOUBLE AS b FROM orders)
SELECT (SELECT count(*) FROM o) AS n, round(count(*) * 2e0 / ((SELECT count(*) FROM o) * ((SELECT count(*) FROM o) - 1e0)), 9) AS distance FROM o x JOIN o y ON x.a < y.a AND x.b > y.b""")
def kendall_whole(spark, sf):
    """Kendall distance of price and customer over all orders, as one group."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("a"), F.col("o_totalprice").cast("double").alias("b"))
    return do.kendall_distance(o, "a", "b").select("n", _r("distance", 9).alias("distance"))


@query("""WITH s AS (SELECT l_quantity::DOUBLE AS x, l_linenumber::DOUBLE AS w, row_number() OVER (ORDER BY l_quantity, l_linenumber) AS rk FROM lineitem),
 c0 AS (SELECT x, rk, sum(w) OVER (ORDER BY rk) - w AS c FROM s),
 c AS (SELECT x, rk, c / max(c) OVER () AS c FROM c0),
 st AS (SELECT x AS x0, lead(x) OVER (ORDER BY rk) AS x1, c AS lo, lead(c) OVER (ORDER BY rk) AS hi FROM c),
 u AS (SELECT o_orderkey, (o_orderkey * 7919 % 99991) / 99991e0 AS u FROM orders)
SELECT o_orderkey, round(x0 + (x1 - x0) * (u - lo) / (hi - lo), 6) AS value FROM u ASOF JOIN st ON u.u >= st.lo""")
def empirical_quantiles(spark, sf):
    """A prior held as all weighted quantities of lineitem, drawn once for each order."""
    s = read(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("w"))
    u = read(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919 % 99991) / 99991.0).alias("u"))
    return pr.empirical_prior(u, "u", pr.quantile_table(s, "x", "w"), "value").select("o_orderkey", _r("value").alias("value"))


@query("""WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY user_id % 2, ts, event_id) AS i, (event_id * 48271 % 2147483647 % 120 + 0.5) / 120 - 0.5 AS d FROM events),
 c AS (SELECT i, sum(d) OVER (ORDER BY i) AS c FROM e UNION ALL SELECT 0, 0),
 walk(i) AS (SELECT 0::BIGINT UNION ALL
   SELECT (SELECT min(b.i) FROM c b, c a WHERE a.i = walk.i AND b.i > walk.i AND abs(b.c - a.c) > 1.5 * sqrt((b.i - a.i) / 12e0)) FROM walk WHERE walk.i IS NOT NULL)
SELECT (SELECT count(*) FROM e) AS rows, count(i) - 1 AS resets, (SELECT count(*) FROM e) - max(i) AS run_length FROM walk""")
def stored_stream_test(spark, sf):
    """Events are appended to a point store twice, and a stream over the store keeps the state of the rank test."""
    import uuid

    from ..sources import datasource
    from ..streaming import drain, order_test

    datasource.register(spark)
    de.materialise(spark.range(1))  # names the shared folder
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/points-{uuid.uuid4().hex}"
    e = read(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_id") * 48271 % 2147483647 % 120).cast("double").alias("rank"))
    for half in (0, 1):
        own = e.where(F.col("user_id") % 2 == half).repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id")
        own.select("rank", F.lit(120.0).alias("n")).write.format(datasource.FORMAT).mode("append").options(path=path).save()
    stream = spark.readStream.format(datasource.FORMAT).options(path=path).load()
    states = drain(order_test(stream.withColumn("run_id", F.lit(1).cast("long")), threshold=1.5), spark)
    return states.agg(F.max_by(F.struct("rows", "resets", "run_length"), "rows").alias("s")).select("s.*")


@query("""WITH long AS (SELECT 'l_quantity' AS param, l_quantity::DOUBLE AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice::DOUBLE FROM lineitem UNION ALL SELECT 'l_tax', l_tax::DOUBLE FROM lineitem),
 ends AS (SELECT param, avg(x) AS mean, stddev_pop(x) AS stdev, min(x) AS a, max(x) AS z FROM long GROUP BY param),
 lim AS (SELECT param, mean, stdev, CASE WHEN param = 'l_tax' THEN greatest(0e0, a - 2 * (z - a) / 40) ELSE a - 2 * (z - a) / 40 END AS lo, z + 2 * (z - a) / 40 AS hi FROM ends),
 h AS (SELECT param, least(floor((x - lo) / (hi - lo) * 39), 38)::INT AS bin, count(*)::DOUBLE AS w FROM long JOIN lim USING (param) GROUP BY ALL)
SELECT param, round(mean, 6) AS mean, round(stdev, 6) AS stdev, greatest(0, 1 - floor(log10(stdev)))::INT AS digits, round(lo, 6) AS lo, round(hi, 6) AS hi, bars
FROM lim JOIN (SELECT param, string_agg(substr(' ▁▂▃▄▅▆▇██', ceil(round(w * 7 / top, 9))::INT + 1, 1), '' ORDER BY bin) AS bars FROM
 (SELECT c.param, c.b AS bin, coalesce(h.w, 0) AS w, max(h.w) OVER (PARTITION BY c.param) AS top FROM (SELECT param, unnest(range(39))::INT AS b FROM lim) c LEFT JOIN h ON h.param = c.param AND h.bin = c.b) GROUP BY param) USING (param)""")
def parameter_report(spark, sf):
    """Mean, spread and text histogram of three columns of lineitem; taxes have a lower limit of 0."""
    out = rp.text_histograms(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], limits={"l_tax": (0.0, float("inf"))})
    return out.select("param", _r("mean").alias("mean"), _r("stdev").alias("stdev"), "digits", _r("lo").alias("lo"), _r("hi").alias("hi"), "bars")


@query("""WITH long AS (SELECT 'c_acctbal' AS param, c_acctbal::DOUBLE AS x FROM customer UNION ALL SELECT 'c_custkey', c_custkey::DOUBLE FROM customer),
 d AS (SELECT param, min(x) AS lo, max(x) AS hi FROM long GROUP BY param),
 e AS (SELECT *, pow(10e0, ceil(log10(greatest(abs(lo), abs(hi))))) AS ten FROM d)
SELECT param, lo, hi, CASE WHEN param = 'c_acctbal' AND lo >= -2000 THEN -2000e0 WHEN lo < 0 THEN -ten ELSE 0e0 END AS lo_rounded, ten AS hi_rounded FROM e""")
def limits_rounded(spark, sf):
    """Rounded limits of balances, whose guess of the lower end holds, and of keys."""
    out = rp.rounded_limits(read(spark, sf, "customer"), ["c_acctbal", "c_custkey"], {"c_acctbal": (-2000.0, 1e9)})
    return out.select("param", "lo", "hi", "lo_rounded", "hi_rounded")
