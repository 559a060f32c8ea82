"""What the summary of a run shows: parameters with their text histograms, rounded limits, traces over the log volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters of a text histogram from empty to full, the height of its fullest bin, and its edges.
BARS = " ▁▂▃▄▅▆▇██"
FULL = 7
EDGES = 40


def _long(df: DataFrame, cols: list[str], weight: str | None) -> DataFrame:
    """(w, param, x) of the values that are numbers and have a positive weight."""
    s = F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.select(w.alias("w"), s.alias("param", "x")).where("w > 0 and x is not null and not isnan(x)")


def _by_param(values: dict[str, float], other: float) -> Column:
    """The value of the row's parameter."""
    out = F.lit(float(other))
    for name, value in values.items():
        out = F.when(F.col("param") == name, F.lit(float(value))).otherwise(out)
    return out


def text_histograms(samples: DataFrame, cols: list[str], weight: str | None = None, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(param, mean, stdev, digits, lo, hi, bars, text) of each parameter.

    ``bars`` has a character for each of EDGES - 1 bins from ``lo`` to ``hi``, which
    are the extremes with a twentieth of their distance on both sides, but not
    beyond the ``limits`` of the parameter; ``digits`` is one more than the spread
    needs. Values beyond the limits count for mean and spread only. Nulls, NaN and
    rows without a positive weight are left out; a constant has a spread of 0 and a
    span of 1. A parameter without values has no row.

    Two passes, each an aggregation with partial sums; what is broadcast has one row a parameter.
    """
    limits = limits or {}
    long = _long(samples, cols, weight)
    mean = F.sum(F.col("w") * F.col("x")) / F.sum("w")
    ends = long.groupBy("param").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), mean.alias("mean"))
    half = F.when(F.col("x0") == F.col("x1"), 0.5).otherwise(0.0)
    ends = ends.select("param", F.when(F.col("x0") == F.col("x1"), F.col("x0")).otherwise(F.col("mean")).alias("mean"), (F.col("x0") - half).alias("a"), (F.col("x1") + half).alias("z"))
    pad = 2 * (F.col("z") - F.col("a")) / EDGES
    low, high = ({p: v[k] for p, v in limits.items()} for k in (0, 1))
    ends = ends.select("param", "mean", F.greatest(_by_param(low, float("-inf")), F.col("a") - pad).alias("lo"), F.least(_by_param(high, float("inf")), F.col("z") + pad).alias("hi"))
    bin_ = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (EDGES - 1)), F.lit(EDGES - 2)).cast("int")
    at = F.when((F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi")), -1).otherwise(bin_)
    off = F.col("x") - F.col("mean")
    h = long.join(F.broadcast(ends), "param").groupBy("param", "mean", "lo", "hi", at.alias("bin")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * off * off).alias("sq"))
    bins = F.map_from_entries(F.collect_list(F.struct("bin", "w")))  # EDGES at most
    out = h.groupBy("param", "mean", "lo", "hi").agg(F.sqrt(F.sum("sq") / F.sum("w")).alias("stdev"), bins.alias("bins"), F.max(F.when(F.col("bin") >= 0, F.col("w"))).alias("top"))

    def bar(b: Column) -> Column:
        height = F.ceil(F.round(F.coalesce(F.try_element_at("bins", b), F.lit(0.0)) * FULL / F.col("top"), 9))
        return F.substr(F.lit(BARS), (F.coalesce(height, F.lit(0)) + 1).cast("int"), F.lit(1))

    digits = F.when(F.col("stdev") == 0, 3).otherwise(F.greatest(F.lit(0), 1 - F.floor(F.log10("stdev")))).cast("int")
    out = out.select("param", "mean", "stdev", digits.alias("digits"), "lo", "hi", F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(EDGES - 2)), bar)).alias("bars"))
    one = F.concat(F.lit("%."), F.col("digits").cast("string"), F.lit("f"))
    shown = lambda c: F.call_function("format_string", one, F.col(c))
    return out.withColumn("text", F.concat("param", F.lit(": "), shown("lo"), F.lit("│"), "bars", F.lit("│"), shown("hi"), F.lit("  "), shown("mean"), F.lit(" +- "), shown("stdev")))


def rounded_limits(df: DataFrame, cols: list[str], guess: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(param, lo, hi, lo_rounded, hi_rounded, format) of each parameter's extremes, in one pass.

    The rounded upper end is the next power of ten of the greater magnitude, the
    lower end 0, or minus the upper end if there are negative values. A ``guess``
    that lies between an extreme and its rounded end takes that end's place.
    ``format`` tells the two extremes apart. Nulls and NaN are left out; a parameter
    without values has no row.
    """
    guess = guess or {}
    d = _long(df, cols, None).groupBy("param").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    magnitude = [F.when(F.col(c) == 0, float("-inf")).otherwise(F.log10(F.abs(c))) for c in ("lo", "hi")]
    d = d.withColumn("e0", F.floor(F.least(*magnitude))).withColumn("e1", F.ceil(F.greatest(*magnitude)))
    ten = F.pow(F.lit(10.0), F.col("e1").cast("double"))
    d = d.withColumn("hi_rounded", ten).withColumn("lo_rounded", F.when(F.col("lo") < 0, -ten).otherwise(0.0))
    g0, g1 = (_by_param({p: v[k] for p, v in guess.items()}, float("nan")) for k in (0, 1))
    d = d.withColumn("lo_rounded", F.when(~F.isnan(g0) & g0.between(F.col("lo_rounded"), F.col("lo")), g0).otherwise(F.col("lo_rounded")))
    d = d.withColumn("hi_rounded", F.when(~F.isnan(g1) & g1.between(F.col("hi"), F.col("hi_rounded")), g1).otherwise(F.col("hi_rounded")))

    def within(a: int, z: int) -> Column:
        return F.col("e0").between(a, z) & F.col("e1").between(a, z)

    def fixed(places: Column) -> Column:
        return F.concat(F.lit("%+."), F.greatest(F.lit(0).cast("long"), places).cast("string"), F.lit("f"))

    form = F.when(within(-4, 0), fixed(-F.least("e0", "e1"))).when(within(-1, 2), "%+.1f").otherwise("%+.1e")
    d = d.withColumn("format", form)
    shown = [F.call_function("format_string", F.col("format"), F.col(c)) for c in ("lo", "hi")]
    apart = F.when(F.col("hi") > F.col("lo"), F.log10(F.col("hi") - F.col("lo")))
    form = F.when(F.col("hi") == F.col("lo"), "%+.1f").when(shown[0] == shown[1], fixed(-F.floor(apart))).otherwise(F.col("format"))
    return d.select("param", "lo", "hi", "lo_rounded", "hi_rounded", form.alias("format"))
