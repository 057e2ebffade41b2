"""Descriptive statistics: percentiles, histograms, distributions, inequality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

PERCENTILES = tuple(p / 100 for p in (25, 50, 75, 90, 95, 99))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def describe(df: DataFrame, value: str, percentiles: Sequence[float] = PERCENTILES, sample: bool = True, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Count, mean, standard deviation (of a sample or of the population), least, exact percentiles, most."""
    spread = F.stddev_samp if sample else F.stddev_pop
    got = df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), spread(value).alias("std"), F.min(value).alias("min"), F.percentile(value, list(percentiles)).alias("__p"), F.max(value).alias("max"))
    rounded = [F.round(F.col(c).cast("double"), digits).alias(c) for c in ("mean", "std", "min", "max")]
    return got.select(*by, "count", *rounded, *(F.round(F.col("__p")[i], digits).alias(_name(p)) for i, p in enumerate(percentiles)))


def over_limits(df: DataFrame, value: str, limits: Sequence[int] = (1024, 2048, 3072, 4096, 6144, 8192)) -> DataFrame:
    """(limit, pct): share of rows above each limit, in one pass."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(value) > k).alias(f"k{k}") for k in limits))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("limit"), F.round(share(F.col(f"k{k}") * 100.0, F.col("n")), 4).alias("pct")) for k in limits))).alias("x")).select("x.*")


def recommended_lengths(df: DataFrame, value: str, step: int = 512) -> DataFrame:
    """p95, p99 and the most, rounded up to multiples of step."""
    up = lambda c: (F.ceil(c / step) * step).cast("long")
    got = df.agg(F.percentile(value, [0.95, 0.99]).alias("p"), F.max(value).alias("m"))
    return got.select(up(F.col("p")[0]).alias("balanced"), up(F.col("p")[1]).alias("conservative"), up(F.col("m")).alias("full"))


def correlation(df: DataFrame, x: str, y: str, digits: int = 4) -> DataFrame:
    """Pearson's r, R squared and the least-squares line of y on x."""
    return df.agg(F.round(F.corr(x, y), digits).alias("r"), F.round(F.corr(x, y) * F.corr(x, y), digits).alias("r2"), F.round(F.regr_slope(y, x), digits).alias("slope"), F.round(F.regr_intercept(y, x), digits).alias("intercept"))


def token_summary(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 1).alias("avg"), F.count(value).alias("count"))


def by_variant(df: DataFrame, variant: str, value: str) -> DataFrame:
    """Comparison table of variants (tokenizers, models): population statistics of value."""
    return describe(df, value, (0.5, 0.95, 0.99), sample=False, by=(variant,))


def ecdf(df: DataFrame, value: str, key: str) -> DataFrame:
    """(key, value, cdf): i / n in order of value, ties in order of key.

    Ranks within equal ranges come from a range partition of the values and an offset for each partition, so no
    single task sorts the whole table.
    """
    rows = df.select(key, value).filter(F.col(value).isNotNull()).repartitionByRange(F.col(value), F.col(key)).sortWithinPartitions(value, key)
    part = rows.withColumn("__part", F.spark_partition_id()).withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy(value, key)))
    size = part.groupBy("__part").agg(F.count("*").alias("__n"))
    ahead = size.withColumn("__ahead", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__total", F.sum("__n").over(Window.partitionBy()))
    return part.join(F.broadcast(ahead), "__part").select(key, value, F.round((F.col("__i") + F.col("__ahead")) / F.col("__total"), 6).alias("cdf"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, n): equal widths between the least and the most value, the last bin closed on the right; bins without rows are left out."""
    ends = df.agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    at = F.floor((F.col(value) - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / bins))
    spot = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.greatest(F.lit(0), at)))
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(spot.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def inequality(counts: DataFrame, n: str = "n", digits: int = 6) -> DataFrame:
    """Gini coefficient and base-2 entropy of a table of counts (one row for each label, so of the labels' number)."""
    run = Window.orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("__cum", F.sum(n).over(run)).withColumn("__total", F.sum(n).over(Window.partitionBy()))
    p = F.col(n) / F.col("__total")
    return rows.agg(F.count("*").alias("labels"), F.max("__total").alias("total"), F.round((F.count("*") + 1 - 2 * F.sum(F.col("__cum") / F.col("__total"))) / F.count("*"), digits).alias("gini"), F.round(-F.sum(p * F.log2(p)), digits).alias("entropy"))


def percentiles(df: DataFrame, value: str, points: Sequence[float] = PERCENTILES[:-1]) -> DataFrame:
    """(point, value) rows of exact percentiles."""
    got = df.agg(F.percentile(value, list(points)).alias("p"))
    return got.select(F.posexplode("p").alias("i", "v")).select(F.element_at(F.array(*map(F.lit, points)), F.col("i") + 1).alias("point"), F.round("v", 6).alias("value"))


def class_counts(df: DataFrame, target: str = "target") -> DataFrame:
    return df.groupBy(target).agg(F.count("*").alias("n"))


def bottom_top(counts: DataFrame, k: int, label: str = "label", n: str = "n") -> DataFrame:
    """The k most and the k least frequent labels, marked; ties in order of label."""
    most = counts.orderBy(F.desc(n), F.asc(label)).limit(k).withColumn("end", F.lit("top"))
    least = counts.orderBy(F.asc(n), F.asc(label)).limit(k).withColumn("end", F.lit("bottom"))
    return most.unionByName(least)
