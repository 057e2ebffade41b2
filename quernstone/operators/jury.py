"""Aggregation of several judges' evaluations: completeness, scores, agreement, disagreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.operators.stats import share

CRITERIA = tuple("correctness completeness clarity technical_accuracy logical_flow".split())
ENSEMBLE_WEIGHTS = dict(correctness=0.35, completeness=0.25, technical_accuracy=0.20, clarity=0.10, logical_flow=0.10)
ANALYSIS_WEIGHTS = dict(correctness=0.35, completeness=0.25, clarity=0.15, technical_accuracy=0.15, logical_flow=0.10)
METRICS = ("quality_score", *CRITERIA, "confidence")


def last_per_judge(df: DataFrame, order: str, sample: str = "sample_id", judge: str = "judge_name") -> DataFrame:
    """One row for each (sample, judge): the last in order, as when a file's later lines overwrite earlier ones."""
    w = Window.partitionBy(sample, judge).orderBy(F.desc(order))
    return df.withColumn("__i", F.row_number().over(w)).filter("__i = 1").drop("__i")


def complete(samples: DataFrame, evaluations: DataFrame, judges: Sequence[str], key: str = "id", sample: str = "sample_id", judge: str = "judge_name") -> DataFrame:
    """samples that every one of judges has evaluated, with per_judge_evaluations in the order of judges."""
    order = F.array_position(F.array(*map(F.lit, judges)), F.col(judge))
    rest = [c for c in evaluations.columns if c != sample]
    got = evaluations.filter(F.col(judge).isin(list(judges))).groupBy(sample).agg(F.sort_array(F.collect_list(F.struct(order.alias("__o"), *rest))).alias("__e"), F.countDistinct(judge).alias("__n"))
    got = got.filter((F.col("__n") == len(judges)) & (F.size("__e") == len(judges))).select(F.col(sample).alias("__sample"), F.transform("__e", lambda x: x.dropFields("__o")).alias("per_judge_evaluations"))
    return samples.join(got, F.col(key) == F.col("__sample")).drop("__sample")


def exploded(df: DataFrame, key: str = "id", column: str = "per_judge_evaluations") -> DataFrame:
    """(key, one row for each evaluation); rows without evaluations vanish."""
    return df.select(F.col(key).alias("sample_id"), F.inline(column))


def weighted_score(evaluations: DataFrame, weights: Mapping[str, float] = ENSEMBLE_WEIGHTS, judge_weight: Column | None = None, sample: str = "sample_id", digits: int = 6) -> DataFrame:
    """(sample, score): criteria averaged over judges with judge_weight (their confidence by default; equal if all are 0), then combined."""
    w = F.col("confidence") if judge_weight is None else judge_weight
    means = {c: F.coalesce(F.try_divide(F.sum(w * F.col(c)), F.sum(w)), F.avg(c)) for c in weights}
    return evaluations.groupBy(sample).agg(F.round(sum((means[c] * x for c, x in weights.items()), F.lit(0.0)), digits).alias("score"))


def pairs(evaluations: DataFrame, sample: str = "sample_id", judge: str = "judge_name", columns: Sequence[str] = CRITERIA) -> DataFrame:
    """Each pair of judges of a sample once (judge_a < judge_b), with a_ and b_ columns."""
    a = evaluations.select(sample, F.col(judge).alias("judge_a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = evaluations.select(sample, F.col(judge).alias("judge_b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return a.join(b, sample).filter("judge_a < judge_b")


def agreement(evaluations: DataFrame, weights: Mapping[str, float] | None = None, sample: str = "sample_id", judge: str = "judge_name", digits: int = 6) -> DataFrame:
    """(sample, agreement): 1 less the mean distance of judges over the greatest possible, within [0, 1]; 1 for a single judge."""
    scale = {c: (weights or {}).get(c, 1.0) if weights else 1.0 for c in CRITERIA}
    top = sum(x * x for x in scale.values()) ** 0.5
    apart = F.sqrt(sum((F.pow((F.col(f"a_{c}") - F.col(f"b_{c}")) * x, F.lit(2.0)) for c, x in scale.items()), F.lit(0.0)))
    each = pairs(evaluations, sample, judge).groupBy(sample).agg((1 - F.avg(apart) / top).alias("__a"))
    return evaluations.select(sample).distinct().join(each, sample, "left").select(sample, F.round(F.when(F.col("__a").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "__a"))), digits).alias("agreement"))


def rejection(df: DataFrame, least_score: float, least_agreement: float, score: str = "score", agree: str = "agreement") -> DataFrame:
    """Adds rejection_reason, an array that is empty for kept rows."""
    return df.withColumn("rejection_reason", F.array_compact(F.array(F.when(F.col(score) < least_score, F.lit("low_quality")), F.when(F.col(agree) < least_agreement, F.lit("low_agreement")))))


def run_stats(df: DataFrame, score: str = "score", agree: str = "agreement", digits: int = 6) -> DataFrame:
    """One row over rejection()'s result: counts by reason, rates, mean and population deviation of score and agreement."""
    low, apart = F.array_contains("rejection_reason", "low_quality"), F.array_contains("rejection_reason", "low_agreement")
    got = df.agg(F.count("*").alias("total"), F.count_if(F.size("rejection_reason") == 0).alias("kept"), F.count_if(F.size("rejection_reason") > 0).alias("rejected"), F.count_if(low & ~apart).alias("low_quality"), F.count_if(apart & ~low).alias("low_agreement"), F.count_if(low & apart).alias("both"), *(f(c).alias(f"{n}_{c}") for c in (score, agree) for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    return got.select("total", "kept", "rejected", "low_quality", "low_agreement", "both", F.round(share(F.col("kept") * 1.0, F.col("total")), digits).alias("kept_rate"), *(F.round(f"{n}_{c}", digits).alias(f"{n}_{c}") for c in (score, agree) for n in ("mean", "std")))


def titled(column: Column) -> Column:
    return F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))


def medians(evaluations: DataFrame, columns: Sequence[str] = ("quality_score", *CRITERIA), judge: str = "judge_name", digits: int = 6) -> DataFrame:
    """(judge, criterion, median) over all records."""
    long = evaluations.unpivot([judge], list(columns), "criterion", "value")
    return long.groupBy(judge, titled(F.col("criterion")).alias("criterion")).agg(F.round(F.median("value"), digits).alias("median"))


def criteria_means(evaluations: DataFrame, sample: str = "sample_id", columns: Sequence[str] = CRITERIA, digits: int = 6) -> DataFrame:
    return evaluations.groupBy(sample).agg(*(F.round(F.avg(c), digits).alias(c) for c in columns))


def judge_weighted_scores(evaluations: DataFrame, judge_weights: Mapping[str, float], weights: Mapping[str, float] = ANALYSIS_WEIGHTS, sample: str = "sample_id", judge: str = "judge_name", digits: int = 6) -> DataFrame:
    """(sample, score): judges weigh as named, others 0; a sample whose judges weigh nothing scores 0."""
    table = F.create_map(*(F.lit(x) for p in judge_weights.items() for x in p))
    w = F.coalesce(F.try_element_at(table, F.col(judge)), F.lit(0.0))
    return evaluations.groupBy(sample).agg(F.round(sum((share(F.sum(w * F.col(c)), F.sum(w)) * x for c, x in weights.items()), F.lit(0.0)), digits).alias("score"))


def disagreement(evaluations: DataFrame, sample: str = "sample_id", columns: Sequence[str] = METRICS, digits: int = 6) -> DataFrame:
    """By sample: population deviation, range and variation of each metric, and the means of the first two."""
    got = evaluations.groupBy(sample).agg(*(x for c in columns for x in (F.stddev_pop(c).alias(f"{c}_std"), (F.max(c) - F.min(c)).alias(f"{c}_range"), F.avg(c).alias(f"{c}_mean"))))
    cv = lambda c: F.when(F.col(f"{c}_mean") > 0, F.col(f"{c}_std") / F.col(f"{c}_mean")).otherwise(0.0)
    mean = lambda kind: sum((F.col(f"{c}_{kind}") for c in columns), F.lit(0.0)) / len(columns)
    out = {f"{c}_{k}": F.col(f"{c}_{k}") for c in columns for k in ("std", "range")} | {f"{c}_cv": cv(c) for c in columns} | {"avg_std": mean("std"), "avg_range": mean("range")}
    return got.select(sample, *(F.round(x, digits).alias(k) for k, x in out.items()))


def disagreement_level(value: Column) -> Column:
    return F.when(value < 0.1, "low").when(value < 0.3, "moderate").otherwise("high")


def confidence_summary(evaluations: DataFrame, judge: str = "judge_name", value: str = "confidence") -> DataFrame:
    """By judge, the surest first: mean, median, sample deviation, least, most (three digits) and count."""
    return evaluations.groupBy(judge).agg(F.round(F.avg(value), 3).alias("mean"), F.round(F.median(value), 3).alias("median"), F.round(F.stddev_samp(value), 3).alias("std"), F.round(F.min(value), 3).alias("min"), F.round(F.max(value), 3).alias("max"), F.count(value).alias("count")).orderBy(F.desc("mean"), judge)


def pair_disagreement(evaluations: DataFrame, value: str = "confidence", sample: str = "sample_id", judge: str = "judge_name", digits: int = 6) -> DataFrame:
    """(judge_a, judge_b, disagreement): summed absolute differences over the number of all samples."""
    n = evaluations.agg(F.countDistinct(sample).alias("__n"))
    each = pairs(evaluations, sample, judge, (value,)).groupBy("judge_a", "judge_b").agg(F.sum(F.abs(F.col(f"a_{value}") - F.col(f"b_{value}"))).alias("d"))
    return each.crossJoin(F.broadcast(n)).select("judge_a", "judge_b", F.round(F.col("d") / F.col("__n"), digits).alias("disagreement"))


def short_name(column: Column, names: Mapping[str, str]) -> Column:
    """Short name of a judge; null for one that names does not have."""
    return F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), column)


def file_judge(column: Column) -> Column:
    """Judge name from a file's stem."""
    return F.replace(F.replace(F.replace(column, F.lit("_vul"), F.lit("")), F.lit("_safe"), F.lit("")), F.lit("_"), F.lit("-"))
