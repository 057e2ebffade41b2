"""Predicates and filters over labelled samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.operators.labels import MISSING, frequencies, number, sanitize
from quernstone.session import cut

#: Phrases by which a text shows that it knew the label, compared in lower case.
LEAKS = tuple("known outcome|as per the label|the label states|the label indicates|according to the label|specified cwe".split("|"))


def blank(column: Column) -> Column:
    """True where a text has nothing but white space; null counts as blank."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"^\s+|\s+$", "") == ""


def valid_labels(labels: str = "cwe", texts: str = "cwe_desc") -> Column:
    """Labels and descriptions are there and every description says something."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return size(labels) & size(texts) & F.coalesce(F.forall(texts, lambda x: ~blank(x) & (x != MISSING)), F.lit(False))


def valid_for_training(target: str = "target", labels: str = "cwe", texts: str = "cwe_desc") -> Column:
    """Rows of target 0 pass; all others must have valid labels."""
    return F.coalesce((F.col(target) == 0) | valid_labels(labels, texts), F.lit(False))


def drop_fields(df: DataFrame, fields: Sequence[str] = ("agreement", "quality_score", "per_judge_evaluations")) -> DataFrame:
    return df.drop(*fields)


def clear_safe(df: DataFrame, columns: Sequence[str] = ("cwe", "cwe_desc"), target: str = "target") -> DataFrame:
    """Empties the columns of rows whose target is 0."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(F.col(target) == 0, F.array().cast(kinds[c])).otherwise(F.col(c)) for c in columns if c in kinds})


def leaks_label(text: Column, phrases: Sequence[str] = LEAKS) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*(F.lit(p.lower()) for p in phrases)), lambda p: F.contains(low, p))


def split_contaminated(df: DataFrame, text: str = "reasoning", phrases: Sequence[str] = LEAKS) -> tuple[DataFrame, DataFrame]:
    """(clean, contaminated) rows."""
    bad = leaks_label(F.col(text), phrases)
    return df.filter(~bad), df.filter(bad)


def contamination_summary(df: DataFrame, text: str = "reasoning", target: str = "target", phrases: Sequence[str] = LEAKS) -> DataFrame:
    """Totals, share, and class counts of the clean rows, in one pass."""
    bad = leaks_label(F.col(text), phrases)
    out = df.agg(F.count("*").alias("total"), F.count_if(bad).alias("contaminated"), F.count_if(~bad & (F.col(target) == 1)).alias("clean_vulnerable"), F.count_if(~bad & (F.col(target) == 0)).alias("clean_safe"))
    return out.withColumn("contaminated_pct", F.round(F.coalesce(F.try_divide(F.col("contaminated") * 100.0, F.col("total")), F.lit(0.0)), 4))


def drop_unsubstantiated(df: DataFrame, verdict: str = "verdict", field: str = "unsubstantiated_cwes") -> DataFrame:
    """Rows whose verdict lists nothing in field; the field goes."""
    return df.filter(F.coalesce(F.size(F.col(verdict)[field]), F.lit(0)) <= 0).withColumn(verdict, F.col(verdict).dropFields(field))


def by_frequency(df: DataFrame, above: int, labels: str = "cwe", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, filtered): rows all of whose labels occur more than `above` times in df. A row without labels is kept.

    Rare labels are joined, not collected, so that any number of labels will do.
    """
    rare = frequencies(df, labels).filter(F.col("n") <= above).select("label")
    failed = df.select(F.col(key).alias("__failed"), F.explode(labels).alias("label")).join(rare, "label", "left_semi").select("__failed").distinct()
    hit = df[key] == F.col("__failed")
    return df.join(failed, hit, "left_anti"), df.join(failed, hit, "left_semi")


def iterative_frequency(df: DataFrame, above: int, most_rounds: int = 20, labels: str = "cwe", key: str = "id") -> tuple[DataFrame, DataFrame, list[dict]]:
    """(kept, filtered, log): by_frequency until no row goes, none is left, or most_rounds is reached.

    Rounds work on the (key, label) pairs alone and mark rows; df is joined once at the end.
    """
    pairs = cut(df.select(F.col(key).alias("__id"), F.explode(labels).alias("label")))
    gone, log = None, []
    for turn in range(1, most_rounds + 1):
        rare = pairs.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") <= above).select("label")
        failed = cut(pairs.join(rare, "label", "left_semi").select("__id").distinct())
        count = failed.count()
        log.append({"round": turn, "removed": count})
        if not count:
            break
        gone = failed if gone is None else gone.union(failed)
        pairs = cut(pairs.join(failed, "__id", "left_anti"))
        if pairs.isEmpty():
            break
    if gone is None:
        return df, df.limit(0), log
    hit = df[key] == gone["__id"]
    return df.join(gone, hit, "left_anti"), df.join(gone, hit, "left_semi"), log


def single_frequent_label(counts: DataFrame, df: DataFrame, least: int, labels: str = "cwe", target: str = "target", key: str = "id") -> DataFrame:
    """(key, reason) of every row: safe, kept (one label with at least `least` occurrences), removed_rare, removed_multi, removed_empty or other."""
    often = counts.filter(F.col("n") >= least).select(F.col("label").alias("__often"))
    one = df.withColumn("__one", F.when(F.size(labels) == 1, number(F.col(labels)[0])))
    joined = one.join(often, F.col("__one") == F.col("__often"), "left")
    size = F.size(labels)
    reason = F.when(F.col(target) == 0, "safe").when(F.col(target) != 1, "other").when(size < 1, "removed_empty").when(size > 1, "removed_multi").when(F.col("__often").isNotNull(), "kept").otherwise("removed_rare")
    return joined.select(F.col(key).alias(key), reason.alias("reason"))


def preview(df: DataFrame, counts: DataFrame, least: int, labels: str = "cwe", target: str = "target", key: str = "id") -> DataFrame:
    """Counts of labelled rows: kept (all labels frequent), rare only, and mixed."""
    often = counts.filter(F.col("n") >= least).select(F.col("label").alias("__often"))
    rows = df.filter((F.col(target) == 1) & (F.size(labels) > 0)).select(F.col(key).alias("__id"), F.explode(labels).alias("l")).withColumn("l", number(F.col("l")))
    each = rows.join(often, F.col("l") == F.col("__often"), "left").groupBy("__id").agg(F.count("__often").alias("f"), F.count("*").alias("n"))
    return each.agg(F.count_if(F.col("f") == F.col("n")).alias("kept"), F.count_if(F.col("f") == 0).alias("removed_rare_only"), F.count_if((F.col("f") > 0) & (F.col("f") < F.col("n"))).alias("removed_mixed"))


def route_targets(df: DataFrame, target: str = "target", labels: str = "cwe") -> DataFrame:
    """Adds decision: vulnerable (target 1 with labels), safe (target 0, its labels emptied) or dropped."""
    decision = F.when((F.col(target) == 1) & (F.size(labels) > 0), "vulnerable").when(F.col(target) == 0, "safe").otherwise("dropped")
    return clear_safe(df, (labels,), target).withColumn("decision", decision)


def required_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that df has, in the order of names."""
    return df.select(*(c for c in names if c in df.columns))


def repeated_labels(df: DataFrame, labels: str = "cwe", more_than: int = 1) -> DataFrame:
    """Rows exploded by label, of the labels that occur more than more_than times."""
    rows = df.withColumn("label", F.explode(labels)).drop(labels)
    return rows.join(rows.groupBy("label").agg(F.count("*").alias("__n")).filter(F.col("__n") > more_than).select("label"), "label", "left_semi")


def head_text(column: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(column, 1, n)


def sanitized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: sanitize(F.col(c)) for c in columns})
