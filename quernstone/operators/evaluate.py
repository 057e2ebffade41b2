"""Evaluation of predictions: binary, multi-label, hierarchical, diagnostic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.operators.stats import share


def confusion(df: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """One row: tp, tn, fp, fn."""
    g, p = F.col(gt) == 1, F.col(pred) == 1
    return df.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & ~p).alias("tn"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))


def binary_report(df: DataFrame, gt: str = "gt", pred: str = "pred", digits: int = 6) -> DataFrame:
    """(name, precision, recall, f1, support) of both classes, accuracy, macro and weighted averages; 0 where a ratio has no base."""
    c = confusion(df, gt, pred)

    def row(name: str, hit: str, wrong: str, missed: str) -> Column:
        p, r = share(F.col(hit), F.col(hit) + F.col(wrong)), share(F.col(hit), F.col(hit) + F.col(missed))
        return F.struct(F.lit(name).alias("name"), p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"), (F.col(hit) + F.col(missed)).alias("support"))

    c = c.select("*", row("safe", "tn", "fn", "fp").alias("a"), row("vulnerable", "tp", "fp", "fn").alias("b"))
    n = F.col("a.support") + F.col("b.support")
    right = share(F.col("tp") + F.col("tn"), n)
    parts = ("precision", "recall", "f1")
    macro = F.struct(F.lit("macro avg").alias("name"), *(((F.col(f"a.{k}") + F.col(f"b.{k}")) / 2).alias(k) for k in parts), n.alias("support"))
    heavy = F.struct(F.lit("weighted avg").alias("name"), *(share(F.col(f"a.{k}") * F.col("a.support") + F.col(f"b.{k}") * F.col("b.support"), n).alias(k) for k in parts), n.alias("support"))
    accuracy = F.struct(F.lit("accuracy").alias("name"), *(right.alias(k) for k in parts), n.alias("support"))
    return c.select(F.inline(F.array("a", "b", accuracy, macro, heavy))).select("name", *(F.round(k, digits).alias(k) for k in parts), "support")


def label_pairs(df: DataFrame, gt: str = "gt_cwes", pred: str = "pred_cwes", key: str = "id") -> DataFrame:
    """(id, label, g, p): for each row the labels of truth and prediction, of the truth's vocabulary only."""
    each = df.select(F.col(key).alias("id"), F.col(gt).alias("__g"), F.col(pred).alias("__p"), F.explode(F.array_union(gt, pred)).alias("label"))
    vocabulary = df.select(F.explode(gt).alias("label")).distinct()
    return each.join(vocabulary, "label", "left_semi").select("id", "label", F.array_contains("__g", F.col("label")).cast("int").alias("g"), F.array_contains("__p", F.col("label")).cast("int").alias("p"))


def label_report(df: DataFrame, gt: str = "gt_cwes", pred: str = "pred_cwes", key: str = "id", digits: int = 6) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, support)."""
    c = label_pairs(df, gt, pred, key).groupBy("label").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("label", "tp", "fp", "fn", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), digits).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def label_averages(df: DataFrame, gt: str = "gt_cwes", pred: str = "pred_cwes", key: str = "id", digits: int = 6) -> DataFrame:
    """(average, precision, recall, f1): micro, macro, weighted, and over samples (rows without labels on either side count 0)."""
    long = label_pairs(df, gt, pred, key)
    c = long.groupBy("label").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    c = c.withColumn("s", F.col("tp") + F.col("fn")).withColumn("p", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", share(F.col("tp"), F.col("s"))).withColumn("f", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")

    def line(name: str, p: Column, r: Column, f: Column) -> Column:
        return F.struct(F.lit(name).alias("average"), F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f, digits).alias("f1"))

    weigh = lambda k: share(F.sum(F.col(k) * F.col("s")), F.sum("s"))
    one = c.agg(F.array(line("micro", share(tp, tp + fp), share(tp, tp + fn), share(2 * tp, 2 * tp + fp + fn)), line("macro", F.avg("p"), F.avg("r"), F.avg("f")), line("weighted", weigh("p"), weigh("r"), weigh("f"))).alias("x"))
    each = long.groupBy("id").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("p").alias("np"), F.sum("g").alias("ng"))
    rows = df.select(F.col(key).alias("id")).join(each, "id", "left").na.fill(0)
    samples = rows.agg(line("samples", F.avg(share(F.col("tp"), F.col("np"))), F.avg(share(F.col("tp"), F.col("ng"))), F.avg(share(2 * F.col("tp"), F.col("np") + F.col("ng")))).alias("x"))
    return one.select(F.inline("x")).union(samples.select("x.*"))


def acceptable(gt: Column, pred: Column, hierarchy: Mapping[int, Sequence[int]]) -> Column:
    """Each true label is predicted itself, by its parent or by a child; without true labels nothing may be predicted."""
    near: dict[int, set[int]] = {}
    for above, below in ((a, b) for a, under in hierarchy.items() for b in under):
        near.setdefault(above, set()).add(below)
        near.setdefault(below, set()).add(above)
    table = F.create_map(*(x for k, v in sorted(near.items()) for x in (F.lit(k), F.array(*map(F.lit, sorted(v)))))) if near else F.lit(None).cast("map<int,array<int>>")
    covered = F.forall(gt, lambda g: F.array_contains(pred, g) | F.coalesce(F.arrays_overlap(F.try_element_at(table, g), pred), F.lit(False)))
    return F.when(F.size(gt) == 0, F.size(pred) == 0).otherwise(covered)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def hierarchical(df: DataFrame, hierarchy: Mapping[int, Sequence[int]], gt: str = "gt_cwes", pred: str = "pred_cwes", digits: int = 6) -> DataFrame:
    """One row over rows with true labels: strict and hierarchical matches, their rates and the gain."""
    strict, loose = same_set(F.col(gt), F.col(pred)), acceptable(F.col(gt), F.col(pred), hierarchy)
    got = df.filter(F.size(gt) > 0).agg(F.count("*").alias("n"), F.count_if(strict).alias("strict"), F.count_if(strict | loose).alias("hierarchical"))
    return got.select("n", "strict", "hierarchical", F.round(share(F.col("strict"), F.col("n")), digits).alias("strict_rate"), F.round(share(F.col("hierarchical"), F.col("n")), digits).alias("hierarchical_rate"), F.round(share(F.col("hierarchical") - F.col("strict"), F.col("n")), digits).alias("gain"))


def patterns(df: DataFrame, n: int = 10, gt: str = "gt_cwes", pred: str = "pred_cwes") -> DataFrame:
    """The n most frequent (truth, prediction) pairs of differing label sets."""
    text = lambda c: F.concat_ws(",", F.transform(F.array_sort(F.array_distinct(c)), lambda x: x.cast("string")))
    wrong = df.filter((F.size(gt) > 0) & ~same_set(F.col(gt), F.col(pred)))
    return wrong.groupBy(text(gt).alias("truth"), text(pred).alias("prediction")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "truth", "prediction").limit(n)


def performers(report: DataFrame, n: int = 5) -> DataFrame:
    """The n best and the n worst labels by f1 among those with support, marked."""
    some = report.filter("support > 0")
    best = some.orderBy(F.desc("f1"), F.desc("support"), "label").limit(n).withColumn("end", F.lit("top"))
    return best.unionByName(some.orderBy("f1", F.desc("support"), "label").limit(n).withColumn("end", F.lit("bottom")))


def errors(df: DataFrame, gt: str = "gt", pred: str = "pred", digits: int = 6) -> DataFrame:
    """One row: false positives, false negatives, error rate."""
    return confusion(df, gt, pred).select("fp", "fn", F.round(share(F.col("fp") + F.col("fn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), digits).alias("error_rate"))


def diagnose(df: DataFrame, hierarchy: Mapping[int, Sequence[int]], generic: Sequence[int], expected: str = "expected", accepted: str = "accepted", pred: str = "predicted", error: str | None = None) -> DataFrame:
    """Adds is_exact, is_acceptable, is_over_generalized, is_false_negative, is_false_positive, is_hierarchical and status.

    Exact is an overlap with what is expected (or both empty); over-generalised a miss that names a generic label
    among the acceptable ones.
    """
    e, a, p = F.col(expected), F.col(accepted), F.col(pred)
    none_e, none_p = F.size(e) == 0, F.size(p) == 0
    overlap = lambda x, y: F.coalesce(F.arrays_overlap(x, y), F.lit(False))
    exact = F.when(none_e, none_p).otherwise(overlap(e, p))
    good = F.when(none_e, none_p).otherwise(overlap(F.array_union(e, a), p))
    wide = ~exact & overlap(F.array(*map(F.lit, generic)), p) & overlap(a, p)
    failed = F.col(error).isNotNull() if error else F.lit(False)
    status = F.when(failed, "ERROR").when(none_e & none_p, "CORRECT").when(none_e, "FP").when(none_p, "FN").when(exact, "EXACT").when(wide, "OVER-GEN").when(good, "ACCEPT").otherwise("WRONG")
    return df.withColumns({"is_exact": exact, "is_acceptable": good, "is_over_generalized": wide, "is_false_negative": ~none_e & none_p, "is_false_positive": none_e & ~none_p, "is_hierarchical": acceptable(e, p, hierarchy), "status": status})


def diagnostic_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts over diagnose()'s result, by category if named."""
    n = lambda c: F.count_if(F.col(c)).alias(c[3:])
    return df.groupBy(*by).agg(F.count("*").alias("total"), *(n(c) for c in ("is_exact", "is_acceptable", "is_hierarchical", "is_over_generalized", "is_false_negative", "is_false_positive")), F.count_if(F.col("status") == "ERROR").alias("errors"))


def verdict_warning(vulnerable: Column, labels: Column) -> Column:
    """Warning for a verdict whose labels contradict it, else null."""
    size = F.coalesce(F.size(labels), F.lit(0))
    return F.when(vulnerable & (size <= 0), "vulnerable_without_labels").when(~vulnerable & (size > 0), "safe_with_labels")
