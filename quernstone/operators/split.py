"""Group-disjoint splits: profiles, label risk, greedy assignment, leakage, coverage, set regions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from quernstone.operators.stats import share

SPLITS = ("train", "val", "test")


def profiles(df: DataFrame, group: str = "project", target: str = "target", labels: str = "cwe") -> DataFrame:
    """(project, vulnerable, clean, cwe_counts) of each group; labels of vulnerable rows only."""
    sizes = df.groupBy(group).agg(F.count_if(F.col(target) == 1).alias("vulnerable"), F.count_if(F.col(target) != 1).alias("clean"))
    counts = group_labels(df, group, target, labels).groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("cwe_counts"))
    return sizes.join(counts, group, "left")


def group_labels(df: DataFrame, group: str = "project", target: str = "target", labels: str = "cwe") -> DataFrame:
    """(project, label, n) over vulnerable rows."""
    return df.filter(F.col(target) == 1).select(group, F.explode(labels).alias("label")).groupBy(group, "label").agg(F.count("*").alias("n"))


def label_risk(counts: DataFrame, least: int = 30, group: str = "project") -> DataFrame:
    """(label, total, groups, most, concentration, guaranteed, risk) from (project, label, n)."""
    each = counts.groupBy("label").agg(F.sum("n").alias("total"), F.count("*").alias("groups"), F.max("n").alias("most"))
    each = each.withColumn("concentration", F.round(F.col("most") / F.col("total"), 6)).withColumn("guaranteed", F.col("total") - F.col("most"))
    return each.withColumn("risk", F.when(F.col("groups") == 1, "CRITICAL").when(F.col("guaranteed") < least, "HIGH").when(F.col("most") / F.col("total") > 0.7, "MEDIUM").otherwise("LOW"))


def rare_labels(counts: DataFrame, least: int, train_size: float) -> DataFrame:
    """Labels of (label, n) that a training part of train_size would hold less than least times."""
    return counts.filter(F.col("n") < least / train_size)


def assign_groups(df: DataFrame, test: float = 0.1, val: float = 0.1, least: int = 30, seed: int = 42, group: str = "project", target: str = "target", labels: str = "cwe") -> DataFrame:
    """(project, split). Sole sources of a label train; then, for labels at risk, their largest groups until least is reached; the rest, in hashed order, goes where test or val needs most.

    The driver holds one row for each group. Labels come to it only where they decide something: those of a single
    group, and those at risk, of which at most least groups beside the largest have any.
    """
    size = {r[group]: (r.vulnerable, r.clean) for r in df.groupBy(group).agg(F.count_if(F.col(target) == 1).alias("vulnerable"), F.count_if(F.col(target) != 1).alias("clean")).collect()}
    counts = group_labels(df, group, target, labels)
    risky = counts.groupBy("label").agg(F.count("*").alias("__k"), (F.sum("n") - F.max("n")).alias("__g")).filter((F.col("__k") == 1) | (F.col("__g") < least))
    own: dict[str, dict[str, int]] = {}
    of: dict[str, dict[str, int]] = {}
    for r in counts.join(risky, "label").collect():
        own.setdefault(r.label, {})[r[group]] = r.n
        of.setdefault(r[group], {})[r.label] = r.n
    train: set[str] = set()
    have: dict[str, int] = {}

    def take(name: str) -> None:
        train.add(name)
        for label, n in of.get(name, {}).items():
            have[label] = have.get(label, 0) + n

    for label in sorted(own):
        if len(own[label]) == 1 and (name := next(iter(own[label]))) not in train:
            take(name)
    guaranteed = {label: sum(g.values()) - max(g.values()) for label, g in own.items()}
    for label in sorted((x for x in own if len(own[x]) > 1 and guaranteed[x] < least), key=lambda x: (guaranteed[x], x)):
        for name, _ in sorted(own[label].items(), key=lambda x: (-x[1], x[0])):
            if have.get(label, 0) >= least:
                break
            if name not in train:
                take(name)
    total = [sum(s[i] for s in size.values()) for i in (0, 1)]
    aim = {"test": [int(t * test) for t in total], "val": [int(t * val) for t in total]}
    got = {"test": [0, 0], "val": [0, 0]}
    out = [(name, "train") for name in sorted(train)]
    for name in sorted((n for n in size if n not in train), key=lambda n: hashlib.md5(f"{n}:{seed}".encode()).hexdigest()):
        need = {s: sum(max(0, aim[s][i] - got[s][i]) for i in (0, 1)) for s in aim}
        full = {s: all(got[s][i] >= aim[s][i] * 1.2 for i in (0, 1)) for s in aim}
        where = "train" if all(full.values()) or not any(need.values()) else "val" if full["test"] or (not full["val"] and need["val"] > need["test"]) else "test"
        if where != "train":
            got[where] = [g + s for g, s in zip(got[where], size[name])]
        out.append((name, where))
    return df.sparkSession.createDataFrame(out, f"{group} string, split string")


def split_rows(df: DataFrame, assignment: DataFrame, group: str = "project") -> DataFrame:
    """df with the split of its group. Whether the assignment is broadcast is left to its size."""
    return df.join(assignment, group)


def coverage(df: DataFrame, labels: str = "cwe", split: str = "split", splits: Sequence[str] = SPLITS, least: int = 0) -> DataFrame:
    """(label, one count for each split, total, short): label counts by split; short if train holds less than least."""
    out = df.select(split, F.explode(labels).alias("label")).groupBy("label").pivot(split, list(splits)).count().na.fill(0)
    return out.withColumn("total", sum((F.col(s) for s in splits), F.lit(0))).withColumn("short", F.col(splits[0]) < least)


def split_sizes(df: DataFrame, group: str = "project", split: str = "split") -> DataFrame:
    """(split, groups, pct_groups, rows, rows_per_group), and a row of totals from a rollup of the split."""
    got = df.rollup(split).agg(F.countDistinct(group).alias("groups"), F.count("*").alias("rows"), F.grouping(split).alias("__all"))
    whole = F.max(F.when(F.col("__all") == 1, F.col("groups"))).over(Window.partitionBy())
    return got.select(F.when(F.col("__all") == 1, "all").otherwise(F.col(split)).alias("split"), "groups", F.round(share(F.col("groups") * 100.0, whole), 4).alias("pct_groups"), "rows", F.round(share(F.col("rows"), F.col("groups")), 4).alias("rows_per_group"))


def membership(df: DataFrame, group: str = "project", split: str = "split", splits: Sequence[str] = SPLITS) -> DataFrame:
    """(project, in_<split> ...)"""
    return df.groupBy(group).agg(*(F.max((F.col(split) == s).cast("int")).alias(f"in_{s}") for s in splits))


def leakage(df: DataFrame, group: str = "project", split: str = "split") -> DataFrame:
    """One row: sizes of the pairwise and triple intersections and of the union of the splits' groups."""
    m = membership(df, group, split)
    both = lambda a, b: F.count_if((F.col(f"in_{a}") == 1) & (F.col(f"in_{b}") == 1))
    return m.agg(both("train", "val").alias("train_val"), both("train", "test").alias("train_test"), both("val", "test").alias("val_test"), F.count_if((F.col("in_train") + F.col("in_val") + F.col("in_test")) == 3).alias("all_three"), F.count("*").alias("union"))


def regions(df: DataFrame, group: str = "project", split: str = "split") -> DataFrame:
    """(in_train, in_val, in_test, n): the regions of the Venn diagram."""
    return membership(df, group, split).groupBy("in_train", "in_val", "in_test").agg(F.count("*").alias("n"))
