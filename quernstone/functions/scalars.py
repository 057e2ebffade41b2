"""Small scalar functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def duration(seconds: Column) -> Column:
    """hh:mm:ss"""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits), F.lit("%"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def find_sequence(ids: Column, marker: Sequence[int]) -> Column:
    """0-based position of the first occurrence of marker in ids, null if there is none."""
    m = F.array(*map(F.lit, marker))
    last = F.size(ids) - len(marker)
    at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (last >= 0) & (F.slice(ids, i + 1, len(marker)) == m))
    return F.when(F.lit(len(marker) > 0), F.try_element_at(at, F.lit(1)))


def weight_mask(ids: Column, labels: Column, marker: Sequence[int], reasoning: float = 1.0, answer: float = 1.5, ignored: int = -100) -> Column:
    """Weight of each token: 0 where ignored, reasoning before the answer marker, answer from it on.

    A marker before the first counted token does not count.
    """
    first = F.array_position(F.transform(labels, lambda x: (x != ignored).cast("int")), 1) - 1
    at = find_sequence(ids, marker)
    begin = F.when(at >= first, at)
    return F.transform(labels, lambda x, i: F.when(x == ignored, 0.0).when(begin.isNotNull() & (i >= begin), float(answer)).otherwise(float(reasoning)))


def weighted_mean(losses: Column, weights: Column) -> Column:
    """Sum of products over the sum of weights, 0 where nothing weighs."""
    zero = F.lit(0.0)
    total = F.aggregate(F.zip_with(losses, weights, lambda a, b: a.cast("double") * b), zero, lambda s, x: s + x)
    base = F.aggregate(F.transform(weights, lambda x: x.cast("double")), zero, lambda s, x: s + x)
    return F.coalesce(F.try_divide(total, base), zero)


def pair_distances(rows: Column) -> Column:
    """Euclidean distances of all pairs of an array of vectors, in order of (i, j), i < j."""
    n = F.size(rows)
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    index = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i < n)
    return F.flatten(F.transform(index, lambda i: F.transform(F.slice(rows, i + 1, n - i), lambda v: gap(F.element_at(rows, i), v))))


def training_steps(rows: Column, batch: int, accumulation: int, epochs: int, warmup: float, evals: int = 4, least: int = 50) -> Column:
    """Struct of steps_per_epoch, total_steps, warmup_steps, eval_steps."""
    each = F.floor(rows / (batch * accumulation)).cast("long")
    return F.struct(each.alias("steps_per_epoch"), (each * epochs).alias("total_steps"), F.floor(each * epochs * warmup).cast("long").alias("warmup_steps"), F.greatest(F.floor(each / evals).cast("long"), F.lit(least).cast("long")).alias("eval_steps"))
