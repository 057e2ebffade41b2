"""Balancing: quantile filters, median-centred selection, quantile bins, stratified and fallback sampling, oversampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from quernstone.operators.labels import frequencies


#: Cells of the unit interval by which draws find their label.
DRAW_CELLS = 4096


def hashed(key: str, seed: int) -> Column:
    """A pseudo-random order that does not depend on partitioning and can be had in SQL."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def quantile_range(df: DataFrame, tokens: str = "token_count", complexity: str = "complexity", low: float = 0.05, high: float = 0.99, floor: int = 3) -> DataFrame:
    """Rows whose token count and complexity lie between their quantiles, complexity at least floor."""
    ends = df.agg(F.percentile(tokens, [low, high]).alias("__t"), F.percentile(complexity, [low, high]).alias("__c"))
    joined = df.crossJoin(F.broadcast(ends))
    return joined.filter(F.col(tokens).between(F.col("__t")[0], F.col("__t")[1]) & F.col(complexity).between(F.greatest(F.lit(float(floor)), F.col("__c")[0]), F.col("__c")[1])).drop("__t", "__c")


def rank_slice(df: DataFrame, with_begin: Callable[[DataFrame, WindowSpec], DataFrame], n: int, by: Sequence[str], value: str, key: str) -> DataFrame:
    """Rows of each group whose position in the order of (value, key) is begin .. begin + n - 1; a group of at most n rows whole.

    with_begin adds __begin to the counts by value (__v the value, __c its rows, __upto the rows up to it, __n the size of
    the group), given the window of a group. Only these counts are sorted over a whole group; the rows that have a value
    of the slice are then ranked among themselves, so that no task sorts a large group.
    """
    names = [f"__g{i}" for i in range(len(by))]
    w = Window.partitionBy(*names)
    counts = df.groupBy(*(F.col(c).alias(g) for c, g in zip(by, names)), F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    counts = counts.withColumn("__n", F.sum("__c").over(w)).withColumn("__upto", F.sum("__c").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("__upto") - F.col("__c")
    counts = with_begin(counts, w).filter((F.col("__n") <= n) | ((F.col("__upto") > F.col("__begin")) & (first < F.col("__begin") + n)))
    counts = counts.withColumn("__ahead", F.min(first).over(w)).select("__v", "__n", "__begin", "__ahead", *names)
    on = F.col(value).eqNullSafe(F.col("__v"))
    for c, g in zip(by, names):
        on = on & F.col(c).eqNullSafe(F.col(g))
    rows = df.join(counts, on).withColumn("__i", F.row_number().over(w.orderBy(value, key)) - 1 + F.col("__ahead"))
    return rows.filter((F.col("__n") <= n) | ((F.col("__i") >= F.col("__begin")) & (F.col("__i") < F.col("__begin") + n))).select(*df.columns)


def median_centred(df: DataFrame, n: int, by: Sequence[str] = (), value: str = "token_count", key: str = "id") -> DataFrame:
    """At most n rows of each group around the middle position; a group of at most n rows is taken whole."""
    begin = F.greatest(F.lit(0), F.least(F.floor(F.col("__n") / 2) - n // 2, F.col("__n") - n))
    return rank_slice(df, lambda counts, w: counts.withColumn("__begin", begin), n, by, value, key)


def around_median(df: DataFrame, n: int, by: Sequence[str] = (), value: str = "token_count", key: str = "id") -> DataFrame:
    """The row nearest the median value, n // 2 rows before it and the rest after it, shifted at either end; a group of at most n rows whole.

    Null values stand before all others and have no part in the median.
    """

    def with_begin(counts: DataFrame, w: WindowSpec) -> DataFrame:
        first, size = F.col("__upto") - F.col("__c"), F.col("__n")
        counts = counts.withColumn("__some", F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__c"))).over(w), F.lit(0)))
        at = lambda k: F.max(F.when((first <= k) & (F.col("__upto") > k), F.col("__v"))).over(w)
        counts = counts.withColumn("__median", (at(size - F.col("__some") + F.floor((F.col("__some") - 1) / 2)) + at(size - F.col("__some") + F.floor(F.col("__some") / 2))) / 2)
        near = F.when(F.col("__v").isNotNull(), F.struct(F.abs(F.col("__v") - F.col("__median")).alias("d"), first.alias("i")))
        counts = counts.withColumn("__at", F.coalesce(F.min(near).over(w)["i"], F.lit(0)))
        return counts.withColumn("__begin", F.greatest(F.lit(0), F.least(F.col("__at") - n // 2, size - n)))

    return rank_slice(df, with_begin, n, by, value, key)


def per_label_selection(df: DataFrame, n: int, least: int, labels: str = "cwe", value: str = "token_count", key: str = "id") -> DataFrame:
    """Rows selected by median_centred for any label with at least `least` rows."""
    often = frequencies(df, labels).filter(F.col("n") >= least).select("label")
    pairs = df.select(key, value, F.explode(labels).alias("label")).join(often, "label", "left_semi")
    picked = median_centred(pairs, n, ("label",), value, key).select(F.col(key).alias("__picked")).distinct()
    return df.join(picked, F.col(key) == F.col("__picked"), "left_semi")


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row: the distinct edges of bins quantile bins."""
    return df.agg(F.array_distinct(F.percentile(value, [i / bins for i in range(bins + 1)])).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Right-closed bin number, the first bin closed on both sides; null outside the edges."""
    below = F.size(F.filter(edges, lambda e: e < value))
    inside = (value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1))
    return F.when(inside, F.greatest(below - 1, F.lit(0)))


def with_bins(df: DataFrame, base: DataFrame, columns: Sequence[str], bins: int = 90) -> DataFrame:
    """Adds <column>_bin, with edges taken from base; rows outside the edges go."""
    for c in columns:
        edges = quantile_edges(base, c, bins).withColumnRenamed("edges", f"__{c}")
        df = df.crossJoin(F.broadcast(edges)).withColumn(f"{c}_bin", bin_of(F.col(c).cast("double"), F.col(f"__{c}"))).drop(f"__{c}").filter(F.col(f"{c}_bin").isNotNull())
    return df


def stratified(vulnerable: DataFrame, safe: DataFrame, columns: Sequence[str] = ("complexity", "token_count"), bins: int = 90, seed: int = 42, key: str = "id", base: DataFrame | None = None) -> DataFrame:
    """Safe rows, in each bin as many as vulnerable ones or all there are, in hashed order."""
    base = vulnerable if base is None else base
    names = [f"{c}_bin" for c in columns]
    wanted = with_bins(vulnerable, base, columns, bins).groupBy(*names).agg(F.count("*").alias("__want"))
    found = with_bins(safe, base, columns, bins).withColumn("__i", F.row_number().over(Window.partitionBy(*names).orderBy(hashed(key, seed), key)))
    return found.join(wanted, names).filter("__i <= __want").drop("__i", "__want", *names)


def fallback(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """n rows in hashed order, without replacement."""
    return df.orderBy(hashed(key, seed), key).limit(n)


def stratified_or_fallback(vulnerable: DataFrame, safe: DataFrame, least: float = 0.95, bins: int = 20, seed: int = 42, key: str = "id") -> DataFrame:
    """stratified with bins of all rows; if that gives less than least of the vulnerable count, fallback instead."""
    n = vulnerable.count()
    got = stratified(vulnerable, safe, bins=bins, seed=seed, key=key, base=vulnerable.unionByName(safe))
    return got if got.count() >= least * n else fallback(safe, n, seed, key)


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in random order; only for writing, since a table has no order."""
    return df.orderBy(F.rand(seed))


def balance(df: DataFrame, per_label: int, least: int, bins: int = 90, target: str = "target", labels: str = "cwe") -> DataFrame:
    """Quantile filter, per-label selection of vulnerable rows, matching safe rows, and their union."""
    ranged = quantile_range(df)
    vulnerable = per_label_selection(ranged.filter((F.col(target) == 1) & (F.size(labels) > 0)), per_label, least, labels)
    return vulnerable.unionByName(stratified(vulnerable, ranged.filter(F.col(target) == 0), bins=bins))


def oversampling_plan(df: DataFrame, ratio: float = 0.5, labels: str = "cwe", target: str = "target", key: str = "id") -> DataFrame:
    """One row: safe rows, vulnerable rows with labels, the vulnerable target and the number of draws."""
    safe, labelled = F.count_if(F.col(target) != 1), F.count_if((F.col(target) == 1) & (F.size(labels) > 0))
    want = F.floor(safe * ratio / (1 - ratio))
    return df.agg(safe.alias("safe"), labelled.alias("vulnerable"), want.cast("long").alias("wanted"), F.greatest(F.lit(0), want - labelled).cast("long").alias("draws"))


def oversampling_weights(df: DataFrame, labels: str = "cwe", target: str = "target") -> DataFrame:
    """(label, n, probability): drawing probability in inverse proportion to frequency."""
    counts = frequencies(df.filter(F.col(target) == 1), labels)
    return counts.withColumn("probability", F.round((1 / F.col("n")) / F.sum(1 / F.col("n")).over(Window.partitionBy()), 6))


def oversample(df: DataFrame, ratio: float = 0.5, seed: int = 42, labels: str = "cwe", target: str = "target", key: str = "id") -> DataFrame:
    """df with vulnerable rows drawn again until they are ratio of the whole: a label by inverse frequency, then a row of it.

    Draws are numbered and hashed, so a retry draws the same. A row drawn twice is there twice more.
    """
    draws = oversampling_plan(df, ratio, labels, target, key).first().draws
    if not draws:
        return df
    run = Window.orderBy("label")
    weights = frequencies(df.filter(F.col(target) == 1), labels).withColumn("w", 1 / F.col("n"))
    ends = weights.withColumn("__hi", F.sum("w").over(run) / F.sum("w").over(Window.partitionBy())).withColumn("__lo", F.lag("__hi", 1, 0.0).over(run))
    # draws find their label by an equal cell of the unit interval, and within it by its ends
    ends = ends.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__lo") * DRAW_CELLS), F.least(F.floor(F.col("__hi") * DRAW_CELLS), F.lit(DRAW_CELLS - 1)))))
    uniform = lambda salt: F.pmod(F.xxhash64(F.col("draw"), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)
    drawn = df.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("u", uniform(1)).withColumn("__cell", F.floor(F.col("u") * DRAW_CELLS))
    drawn = drawn.join(ends, "__cell").filter((F.col("u") >= F.col("__lo")) & (F.col("u") < F.col("__hi")))
    drawn = drawn.select("label", (F.floor(uniform(2) * F.col("n")) + 1).alias("__i"))
    rows = df.filter(F.col(target) == 1).select(F.col(key).alias("__id"), F.explode(labels).alias("label"))
    rows = rows.withColumn("__i", F.row_number().over(Window.partitionBy("label").orderBy("__id")))
    again = drawn.join(rows, ["label", "__i"]).select("__id")
    return df.unionByName(again.join(df, F.col("__id") == F.col(key)).drop("__id"))


def stratified_split(df: DataFrame, by: str, test: float = 0.2, seed: int = 42, key: str = "id") -> DataFrame:
    """Adds split: of each class the first test share of rows in hashed order is test, the rest train.

    Counts by class and beginning of the hash tell in which of 65,536 cells the cut falls; only the rows of that cell
    are ranked, so that no task sorts a class. Rows meet their counts by class and cell, so that no task gets a class.
    """
    cell = F.conv(F.substring(hashed(key, seed), 1, 4), 16, 10).cast("int")
    w = Window.partitionBy("__g")
    counts = df.groupBy(F.col(by).alias("__g"), cell.alias("__cell")).agg(F.count("*").alias("__c"))
    counts = counts.withColumn("__want", F.floor(F.sum("__c").over(w) * test + 0.5)).withColumn("__upto", F.sum("__c").over(w.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)))
    # how many of the cell's rows are test: all, none, or of one cell of a class some
    counts = counts.select("__g", "__cell", "__c", F.least(F.col("__c"), F.greatest(F.lit(0), F.col("__want") - F.col("__upto") + F.col("__c"))).alias("__test"))
    rows = df.withColumn("__h", cell).join(counts, F.col(by).eqNullSafe(F.col("__g")) & (F.col("__h") == F.col("__cell")))
    cut = (F.col("__test") > 0) & (F.col("__test") < F.col("__c"))
    near = rows.filter(cut).withColumn("__i", F.row_number().over(Window.partitionBy(by).orderBy(hashed(key, seed), key)))
    near = near.withColumn("split", F.when(F.col("__i") <= F.col("__test"), "test").otherwise("train"))
    far = rows.filter(~cut).withColumn("split", F.when(F.col("__test") > 0, "test").otherwise("train"))
    return far.select(*df.columns, "split").unionByName(near.select(*df.columns, "split"))
