"""Multi-label arrays: normalisation, dictionary lookups, frequencies, status audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MISSING = "Description not found."


def sanitize(column: Column) -> Column:
    """Array of strings without null and empty elements; a null array is empty."""
    return F.filter(F.coalesce(column.cast("array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def from_scalar(column: Column) -> Column:
    """Labels held in one string: a JSON list becomes an array, other text a single label, blank text none."""
    listed = F.from_json(column, "array<string>")
    one = F.when(column.isNull() | (F.trim(column) == ""), F.array().cast("array<string>")).otherwise(F.array(column))
    return sanitize(F.when(column.startswith("["), listed).otherwise(one))


def strip_prefix(label: Column) -> Column:
    """Label id without blanks around it and without its leading CWE-."""
    return F.regexp_replace(F.regexp_replace(label, r"^\s+|\s+$", ""), "^CWE-", "")


def number(label: Column) -> Column:
    """Numeric label id, null where it cannot be read; CWE- is removed wherever it stands."""
    return F.trim(F.replace(label, F.lit("CWE-"), F.lit(""))).try_cast("int")


def clean(label: Column) -> Column:
    """Label without blanks and list brackets or quotes around it."""
    return F.regexp_replace(F.regexp_replace(label, r"\s+", ""), r"^[\['\"]+|[\]'\"]+$", "")


#: Dictionaries of up to this many rows travel as one map with every row; larger ones are joined label by label.
MAP_ROWS = 2_000


def enrich(df: DataFrame, lookup: DataFrame, labels: str = "cwe", out: str = "cwe_desc", key: str = "id", text: str = "description", missing: str = MISSING, map_rows: int = MAP_ROWS) -> DataFrame:
    """Adds, position by position, the description of each label; missing where the dictionary has none.

    The dictionary's last row of a key wins. A small dictionary (counted) is broadcast as a map, without a shuffle of
    df; with a larger one each distinct list of labels is looked up once, positions travelling with its labels, and
    rows are joined to their list. Rows need no id: both ways give a row the same, whatever its other columns hold.
    """
    placed = lookup.select(F.col(key).alias("__key"), F.col(text).alias("__t"), F.monotonically_increasing_id().alias("__i"))
    one = placed.filter("__key IS NOT NULL").groupBy("__key").agg(F.max_by("__t", "__i").alias("__text"))
    if one.limit(map_rows + 1).count() <= map_rows:
        table = one.agg(F.map_from_entries(F.collect_list(F.struct("__key", "__text"))).alias("__map"))
        joined = df.crossJoin(F.broadcast(table))
        return joined.withColumn(out, F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.coalesce(F.try_element_at("__map", strip_prefix(x)), F.lit(missing)))).drop("__map")
    lists = df.select(F.col(labels).alias("__labels")).filter("__labels IS NOT NULL").distinct()
    pairs = lists.select("__labels", F.posexplode("__labels").alias("__pos", "__label")).withColumn("__key", strip_prefix(F.col("__label")))
    found = pairs.join(one, "__key", "left").groupBy("__labels").agg(F.sort_array(F.collect_list(F.struct("__pos", F.coalesce("__text", F.lit(missing)).alias("t")))).alias("__got"))
    return df.join(found, F.col(labels) == F.col("__labels"), "left").withColumn(out, F.coalesce(F.transform("__got", lambda x: x["t"]), F.array().cast("array<string>"))).drop("__labels", "__got")


def enrich_by_map(df: DataFrame, lookup: dict[str, str], labels: str = "cwe", out: str = "cwe_desc", missing: str = MISSING) -> DataFrame:
    """As enrich, for a dictionary small enough to be a literal: no shuffle."""
    table = F.create_map(*(F.lit(x) for pair in lookup.items() for x in pair)) if lookup else F.lit(None).cast("map<string,string>")
    return df.withColumn(out, F.transform(labels, lambda x: F.coalesce(F.try_element_at(table, strip_prefix(x)), F.lit(missing))))


def frequencies(df: DataFrame, labels: str = "cwe") -> DataFrame:
    """(label, n) over all rows; a label that a row repeats counts each time."""
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def numeric_frequencies(df: DataFrame, labels: str = "cwe") -> DataFrame:
    """(label, n) over numeric ids. The first id of a row that cannot be read ends that row."""
    ids = F.transform(labels, number)
    upto = F.array_position(F.transform(ids, lambda x: x.isNull().cast("int")), 1)
    return df.select(F.explode(F.when(upto > 0, F.slice(ids, 1, F.greatest(upto.cast("int") - 1, F.lit(0)))).otherwise(ids)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def unreadable_rows(df: DataFrame, labels: str = "cwe") -> DataFrame:
    """Number of rows that hold an id that cannot be read."""
    return df.agg(F.count_if(F.exists(labels, lambda x: number(x).isNull())).alias("errors"))


def frequent(counts: DataFrame, least: int) -> DataFrame:
    """Labels with at least `least` occurrences."""
    return counts.filter(F.col("n") >= least).select("label")


def first_descriptions(df: DataFrame, labels: str = "cwe", texts: str = "cwe_desc", order: str = "id") -> DataFrame:
    """(label, n, description): count and the first non-empty description in order."""
    rows = df.select(F.col(order).alias("__order"), F.posexplode(F.arrays_zip(F.col(labels).alias("l"), F.col(texts).alias("t"))).alias("__pos", "__z"))
    own = F.when(F.col("__z.t").isNotNull() & (F.col("__z.t") != ""), F.col("__z.t"))
    return rows.groupBy(F.col("__z.l").alias("label")).agg(F.count("*").alias("n"), F.min_by(own, F.when(own.isNotNull(), F.struct("__order", "__pos"))).alias("description"))


def label_order(label: Column) -> list[Column]:
    """Sort keys: numeric id, then the text."""
    return [F.regexp_extract(label, r"(\d+)", 1).try_cast("int").asc_nulls_last(), label.asc()]


def with_status(df: DataFrame, lookup: DataFrame, labels: str = "cwe", row: str = "id", key: str = "id") -> DataFrame:
    """(row, label, status) of every label; unknown where the dictionary has no status."""
    side = lookup.select(F.col(key).alias("__key"), F.col("status").alias("__status"))
    pairs = df.select(F.col(row).alias("row"), F.explode(labels).alias("label"))
    return pairs.join(side, strip_prefix(F.col("label")) == F.col("__key"), "left").select("row", "label", F.coalesce("__status", F.lit("unknown")).alias("status"))


def status_audit(df: DataFrame, lookup: DataFrame, labels: str = "cwe", row: str = "id") -> DataFrame:
    """By bucket of status (deprecated, draft, stable with incomplete, unknown, other): labels, occurrences, rows affected."""
    low = F.lower("status")
    bucket = F.when(low == "deprecated", "deprecated").when(low == "draft", "draft").when(low.isin("stable", "incomplete"), "stable").when(low == "unknown", "unknown").otherwise("other")
    return with_status(df, lookup, labels, row).groupBy(bucket.alias("bucket")).agg(F.countDistinct("label").alias("labels"), F.count("*").alias("occurrences"), F.countDistinct("row").alias("rows_affected"))
