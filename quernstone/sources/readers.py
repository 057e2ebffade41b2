"""Readers: JSON lines under several policies for malformed lines, dictionaries, judge files, splits, and schema checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

RAW = "func string, target int, cwe array<string>, project string"
SAMPLE = "project string, func string, target long, cwe array<string>, cwe_desc array<string>, reasoning string"
BAD = "_corrupt_record"


def strict(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Rows of a JSON-lines file; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Rows of the lines that can be read; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def with_corrupt(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """All non-blank lines, malformed ones whole in _corrupt_record."""
    return spark.read.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): lines of a file, or of a folder's files in the order of their paths, with their numbers from 0.

    Files are read in blocks, each in order by one task, so a line's number is its place in its block and the sum of the
    blocks before. Should the two readings divide the files differently, the job fails.
    """
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("__id"), F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.col("_metadata.file_block_length").alias("__length"))
    rows = rows.withColumn("__part", F.shiftright("__id", 33))
    block = ["__path", "__start", "__length", "__part"]
    sizes = rows.groupBy(*block).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__path", "__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select(*block, (before - F.col("__first")).alias("__ahead"))
    line = F.col("__id") + F.coalesce("__ahead", F.raise_error(F.lit("the files were divided differently when their lines were counted")).cast("long"))
    return rows.join(F.broadcast(ahead), block, "left").select("value", line.alias("line"))


def samples(spark: SparkSession, path: str, required: Sequence[str] = ("project", "func", "target"), schema: str = SAMPLE) -> DataFrame:
    """Samples with sample_id: lines that cannot be read or lack a required key are skipped; a missing id is sample_<line>."""
    kind = f"{schema}, sample_id string"
    rows = numbered_lines(spark, path).withColumn("s", F.from_json("value", kind + f", {BAD} string", {"columnNameOfCorruptRecord": BAD}))
    good = rows.filter(F.col("s").isNotNull() & F.col(f"s.{BAD}").isNull())
    for c in required:
        good = good.filter(F.col(f"s.{c}").isNotNull())
    names = [c for c in T.StructType.fromDDL(schema).names]
    return good.select(F.coalesce("s.sample_id", F.concat(F.lit("sample_"), F.col("line").cast("string"))).alias("sample_id"), *(F.col(f"s.{c}") for c in names))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def label_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, description, status) of a CSV with a header CWE-ID, Name, Description and perhaps Status; short rows are filled with nulls, of a repeated id the last row stays."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).csv(path)
    status = F.col("Status") if "Status" in rows.columns else F.lit(None).cast("string")
    rows = rows.select(F.trim("CWE-ID").alias("id"), F.col("Name").alias("name"), F.col("Description").alias("description"), status.alias("status"), F.monotonically_increasing_id().alias("__i"))
    w = Window.partitionBy("id").orderBy(F.desc("__i"))
    return rows.filter("id IS NOT NULL").withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__i", "__k")


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, description) of a JSON object of objects by id."""
    got = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string, struct<name: string, description: string>>").alias("m"))
    return got.select(F.explode("m").alias("id", "v")).select("id", "v.name", "v.description")


def split_table(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A table saved by split, or one of its splits (read alone); an unknown split raises KeyError."""
    rows = spark.read.parquet(path)
    if split is None:
        return rows
    if "split" not in rows.columns or rows.select("split").filter(F.col("split") == split).isEmpty():
        raise KeyError(split)
    return rows.filter(F.col("split") == split)


def judge_files(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Evaluations of all files; of one judge's repeated sample the last line stays."""
    rows = spark.read.schema(schema).json(list(paths)).withColumn("__i", F.monotonically_increasing_id())
    w = Window.partitionBy("sample_id", "judge_name").orderBy(F.desc("__i"))
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__i", "__k")


def field_types(lines: DataFrame, value: str = "value") -> DataFrame:
    """(field, types, rows): JSON types seen in each top-level field."""
    m = F.from_json(value, "map<string,string>")
    pairs = lines.select(F.explode(m).alias("field", "text"))
    text = F.col("text")
    kind = F.when(text.isNull(), "null").when(text.startswith("["), "array").when(text.startswith("{"), "object").when(text.isin("true", "false"), "boolean").when(text.rlike(r"^-?\d+$"), "integer").when(text.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), "number").otherwise("string")
    return pairs.groupBy("field").agg(F.array_sort(F.collect_set(kind)).alias("types"), F.count("*").alias("rows"))


def validation_errors(df: DataFrame, names: Sequence[str] = ("func", "project"), target: str = "target") -> DataFrame:
    """Adds errors, the rules that a row breaks: empty text fields, a target that is neither 0 nor 1."""
    rules = [F.when(F.coalesce(F.length(c), F.lit(0)) < 1, F.lit(f"{c}_empty")) for c in names] + [F.when(F.coalesce(~F.col(target).isin(0, 1), F.lit(True)), F.lit(f"{target}_invalid"))]
    return df.withColumn("errors", F.array_compact(F.array(*rules)))


def valid_rows(df: DataFrame, **rules) -> DataFrame:
    return validation_errors(df, **rules).filter(F.size("errors") == 0).drop("errors")
