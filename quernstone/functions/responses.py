"""Model output: JSON extraction, judge scores, response validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.operators.filters import blank

SCORES = tuple("quality_score correctness completeness clarity technical_accuracy logical_flow confidence".split())
#: Fields that models write as text, number or boolean are read as text and then normalised.
RESPONSE = "reasoning string, vulnerabilities array<struct<cwe_id string, description string>>, verdict struct<is_vulnerable string, cwe_list array<string>>"


def clip(column: Column, default: float = 0.5) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(column.try_cast("double"), F.lit(default))))


def json_block(text: Column) -> Column:
    """From the first opening to the last closing brace; empty if there are none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)


def strip_line_comments(text: Column) -> Column:
    """Text without // comments; if it had any, its lines are also trimmed."""
    return F.when(F.contains(text, F.lit("//")), F.regexp_replace(F.regexp_replace(text, r"//[^\n]*", ""), r"(?m)^[ \t]+|[ \t\r]+$", "")).otherwise(text)


def parse_judgement(text: Column) -> Column:
    """Struct of clipped scores, justification and parse_error; a response without readable JSON gets the fallback scores."""
    kinds = ", ".join(f"{c} string" for c in (*SCORES, "justification"))
    parsed = F.from_json(F.nullif(strip_line_comments(json_block(text)), F.lit("")), kinds + ", __bad string", {"columnNameOfCorruptRecord": "__bad"})
    failed = parsed.isNull() | parsed["__bad"].isNotNull()
    score = lambda c: F.when(failed, F.lit(0.3 if c == "confidence" else 0.5)).otherwise(clip(parsed[c]))
    note = F.when(failed, F.lit("Failed to parse response")).otherwise(F.coalesce(parsed["justification"], F.lit("No justification provided")))
    return F.struct(*(score(c).alias(c) for c in SCORES), note.alias("justification"), failed.alias("parse_error"))


def as_int(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def as_bool(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1", "yes", "y", "on", "t"), True).when(low.isin("false", "0", "no", "n", "off", "f"), False)


def once(df: DataFrame, column: Column, out: str) -> DataFrame:
    """Adds column as out, computed once for each row.

    It is given by a generator of one row: a filter on a column of a projection is moved before it, with the column's
    expression in place of each mention, but not before a generator.
    """
    return df.select("*", F.explode(F.array(column)).alias(out))


def with_parsed(df: DataFrame, text: str, out: str = "parsed") -> DataFrame:
    """Adds a struct of reasoning, vulnerabilities(cwe_id, description), is_vulnerable and cwe_list, null where the JSON cannot be read.

    The JSON is read once for each row, and the struct is made once, whatever looks at their fields.
    """
    got = once(df, F.from_json(F.nullif(json_block(F.col(text)), F.lit("")), RESPONSE + ", __bad string", {"columnNameOfCorruptRecord": "__bad"}), "__r")
    r = F.col("__r")
    found = F.transform(r["vulnerabilities"], lambda v: F.struct(as_int(v["cwe_id"]).alias("cwe_id"), v["description"].alias("description")))
    listed = F.transform(r["verdict"]["cwe_list"], as_int)
    whole = F.struct(r["reasoning"].alias("reasoning"), found.alias("vulnerabilities"), as_bool(r["verdict"]["is_vulnerable"]).alias("is_vulnerable"), listed.alias("cwe_list"))
    return once(got.drop(out), F.when(r.isNotNull() & r["__bad"].isNull(), whole), out).drop("__r")


def with_error(df: DataFrame, text: str, least_reasoning: int = 50, least_description: int = 1, out: str = "error", parsed: str = "parsed") -> DataFrame:
    """Adds with_parsed()'s struct and why a response is not valid, or null: empty_response, missing_verdict, invalid_json, validation_error, empty_reasoning or mismatch.

    The training model asks for 50 characters of reasoning, the generation model (0, 10) for longer descriptions.
    """
    df = with_parsed(df, text, parsed)
    p, t = F.col(parsed), F.col(text)
    bad = p["reasoning"].isNull() | p["is_vulnerable"].isNull() | p["cwe_list"].isNull() | p["vulnerabilities"].isNull()
    bad = bad | (F.length(p["reasoning"]) < least_reasoning)
    bad = bad | F.exists(p["vulnerabilities"], lambda v: v["cwe_id"].isNull() | ~v["cwe_id"].between(1, 9999) | v["description"].isNull() | (F.length(v["description"]) < least_description)) | F.exists(p["cwe_list"], lambda x: x.isNull())
    ids = lambda x: F.array_sort(F.array_distinct(x))
    apart = (p["is_vulnerable"] & (F.size(p["vulnerabilities"]) == 0)) | (ids(p["cwe_list"]) != ids(F.transform(p["vulnerabilities"], lambda v: v["cwe_id"])))
    why = (
        F.when(blank(t), "empty_response").when(p.isNull() & (json_block(t) == ""), "missing_verdict").when(p.isNull(), "invalid_json")
        .when(F.coalesce(blank(p["reasoning"]) & (F.length(p["reasoning"]) >= least_reasoning), F.lit(False)), "empty_reasoning")
        .when(F.coalesce(bad, F.lit(True)), "validation_error").when(apart, "mismatch")
    )
    return df.withColumn(out, why)


def parser_stats(df: DataFrame, text: str, **limits) -> DataFrame:
    """(outcome, n): success and each kind of failure."""
    return with_error(df, text, **limits).groupBy(F.coalesce("error", F.lit("success")).alias("outcome")).agg(F.count("*").alias("n"))


def batch_results(lines: DataFrame, value: str = "value", **limits) -> DataFrame:
    """(custom_id, content, error) of batch result lines: transport errors, empty choices and invalid responses are named, else error is null."""
    kind = "custom_id string, error string, response struct<body struct<choices array<struct<message struct<content string>>>>>"
    got = lines.select(F.from_json(value, kind).alias("r"))
    got = got.select("r.custom_id", F.col("r.error").alias("__e"), F.try_element_at("r.response.body.choices", F.lit(1))["message"]["content"].alias("content"))
    why = F.when(F.col("custom_id").isNull(), "bad_line").when(F.col("__e").isNotNull(), "request_error").when(F.col("content").isNull(), "no_content").otherwise(F.col("__why"))
    return with_error(got, "content", out="__why", **limits).select("custom_id", "content", why.alias("error"))
