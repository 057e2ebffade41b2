"""Labelled samples, judgements, texts and predictions derived from the star-schema tables, in Spark and as SQL.

Operators take column names; these views give them columns of the kinds they work on.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.session import table

#: Judges' criteria and the weights of the two score definitions.
CRITERIA = tuple("correctness completeness clarity technical_accuracy logical_flow".split())
#: Lines that one task of judgements() groups, on average.
TASK_LINES = 250_000


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, description, status) of labels; ids that are multiples of 7 are missing."""
    part = table(spark, sf_dir, "part").filter("p_partkey <= 60 AND p_partkey % 7 <> 0")
    status = F.element_at(F.array(*map(F.lit, ("Stable", "Draft", "Incomplete", "Deprecated"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), status.alias("status"))


DICTIONARY = """dictionary AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS description,
    ['Stable', 'Draft', 'Incomplete', 'Deprecated'][p_partkey % 4 + 1] AS status FROM part WHERE p_partkey <= 60 AND p_partkey % 7 <> 0)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, project, target, cwe, token_count, complexity): orders with the labels of their lines; an order without lines has no label."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor(F.col("l_quantity") * F.col("l_discount") * 10).cast("int").alias("label"))
    labels = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.count("*").alias("lines"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    joined = order.join(labels, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(
        F.col("o_orderkey").alias("id"), F.coalesce("n_name", F.lit("unknown")).alias("project"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("target"),
        F.transform(F.coalesce("labels", F.array().cast("array<int>")), lambda x: F.concat(F.lit("CWE-"), x.cast("string"))).alias("cwe"),
        F.floor("o_totalprice").cast("int").alias("token_count"), F.coalesce("lines", F.lit(0)).cast("int").alias("complexity"),
    )


SAMPLES = """line_labels AS (SELECT l_orderkey, list_sort(list(DISTINCT CAST(floor(l_quantity * l_discount * 10) AS INTEGER))) AS labels, count(*) AS n FROM lineitem GROUP BY l_orderkey),
samples AS (SELECT o_orderkey AS id, coalesce(n_name, 'unknown') AS project, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
    list_transform(coalesce(labels, []), lambda x: 'CWE-' || x) AS cwe, CAST(floor(o_totalprice) AS INTEGER) AS token_count, CAST(coalesce(n, 0) AS INTEGER) AS complexity
    FROM orders LEFT JOIN line_labels ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples with cwe_desc, looked up in dictionary."""
    from quernstone.operators.labels import enrich

    return enrich(samples(spark, sf_dir), dictionary(spark, sf_dir))


DESCRIBED = (
    SAMPLES
    + ",\n"
    + DICTIONARY
    + """,
described AS (SELECT s.*, coalesce(e.d, []) AS cwe_desc FROM samples s LEFT JOIN (
    SELECT x.id, list(coalesce(description, 'Description not found.') ORDER BY i) AS d
    FROM (SELECT id, unnest(cwe) AS c, generate_subscripts(cwe, 1) AS i FROM samples) x LEFT JOIN dictionary d ON replace(x.c, 'CWE-', '') = d.id GROUP BY x.id) e USING (id))"""
)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, project, target, reasoning): documents with their toxic label as target (0 where unlabelled)."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("__id"), "toxic")
    return table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("__id"), "left").select(F.col("doc_id").alias("id"), F.col("source").alias("project"), F.coalesce("toxic", F.lit(0)).cast("int").alias("target"), F.col("text").alias("reasoning"))


TEXTS = """texts AS (SELECT d.doc_id AS id, d.source AS project, CAST(coalesce(l.toxic, 0) AS INTEGER) AS target, d.text AS reasoning FROM documents d LEFT JOIN labels l USING (doc_id))"""


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, judge_name, five criteria, quality_score, confidence): one row for each line number of an order.

    The lines are shuffled once, by order, to tasks whose number follows theirs: grouping by judge and then by sample needs
    no other shuffle, and the groups that a task holds do not grow with the table.
    """
    line = table(spark, sf_dir, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(line.count() / TASK_LINES))
    line = line.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").repartition(tasks, "l_orderkey")
    q, d, t = F.avg("l_quantity"), F.avg(F.col("l_discount") + 0.0), F.avg(F.col("l_tax") + 0.0)
    means = line.groupBy(F.col("l_orderkey").alias("sample_id"), F.concat(F.lit("judge_"), F.col("l_linenumber").cast("string")).alias("judge_name")).agg(q.alias("q"), d.alias("d"), t.alias("t"))
    rounded = means.select("sample_id", "judge_name", F.round("q", 4).alias("q"), F.round("d", 4).alias("d"), F.round("t", 4).alias("t"))
    cell = {"correctness": F.col("d") * 10, "completeness": F.col("t") * 12, "clarity": F.col("q") / 50, "technical_accuracy": (F.col("d") + F.col("t")) * 5, "logical_flow": 1 - F.col("q") / 50, "quality_score": F.col("d") * 5 + F.col("q") / 100, "confidence": (F.col("q") + 1) / 51}
    return rounded.select("sample_id", "judge_name", *(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 6).alias(k) for k, x in cell.items()))


_CELLS = {"correctness": "d * 10", "completeness": "t * 12", "clarity": "q / 50", "technical_accuracy": "(d + t) * 5", "logical_flow": "1 - q / 50", "quality_score": "d * 5 + q / 100", "confidence": "(q + 1) / 51"}
JUDGEMENTS = f"""judge_means AS (SELECT l_orderkey AS sample_id, 'judge_' || l_linenumber AS judge_name, round(avg(l_quantity), 4) AS q, round(avg(l_discount + 0.0), 4) AS d, round(avg(l_tax + 0.0), 4) AS t
    FROM lineitem GROUP BY ALL),
judgements AS (SELECT sample_id, judge_name, {', '.join(f'round(least(1.0, greatest(0.0, {x})), 6) AS {k}' for k, x in _CELLS.items())} FROM judge_means)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, gt, pred, gt_cwes, pred_cwes): the truth of a sample and a prediction that drops its first label, adds its line count and is off for every fifth id."""
    s = samples(spark, sf_dir)
    number = F.transform("cwe", lambda x: F.substring(x, 5, 10).cast("int"))
    truth = F.when(F.col("target") == 1, number).otherwise(F.array().cast("array<int>"))
    guess = F.when((F.col("target") == 1) == (F.col("id") % 5 != 0), F.array_distinct(F.concat(F.slice(number, 2, 40), F.array("complexity")))).otherwise(F.array().cast("array<int>"))
    return s.select("id", truth.alias("gt_cwes"), guess.alias("pred_cwes")).select("id", (F.size("gt_cwes") > 0).cast("int").alias("gt"), (F.size("pred_cwes") > 0).cast("int").alias("pred"), "gt_cwes", "pred_cwes")


PREDICTIONS = (
    SAMPLES
    + """,
numbered AS (SELECT *, list_transform(cwe, lambda x: CAST(substring(x, 5, 10) AS INTEGER)) AS nr FROM samples),
guessed AS (SELECT id, CASE WHEN target = 1 THEN nr ELSE [] END AS gt_cwes,
    CASE WHEN (target = 1) = (id % 5 <> 0) THEN list_distinct(list_concat(nr[2:41], [complexity])) ELSE [] END AS pred_cwes FROM numbered),
predictions AS (SELECT id, CAST(len(gt_cwes) > 0 AS INTEGER) AS gt, CAST(len(pred_cwes) > 0 AS INTEGER) AS pred, gt_cwes, pred_cwes FROM guessed)"""
)

#: parent -> children of the label hierarchy that hierarchical matching uses on the stand-in labels.
HIERARCHY = {1: (2, 3, 4), 10: (11,), 20: (21, 22)}
EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, {c})" for p, cs in HIERARCHY.items() for c in cs) + ") AS v(parent, child))"
