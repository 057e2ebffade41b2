"""Queries that go through files: readers, writers, schema checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quernstone.functions import prompts
from quernstone.operators import labels
from quernstone.plans.registry import query
from quernstone.plans.standins import DESCRIBED, DICTIONARY, JUDGEMENTS, SAMPLES, TEXTS, described, dictionary, judgements, samples, texts
from quernstone.session import shared_folder, table
from quernstone.sources import readers, writers

S = "WITH " + SAMPLES
T = "WITH " + TEXTS
D = "WITH " + DESCRIBED
RAW = "id long, project string, target int, cwe array<string>, token_count int, complexity int"


def scratch(spark, name: str) -> str:
    """A new folder for a query's files, below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark, sf_dir, bad: bool = False) -> str:
    """Samples as a file of JSON lines, with a blank and two malformed lines if bad."""
    path = scratch(spark, "samples")
    lines = samples(spark, sf_dir).select(F.to_json(F.struct("id", "project", "target", "cwe", "token_count", "complexity")).alias("value"))
    if bad:
        lines = lines.union(spark.createDataFrame([("",), ("{not json",), ('{"id": 5, "cwe": ',)], "value string"))
    lines.write.text(path)
    return path


ROWS = " SELECT id, project, target, array_to_string(cwe, ',') AS labels FROM samples"


def rows(df):
    return df.select("id", "project", "target", F.array_join("cwe", ",").alias("labels"))


@query("s01_read_strict", S + ROWS)
def s01(spark, sf_dir):
    return rows(readers.strict(spark, written(spark, sf_dir), RAW))


@query("s04_read_jsonl", S + " SELECT target, count(*) AS n FROM samples GROUP BY target")
def s04(spark, sf_dir):
    return readers.lenient(spark, written(spark, sf_dir), RAW).groupBy("target").agg(F.count("*").alias("n"))


@query("s05_read_lenient", S + ROWS)
def s05(spark, sf_dir):
    return rows(readers.lenient(spark, written(spark, sf_dir, True), RAW).filter("id IS NOT NULL AND project IS NOT NULL"))


@query("s07_read_with_corrupt", S + " SELECT count(*) AS good, CAST(2 AS BIGINT) AS bad FROM samples")
def s07(spark, sf_dir):
    got = readers.with_corrupt(spark, written(spark, sf_dir, True), RAW)
    return got.agg(F.count_if(F.col(readers.BAD).isNull() & F.col("project").isNotNull()).alias("good"), F.count_if(F.col(readers.BAD).isNotNull()).alias("bad"))


@query("s06_read_samples", T + ", n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS line FROM texts) SELECT CASE WHEN id % 3 = 0 THEN 's' || id ELSE 'sample_' || line END AS sample_id, project, reasoning FROM n WHERE id % 5 <> 0")
def s06(spark, sf_dir):
    path = scratch(spark, "reasoning")
    t = texts(spark, sf_dir).withColumn("sample_id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), F.col("id").cast("string")))).withColumn("func", F.when(F.col("id") % 5 != 0, F.lit("f")))
    t.orderBy("id").select(F.to_json(F.struct("sample_id", "project", "func", F.col("target").cast("long").alias("target"), "reasoning")).alias("value")).write.text(path)
    return readers.samples(spark, path).select("sample_id", "project", "reasoning")


@query("s08_count_lines", S + " SELECT count(*) AS lines FROM samples")
def s08(spark, sf_dir):
    return spark.createDataFrame([(readers.count_lines(spark, written(spark, sf_dir)),)], "lines long")


@query("s02_s11_dictionary_csv", "WITH " + DICTIONARY + " SELECT id, CASE WHEN CAST(id AS INTEGER) % 2 = 0 THEN 'later' ELSE name END AS name, description FROM dictionary")
def s02(spark, sf_dir):
    path = scratch(spark, "dictionary")
    d = dictionary(spark, sf_dir)
    again = d.filter("cast(id AS int) % 2 = 0").withColumn("name", F.lit("later"))
    d.union(again).select(F.col("id").alias("CWE-ID"), F.col("name").alias("Name"), F.col("description").alias("Description"), F.col("status").alias("Status")).coalesce(1).write.option("header", True).csv(path)
    return readers.label_dictionary(spark, path).select("id", "name", "description")


@query("s03_k02_dictionary_json", "WITH " + DICTIONARY + " SELECT id, name, description FROM dictionary")
def s03(spark, sf_dir):
    path = scratch(spark, "map")
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", F.struct("name", "description").alias("v")))))
    dictionary(spark, sf_dir).agg(F.to_json(pairs).alias("value")).write.text(path)
    return readers.label_map(spark, path)


@query("s10_k07_split_tables", S + " SELECT id, project FROM samples WHERE id % 10 = 9")
def s10(spark, sf_dir):
    path = scratch(spark, "splits")
    s = samples(spark, sf_dir).withColumn("split", F.when(F.col("id") % 10 == 9, "test").otherwise("train"))
    writers.by_split(s, path)
    return readers.split_table(spark, path, "test").select("id", "project")


@query("s12_judge_files_last_wins", "WITH " + JUDGEMENTS + " SELECT sample_id, judge_name, CASE WHEN sample_id % 2 = 0 THEN 0.25 ELSE confidence END AS confidence FROM judgements WHERE sample_id < 4000")
def s12(spark, sf_dir):
    first, second = scratch(spark, "judges"), scratch(spark, "judges")
    j = judgements(spark, sf_dir).filter("sample_id < 4000").select("sample_id", "judge_name", "confidence")
    j.union(j.filter("sample_id % 2 = 0").withColumn("confidence", F.lit(0.25))).filter("judge_name < 'judge_4'").coalesce(1).write.json(first)
    j.union(j.filter("sample_id % 2 = 0").withColumn("confidence", F.lit(0.25))).filter("judge_name >= 'judge_4'").coalesce(1).write.json(second)
    return readers.judge_files(spark, [first, second], "sample_id long, judge_name string, confidence double")


@query("s14_field_types", S + """ SELECT 'id' AS field, 'integer' AS types, count(*) AS rows FROM samples UNION ALL SELECT 'project', 'string', count(*) FROM samples UNION ALL SELECT 'target', 'integer', count(*) FROM samples
    UNION ALL SELECT 'cwe', 'array', count(*) FROM samples UNION ALL SELECT 'token_count', 'integer', count(*) FROM samples UNION ALL SELECT 'complexity', 'integer', count(*) FROM samples""")
def s14(spark, sf_dir):
    return readers.field_types(spark.read.text(written(spark, sf_dir))).select("field", F.array_join("types", ",").alias("types"), "rows")


@query("s15_validation_errors", T + ", m AS (SELECT id, CASE WHEN id % 11 = 0 THEN '' ELSE project END AS project, CASE WHEN id % 13 = 0 THEN 7 ELSE target END AS target FROM texts) SELECT id, concat_ws(',', CASE WHEN project = '' THEN 'project_empty' END, CASE WHEN target NOT IN (0, 1) THEN 'target_invalid' END) AS errors FROM m")
def s15(spark, sf_dir):
    t = texts(spark, sf_dir).withColumn("project", F.when(F.col("id") % 11 == 0, "").otherwise(F.col("project"))).withColumn("target", F.when(F.col("id") % 13 == 0, 7).otherwise(F.col("target")))
    return readers.validation_errors(t, ("project",)).select("id", F.array_join("errors", ",").alias("errors"))


@query("s15_valid_rows", T + " SELECT id FROM texts WHERE id % 13 <> 0")
def s15_valid(spark, sf_dir):
    t = texts(spark, sf_dir).withColumn("target", F.when(F.col("id") % 13 == 0, F.lit(None).cast("int")).otherwise(F.col("target")))
    return readers.valid_rows(t, names=("project",)).select("id")


@query("k01_write_jsonl", S + ROWS)
def k01(spark, sf_dir):
    path = scratch(spark, "out")
    writers.jsonl(samples(spark, sf_dir), path, refuse_empty=True)
    return rows(readers.strict(spark, path, RAW))


@query("k03_k13_write_errors", T + " SELECT id, left(reasoning, 100) AS head FROM texts WHERE id % 17 = 0")
def k03(spark, sf_dir):
    path = scratch(spark, "errors")
    writers.jsonl(texts(spark, sf_dir).filter("id % 17 = 0").select("id", F.substring("reasoning", 1, 100).alias("head")), path, single=True)
    return spark.read.schema("id long, head string").json(path)


@query("k05_label_counts_csv", D + ", e AS (SELECT unnest(cwe) AS l, unnest(cwe_desc) AS d FROM described) SELECT l AS CWE_ID, count(*) AS \"Count\", max(d) AS Description FROM e GROUP BY l")
def k05(spark, sf_dir):
    path = scratch(spark, "counts")
    writers.label_counts_csv(labels.first_descriptions(described(spark, sf_dir)), path)
    return spark.read.schema("CWE_ID string, Count long, Description string").option("header", True).csv(path)


@query("k08_comparison_csv", S + ", a AS (SELECT label, count(*) AS n FROM (SELECT unnest(cwe) AS label FROM samples) GROUP BY label), b AS (SELECT label, count(*) AS n FROM (SELECT unnest(cwe) AS label FROM samples WHERE target = 1) GROUP BY label) SELECT label, a.n AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - a.n AS change FROM a LEFT JOIN b USING (label)")
def k08(spark, sf_dir):
    path = scratch(spark, "compared")
    s = samples(spark, sf_dir)
    writers.csv(writers.compared(labels.frequencies(s), labels.frequencies(s.filter("target = 1"))), path)
    return spark.read.schema("label string, before long, after long, change long").option("header", True).csv(path)


@query("k12_batch_requests", T + " SELECT CAST(id AS VARCHAR) AS custom_id, 'POST' AS method, 'm' AS model, CAST(2 AS BIGINT) AS messages, substr('Review this function:' || chr(10) || reasoning, 1, 200) AS content FROM texts")
def k12(spark, sf_dir):
    path = scratch(spark, "requests")
    t = texts(spark, sf_dir)
    writers.request_lines(t, prompts.batch_request(F.col("id"), prompts.as_messages(F.col("reasoning")), "m")).write.text(path)
    kind = "custom_id string, method string, body struct<model string, messages array<struct<role string, content string>>>"
    r = spark.read.text(path).select(F.from_json("value", kind).alias("r"))
    return r.select("r.custom_id", "r.method", "r.body.model", F.size("r.body.messages").cast("long").alias("messages"), F.substring(F.element_at("r.body.messages", 2)["content"], 1, 200).alias("content"))


AUDIT = S + ", " + DICTIONARY + """, a AS (SELECT s.id, label, lower(coalesce(status, 'unknown')) AS low FROM (SELECT id, unnest(cwe) AS label FROM samples) s LEFT JOIN (SELECT id AS k, status FROM dictionary) d ON replace(label, 'CWE-', '') = k),
    b AS (SELECT CASE WHEN low IN ('deprecated', 'draft', 'unknown') THEN low WHEN low IN ('stable', 'incomplete') THEN 'stable' ELSE 'other' END AS bucket, count(DISTINCT label) AS labels, count(*) AS occurrences, count(DISTINCT id) AS rows_affected FROM a GROUP BY 1)"""
NL = " || chr(10) || "


@query("k10_markdown_report", AUDIT + f""" SELECT 'markdown' AS kind, '## Status'{NL}chr(10) || '| bucket | labels | occurrences | rows_affected |'{NL}'| --- | --- | --- | --- |'{NL}
    string_agg('| ' || bucket || ' | ' || labels || ' | ' || occurrences || ' | ' || rows_affected || ' |', chr(10) ORDER BY bucket) AS text FROM b
    UNION ALL SELECT 'latex', '\\begin{{table}}'{NL}'\\begin{{tabular}}{{llll}}'{NL}'bucket & labels & occurrences & rows\\_affected \\\\'{NL}'\\hline'{NL}
    string_agg(bucket || ' & ' || labels || ' & ' || occurrences || ' & ' || rows_affected || ' \\\\', chr(10) ORDER BY bucket){NL}'\\end{{tabular}}'{NL}'\\caption{{Status}}'{NL}'\\end{{table}}' FROM b""")
def k10(spark, sf_dir):
    counts = labels.status_audit(samples(spark, sf_dir), dictionary(spark, sf_dir)).orderBy("bucket")
    return spark.createDataFrame([("markdown", writers.markdown(counts, "Status")), ("latex", writers.latex(counts, "Status"))], "kind string, text string")


@query("k11_yaml_report", f"SELECT '---'{NL}'rows: ' || count(*){NL}'note: |-'{NL}'  two'{NL}'  lines'{NL}'---'{NL}'rows: 0' || chr(10) AS text FROM labels")
def k11(spark, sf_dir):
    n = table(spark, sf_dir, "labels").count()
    return spark.createDataFrame([(writers.yaml_documents([{"rows": n, "note": "two\nlines"}, {"rows": 0}]),)], "text string")
