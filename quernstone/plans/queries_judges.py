"""Queries over judgements and predictions: jury aggregation and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import diagnostics, evaluate, jury, stats
from quernstone.plans.registry import query
from quernstone.plans.standins import EDGES, HIERARCHY, JUDGEMENTS, PREDICTIONS, SAMPLES, judgements, predictions, samples
from quernstone.session import table

J = "WITH " + JUDGEMENTS
P = "WITH " + PREDICTIONS
C = jury.CRITERIA
EW, AW = jury.ENSEMBLE_WEIGHTS, jury.ANALYSIS_WEIGHTS
JUDGES = ("judge_2", "judge_1", "judge_3")
SCORE = "round(" + " + ".join(f"{w} * coalesce(sum(confidence * {c}) / nullif(sum(confidence), 0), avg({c}))" for c, w in EW.items()) + ", 9)"


def agreement_sql(weights: dict[str, float] | None) -> str:
    w = {c: (weights or {}).get(c, 1.0) if weights else 1.0 for c in C}
    top = sum(x * x for x in w.values()) ** 0.5
    apart = "sqrt(" + " + ".join(f"pow((a.{c} - b.{c}) * {x}, 2)" for c, x in w.items()) + ")"
    return f"""g AS (SELECT a.sample_id, 1 - avg({apart}) / {top!r} AS v FROM judgements a JOIN judgements b ON a.sample_id = b.sample_id AND a.judge_name < b.judge_name GROUP BY a.sample_id),
    agreed AS (SELECT DISTINCT j.sample_id, round(CASE WHEN v IS NULL THEN 1.0 ELSE least(1.0, greatest(0.0, v)) END, 9) AS agreement FROM judgements j LEFT JOIN g USING (sample_id))"""


@query("s12_judge_rows", J + " SELECT * FROM judgements")
def s12(spark, sf_dir):
    return judgements(spark, sf_dir)


@query("s09_exploded_evaluations", "WITH " + SAMPLES + ", " + JUDGEMENTS + " SELECT sample_id, judge_name, confidence FROM judgements WHERE judge_name IN ('judge_1', 'judge_2', 'judge_3') AND sample_id IN (SELECT sample_id FROM judgements WHERE judge_name IN ('judge_1', 'judge_2', 'judge_3') GROUP BY sample_id HAVING count(*) = 3)")
def s09(spark, sf_dir):
    rows = jury.complete(samples(spark, sf_dir).select("id"), judgements(spark, sf_dir), JUDGES)
    return jury.exploded(rows).select("sample_id", "judge_name", "confidence")


@query("j02_complete_samples", J + ", t AS (SELECT sample_id, count(*) AS n FROM judgements WHERE judge_name IN ('judge_1', 'judge_2', 'judge_3') GROUP BY sample_id) SELECT sample_id AS id, 'judge_2,judge_1,judge_3' AS judges FROM t WHERE n = 3")
def j02(spark, sf_dir):
    rows = jury.complete(samples(spark, sf_dir).select("id"), judgements(spark, sf_dir), JUDGES)
    return rows.select("id", F.array_join(F.transform("per_judge_evaluations", lambda x: x["judge_name"]), ",").alias("judges"))


@query("j08_judge_pairs", J + """, l AS (SELECT sample_id, list({'j': judge_name, 'c': confidence}) AS js FROM judgements GROUP BY sample_id), p AS (SELECT sample_id, js, unnest(js) AS a FROM l), q AS (SELECT sample_id, a, unnest(js) AS b FROM p)
    SELECT sample_id, a.j AS judge_a, b.j AS judge_b, round(abs(a.c - b.c), 6) AS gap FROM q WHERE a.j < b.j""")
def j08(spark, sf_dir):
    return jury.pairs(judgements(spark, sf_dir), columns=("confidence",)).select("sample_id", "judge_a", "judge_b", F.round(F.abs(F.col("a_confidence") - F.col("b_confidence")), 6).alias("gap"))


@query("g16_weighted_score", J + f" SELECT sample_id, {SCORE} AS score FROM judgements GROUP BY sample_id")
def g16(spark, sf_dir):
    return jury.weighted_score(judgements(spark, sf_dir), digits=9)


@query("g17_agreement", J + ", " + agreement_sql(None) + " SELECT * FROM agreed")
def g17(spark, sf_dir):
    return jury.agreement(judgements(spark, sf_dir), digits=9)


@query("g17_agreement_weighted", J + ", " + agreement_sql(EW) + " SELECT * FROM agreed")
def g17_weighted(spark, sf_dir):
    return jury.agreement(judgements(spark, sf_dir), EW, digits=9)


TITLES = {"quality_score": "Quality Score", "correctness": "Correctness", "completeness": "Completeness", "clarity": "Clarity", "technical_accuracy": "Technical Accuracy", "logical_flow": "Logical Flow"}


@query("g18_judge_medians", J + " " + " UNION ALL ".join(f"SELECT judge_name, '{t}' AS criterion, round(median({c}), 6) AS median FROM judgements GROUP BY judge_name" for c, t in TITLES.items()))
def g18(spark, sf_dir):
    return jury.medians(judgements(spark, sf_dir))


JUDGED = ", " + agreement_sql(None) + f", scored AS (SELECT sample_id, {SCORE} AS score FROM judgements GROUP BY sample_id), d AS (SELECT s.sample_id, score, agreement, score < 0.4 AS lq, agreement < 0.6 AS la FROM scored s JOIN agreed USING (sample_id))"


def judged(spark, sf_dir):
    j = judgements(spark, sf_dir)
    return jury.rejection(jury.weighted_score(j, digits=9).join(jury.agreement(j, digits=9), "sample_id"), 0.4, 0.6)


@query("f17_rejection_reasons", J + JUDGED + " SELECT sample_id, concat_ws(',', CASE WHEN lq THEN 'low_quality' END, CASE WHEN la THEN 'low_agreement' END) AS reasons FROM d")
def f17(spark, sf_dir):
    return judged(spark, sf_dir).select("sample_id", F.array_join("rejection_reason", ",").alias("reasons"))


@query("g19_run_stats", J + JUDGED + """ SELECT count(*) AS total, count(*) FILTER (WHERE NOT lq AND NOT la) AS kept, count(*) FILTER (WHERE lq OR la) AS rejected, count(*) FILTER (WHERE lq AND NOT la) AS low_quality, count(*) FILTER (WHERE la AND NOT lq) AS low_agreement, count(*) FILTER (WHERE la AND lq) AS "both",
    round(count(*) FILTER (WHERE NOT lq AND NOT la) / count(*), 6) AS kept_rate, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, round(avg(agreement), 6) AS mean_agreement, round(stddev_pop(agreement), 6) AS std_agreement FROM d""")
def g19(spark, sf_dir):
    return jury.run_stats(judged(spark, sf_dir))


@query("k06_routed_decisions", J + JUDGED + " SELECT CASE WHEN lq OR la THEN 'rejected' ELSE 'kept' END AS decision, count(*) AS n FROM d GROUP BY 1")
def k06(spark, sf_dir):
    from quernstone.plans.queries_data import scratch
    from quernstone.sources import writers

    path = scratch(spark, "routed")
    writers.routed(judged(spark, sf_dir).withColumn("decision", F.when(F.size("rejection_reason") > 0, "rejected").otherwise("kept")), path)
    return spark.read.schema("sample_id long, decision string").json(path).groupBy("decision").agg(F.count("*").alias("n"))


@query("g20_criteria_means", J + " SELECT sample_id, " + ", ".join(f"round(avg({c}), 9) AS {c}" for c in C) + " FROM judgements GROUP BY sample_id")
def g20(spark, sf_dir):
    return jury.criteria_means(judgements(spark, sf_dir), digits=9)


NAMED = {"judge_1": 0.5, "judge_2": 0.3, "judge_3": 0.2}
NAMED_SQL = "CASE judge_name WHEN 'judge_1' THEN 0.5 WHEN 'judge_2' THEN 0.3 WHEN 'judge_3' THEN 0.2 ELSE 0.0 END"


@query("g21_judge_weighted_scores", J + ", w AS (SELECT *, CAST(" + NAMED_SQL + " AS DOUBLE) AS w FROM judgements) SELECT sample_id, round(" + " + ".join(f"{x} * coalesce(sum(w * {c}) / nullif(sum(w), 0), 0)" for c, x in AW.items()) + ", 9) AS score FROM w GROUP BY sample_id")
def g21(spark, sf_dir):
    return jury.judge_weighted_scores(judgements(spark, sf_dir), NAMED, digits=9)


M = jury.METRICS
_STD = {c: f"stddev_pop({c})" for c in M}
_RANGE = {c: f"(max({c}) - min({c}))" for c in M}
DISAGREE = "SELECT sample_id, " + ", ".join([f"round({_STD[c]}, 9) AS {c}_std" for c in M] + [f"round({_RANGE[c]}, 9) AS {c}_range" for c in M] + [f"round(CASE WHEN avg({c}) > 0 THEN {_STD[c]} / avg({c}) ELSE 0 END, 9) AS {c}_cv" for c in M]) + f", round(({' + '.join(_STD.values())}) / {len(M)}, 9) AS avg_std, round(({' + '.join(_RANGE.values())}) / {len(M)}, 9) AS avg_range FROM judgements GROUP BY sample_id"


@query("g22_disagreement_metrics", J + " " + DISAGREE)
def g22(spark, sf_dir):
    return jury.disagreement(judgements(spark, sf_dir), digits=9)


@query("g23_disagreement_levels", J + ", d AS (" + DISAGREE + ") SELECT CASE WHEN avg_std < 0.1 THEN 'low' WHEN avg_std < 0.3 THEN 'moderate' ELSE 'high' END AS level, count(*) AS n FROM d GROUP BY 1")
def g23(spark, sf_dir):
    return jury.disagreement(judgements(spark, sf_dir), digits=9).groupBy(jury.disagreement_level(F.col("avg_std")).alias("level")).agg(F.count("*").alias("n"))


@query("g24_confidence_summary", J + " SELECT judge_name, round(avg(confidence), 3) AS mean, round(median(confidence), 3) AS median, round(stddev_samp(confidence), 3) AS std, round(min(confidence), 3) AS min, round(max(confidence), 3) AS max, count(confidence) AS count FROM judgements GROUP BY judge_name")
def g24(spark, sf_dir):
    return jury.confidence_summary(judgements(spark, sf_dir))


@query("g25_pair_disagreement", J + " SELECT a.judge_name AS judge_a, b.judge_name AS judge_b, round(sum(abs(a.confidence - b.confidence)) / (SELECT count(DISTINCT sample_id) FROM judgements), 6) AS disagreement FROM judgements a JOIN judgements b ON a.sample_id = b.sample_id AND a.judge_name < b.judge_name GROUP BY ALL")
def g25(spark, sf_dir):
    return jury.pair_disagreement(judgements(spark, sf_dir))


@query("g31_variant_comparison", J + " SELECT judge_name, count(clarity) AS count, round(avg(clarity), 6) AS mean, round(stddev_pop(clarity), 6) AS std, round(min(clarity), 6) AS min, round(max(clarity), 6) AS max, round(quantile_cont(clarity, 0.5), 6) AS p50, round(quantile_cont(clarity, 0.95), 6) AS p95, round(quantile_cont(clarity, 0.99), 6) AS p99 FROM judgements GROUP BY judge_name")
def g31(spark, sf_dir):
    return stats.by_variant(judgements(spark, sf_dir), "judge_name", "clarity")


@query("x41_titled_names", " UNION ALL ".join(f"SELECT '{c}' AS name, '{t}' AS title" for c, t in TITLES.items()))
def x41(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in TITLES], "name string").select("name", jury.titled(F.col("name")).alias("title"))


@query("x42_judge_file_names", "SELECT DISTINCT 'judge_' || l_linenumber || '_vul' AS file, 'judge-' || l_linenumber AS judge FROM lineitem")
def x42(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("judge_"), F.col("l_linenumber").cast("string"), F.lit("_vul")).alias("file")).distinct()
    return files.select("file", jury.file_judge(F.col("file")).alias("judge"))


@query("x44_judge_short_names", J + " SELECT DISTINCT judge_name, CASE judge_name WHEN 'judge_1' THEN 'One' WHEN 'judge_2' THEN 'Two' END AS short FROM judgements")
def x44(spark, sf_dir):
    return judgements(spark, sf_dir).select("judge_name").distinct().select("judge_name", jury.short_name(F.col("judge_name"), {"judge_1": "One", "judge_2": "Two"}).alias("short"))


@query("k09_export_scores", J + f" SELECT sample_id, {SCORE} AS score FROM judgements GROUP BY sample_id")
def k09(spark, sf_dir):
    from quernstone.plans.queries_data import scratch
    from quernstone.sources import writers

    path = scratch(spark, "scores")
    writers.csv(jury.weighted_score(judgements(spark, sf_dir), digits=9), path)
    return spark.read.schema("sample_id long, score double").option("header", True).csv(path)


CONFUSION = "c AS (SELECT count(*) FILTER (WHERE gt = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE gt <> 1 AND pred <> 1) AS tn, count(*) FILTER (WHERE gt <> 1 AND pred = 1) AS fp, count(*) FILTER (WHERE gt = 1 AND pred <> 1) AS fn FROM predictions)"


@query("g34_confusion", P + ", " + CONFUSION + " SELECT * FROM c")
def g34(spark, sf_dir):
    return evaluate.confusion(predictions(spark, sf_dir))


@query("g35_binary_report", P + ", " + CONFUSION + """, r AS (SELECT 'safe' AS name, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS s FROM c UNION ALL SELECT 'vulnerable', tp / (tp + fp), tp / (tp + fn), tp + fn FROM c),
    f AS (SELECT *, 2 * p * r / (p + r) AS f FROM r), a AS (SELECT name, p, r, f, s FROM f UNION ALL SELECT 'accuracy', x, x, x, n FROM (SELECT (tp + tn) / (tp + tn + fp + fn) AS x, tp + tn + fp + fn AS n FROM c)
    UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(s) AS BIGINT) FROM f UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), CAST(sum(s) AS BIGINT) FROM f)
    SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM a""")
def g35(spark, sf_dir):
    return evaluate.binary_report(predictions(spark, sf_dir))


@query("g35_quality_report", "WITH predictions AS (SELECT CAST(toxic AS INTEGER) AS gt, CAST(quality = 0 AS INTEGER) AS pred FROM labels), " + CONFUSION + " SELECT * FROM c")
def g35_labels(spark, sf_dir):
    return evaluate.confusion(table(spark, sf_dir, "labels").select(F.col("toxic").alias("gt"), (F.col("quality") == 0).cast("int").alias("pred")))


LONG = """, t AS (SELECT DISTINCT id, unnest(gt_cwes) AS label FROM predictions), q AS (SELECT DISTINCT id, unnest(pred_cwes) AS label FROM predictions),
    l AS (SELECT coalesce(t.id, q.id) AS id, coalesce(t.label, q.label) AS label, CAST(t.id IS NOT NULL AS INTEGER) AS g, CAST(q.id IS NOT NULL AS INTEGER) AS p FROM t FULL JOIN q ON t.id = q.id AND t.label = q.label),
    v AS (SELECT * FROM l WHERE label IN (SELECT label FROM t)),
    k AS (SELECT label, CAST(sum(g * p) AS BIGINT) AS tp, CAST(sum((1 - g) * p) AS BIGINT) AS fp, CAST(sum(g * (1 - p)) AS BIGINT) AS fn FROM v GROUP BY label)"""
PRF = "coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, 2 * tp / (2 * tp + fp + fn) AS f"


@query("g36_label_report", P + LONG + f", m AS (SELECT *, {PRF} FROM k) SELECT label, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, tp + fn AS support FROM m")
def g36(spark, sf_dir):
    return evaluate.label_report(predictions(spark, sf_dir))


@query("g37_label_averages", P + LONG + f""", m AS (SELECT *, tp + fn AS s, {PRF} FROM k), e AS (SELECT id, sum(g * p) AS tp, sum(p) AS np, sum(g) AS ng FROM v GROUP BY id), z AS (SELECT coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng FROM predictions LEFT JOIN e USING (id))
    SELECT 'micro' AS average, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM m
    UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM m
    UNION ALL SELECT 'weighted', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6) FROM m
    UNION ALL SELECT 'samples', round(avg(coalesce(tp / nullif(np, 0), 0)), 6), round(avg(coalesce(tp / nullif(ng, 0), 0)), 6), round(avg(coalesce(2 * tp / nullif(np + ng, 0), 0)), 6) FROM z""")
def g37(spark, sf_dir):
    return evaluate.label_averages(predictions(spark, sf_dir))


COVERED = """, near AS (SELECT parent AS a, child AS b FROM edges UNION SELECT child, parent FROM edges),
    h AS (SELECT id, gt_cwes, pred_cwes, list_sort(list_distinct(gt_cwes)) = list_sort(list_distinct(pred_cwes)) AS strict,
        CASE WHEN len(gt_cwes) = 0 THEN len(pred_cwes) = 0 ELSE NOT EXISTS (SELECT 1 FROM (SELECT unnest(gt_cwes) AS g) u WHERE NOT array_contains(pred_cwes, g) AND NOT EXISTS (SELECT 1 FROM near WHERE a = g AND array_contains(pred_cwes, b))) END AS loose FROM predictions)"""


@query("j12_hierarchy_coverage", P + ", " + EDGES + COVERED + " SELECT id, loose AS acceptable FROM h")
def j12(spark, sf_dir):
    return predictions(spark, sf_dir).select("id", evaluate.acceptable(F.col("gt_cwes"), F.col("pred_cwes"), HIERARCHY).alias("acceptable"))


@query("g38_hierarchical_metrics", P + ", " + EDGES + COVERED + ", n AS (SELECT count(*) AS n, count(*) FILTER (WHERE strict) AS s, count(*) FILTER (WHERE strict OR loose) AS l FROM h WHERE len(gt_cwes) > 0) SELECT n, s AS strict, l AS hierarchical, round(s / n, 6) AS strict_rate, round(l / n, 6) AS hierarchical_rate, round((l - s) / n, 6) AS gain FROM n")
def g38(spark, sf_dir):
    return evaluate.hierarchical(predictions(spark, sf_dir), HIERARCHY)


@query("g38_error_patterns", P + """, w AS (SELECT array_to_string(list_sort(list_distinct(gt_cwes)), ',') AS truth, array_to_string(list_sort(list_distinct(pred_cwes)), ',') AS prediction FROM predictions WHERE len(gt_cwes) > 0)
    SELECT truth, prediction, count(*) AS n FROM w WHERE truth <> prediction GROUP BY ALL ORDER BY n DESC, truth, prediction LIMIT 10""")
def g38_patterns(spark, sf_dir):
    return evaluate.patterns(predictions(spark, sf_dir))


@query("u07_strict_match", P + " SELECT id, list_sort(list_distinct(gt_cwes)) = list_sort(list_distinct(pred_cwes)) AS same FROM predictions")
def u07(spark, sf_dir):
    return predictions(spark, sf_dir).select("id", evaluate.same_set(F.col("gt_cwes"), F.col("pred_cwes")).alias("same"))


@query("g39_performers", P + LONG + f", m AS (SELECT label, tp + fn AS s, round(2 * tp / (2 * tp + fp + fn), 6) AS f FROM k WHERE tp + fn > 0) (SELECT label, f AS f1, s AS support, 'top' AS \"end\" FROM m ORDER BY f DESC, s DESC, label LIMIT 5) UNION ALL (SELECT label, f, s, 'bottom' FROM m ORDER BY f, s DESC, label LIMIT 5)")
def g39(spark, sf_dir):
    return evaluate.performers(evaluate.label_report(predictions(spark, sf_dir))).select("label", "f1", "support", "end")


@query("j11_label_metric_lookup", P + LONG + " SELECT id, v.label, tp FROM v JOIN k ON v.label = k.label WHERE g = 1")
def j11(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return evaluate.label_pairs(p).filter("g = 1").join(evaluate.label_report(p).select("label", "tp"), "label").select("id", "label", "tp")


@query("g48_errors", P + ", " + CONFUSION + " SELECT fp, fn, round((fp + fn) / (tp + tn + fp + fn), 6) AS error_rate FROM c")
def g48(spark, sf_dir):
    return evaluate.errors(predictions(spark, sf_dir))


@query("x40_verdict_warnings", P + " SELECT id, CASE WHEN gt = 1 AND len(pred_cwes) = 0 THEN 'vulnerable_without_labels' WHEN gt <> 1 AND len(pred_cwes) > 0 THEN 'safe_with_labels' END AS warning FROM predictions")
def x40(spark, sf_dir):
    return predictions(spark, sf_dir).select("id", evaluate.verdict_warning(F.col("gt") == 1, F.col("pred_cwes")).alias("warning"))


GENERIC = (1, 10, 20)
DIAG = P + """, d AS (SELECT id, 'cat' || id % 3 AS category, gt_cwes[1:2] AS e, list_concat(gt_cwes, [1]) AS a, pred_cwes AS p FROM predictions),
    x AS (SELECT *, CASE WHEN len(e) = 0 THEN len(p) = 0 ELSE list_has_any(e, p) END AS exact, CASE WHEN len(e) = 0 THEN len(p) = 0 ELSE list_has_any(list_concat(e, a), p) END AS good FROM d),
    y AS (SELECT *, NOT exact AND list_has_any([1, 10, 20], p) AND list_has_any(a, p) AS wide FROM x),
    z AS (SELECT *, CASE WHEN len(e) = 0 AND len(p) = 0 THEN 'CORRECT' WHEN len(e) = 0 THEN 'FP' WHEN len(p) = 0 THEN 'FN' WHEN exact THEN 'EXACT' WHEN wide THEN 'OVER-GEN' WHEN good THEN 'ACCEPT' ELSE 'WRONG' END AS status FROM y)"""


def diagnosed(spark, sf_dir):
    p = predictions(spark, sf_dir)
    cases = p.select("id", F.concat(F.lit("cat"), (F.col("id") % 3).cast("string")).alias("category"), F.slice("gt_cwes", 1, 2).alias("expected"), F.array_append("gt_cwes", F.lit(1)).alias("accepted"), F.col("pred_cwes").alias("predicted"))
    return evaluate.diagnose(cases, HIERARCHY, GENERIC)


@query("x38_diagnostic_predicates", DIAG + " SELECT id, exact AS is_exact, good AS is_acceptable, wide AS is_over_generalized, len(e) > 0 AND len(p) = 0 AS is_false_negative, len(e) = 0 AND len(p) > 0 AS is_false_positive FROM z")
def x38(spark, sf_dir):
    return diagnosed(spark, sf_dir).select("id", "is_exact", "is_acceptable", "is_over_generalized", "is_false_negative", "is_false_positive")


@query("x39_diagnostic_status", DIAG + " SELECT id, status FROM z")
def x39(spark, sf_dir):
    return diagnosed(spark, sf_dir).select("id", "status")


@query("g40_diagnostic_summary", DIAG + " SELECT category, count(*) AS total, count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE good) AS acceptable, count(*) FILTER (WHERE wide) AS over_generalized, count(*) FILTER (WHERE len(e) > 0 AND len(p) = 0) AS false_negative, count(*) FILTER (WHERE len(e) = 0 AND len(p) > 0) AS false_positive, CAST(0 AS BIGINT) AS errors FROM z GROUP BY category")
def g40(spark, sf_dir):
    return evaluate.diagnostic_summary(diagnosed(spark, sf_dir), ("category",)).drop("hierarchical")


@query("j06_case_categories", DIAG + " SELECT id, CASE WHEN category = 'cat2' THEN 'unknown' ELSE category END AS category FROM z")
def j06(spark, sf_dir):
    d = diagnosed(spark, sf_dir)
    known = d.filter("category <> 'cat2'").select(F.col("id").alias("__case"), "category")
    return d.select("id").join(known, F.col("id") == F.col("__case"), "left").select("id", F.coalesce("category", F.lit("unknown")).alias("category"))


def stand_in(code: str) -> str:
    """A model for the built-in suite that goes by a few words; it fails where code looks something up."""
    if "find(" in code:
        raise ValueError("out of memory")
    found = [415] if code.count("free(") > 1 else [120] if "cpy(" in code or "gets(" in code else [119] if "slots" in code else [401] if "malloc" in code and ("for (;;)" in code or "while" in code) else []
    listed = ", ".join(f'{{"cwe_id": {n}, "description": "d"}}' for n in found)
    return f'{{"reasoning": "r", "vulnerabilities": [{listed}], "verdict": {{"is_vulnerable": {str(bool(found)).lower()}, "cwe_list": {found}}}}}'


SUITE = {
    "OVER-GEN": "a01", "FN": "a02 b01 b02 c03 d01 d02 e01 e02 f01 h01 h02", "EXACT": "a03 c01 c02 e03 e05 e06", "CORRECT": "d03 e04 g02 g03", "FP": "g01", "ERROR": "f02",
}


@query("e06_builtin_suite", "SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{status}')" for status, ids in SUITE.items() for i in ids.split()) + ") AS v(id, status)")
def e06(spark, sf_dir):
    return diagnostics.diagnosed(diagnostics.cases(spark), stand_in).select("id", "status")


@query("f22_category_filter", DIAG + " SELECT id FROM z WHERE category IN ('cat0', 'cat2')")
def f22(spark, sf_dir):
    return diagnosed(spark, sf_dir).filter(F.col("category").isin("cat0", "cat2")).select("id")


@query("f23_j13_realign_by_id", P + " SELECT p.id, p.gt, p.pred FROM predictions p WHERE id % 7 <> 0")
def f23(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.select("id", "gt").join(p.filter("id % 7 <> 0").select("id", "pred"), "id")
