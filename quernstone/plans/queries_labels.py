"""Queries over labelled samples: lookups, frequencies, filters, balancing, splitting."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quernstone.operators import balance, filters, labels, split, stats
from quernstone.plans.registry import flagship, query
from quernstone.plans.standins import DESCRIBED, DICTIONARY, SAMPLES, described, dictionary, samples
from quernstone.session import cut
from quernstone.sources import writers

S = "WITH " + SAMPLES
D = "WITH " + DESCRIBED
NUM = "TRY_CAST(trim(replace({}, 'CWE-', '')) AS INTEGER)"
RARE = 200


def vulnerable(spark, sf_dir):
    return samples(spark, sf_dir).filter("target = 1")


def rounds(n: int, t: int) -> str:
    """Common tables v1 .. vn of n rounds of the frequency filter over vulnerable samples."""
    out = "v0 AS (SELECT * FROM samples WHERE target = 1)"
    for i in range(1, n + 1):
        out += f""", f{i} AS (SELECT c AS label FROM (SELECT unnest(cwe) AS c FROM v{i - 1}) GROUP BY c HAVING count(*) > {t}),
        v{i} AS (SELECT v.* FROM v{i - 1} v WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(v.cwe) AS c) x WHERE x.c NOT IN (SELECT label FROM f{i})))"""
    return out


ROUNDS = "WITH " + SAMPLES + ", " + rounds(8, 100)


@query("f11_iterative_frequency_filter", ROUNDS + " SELECT id, CAST(target AS INTEGER) AS target, array_to_string(cwe, ',') AS labels FROM v8")
def f11(spark, sf_dir):
    kept, _, _ = filters.iterative_frequency(vulnerable(spark, sf_dir), 100)
    return kept.select("id", "target", F.array_join("cwe", ",").alias("labels"))


@query("f11_iterative_filter_removed", ROUNDS + " SELECT id FROM v0 WHERE id NOT IN (SELECT id FROM v8)")
def f11_removed(spark, sf_dir):
    return filters.iterative_frequency(vulnerable(spark, sf_dir), 100)[1].select("id")


@query("g05_flagship_label_stats", "WITH " + DESCRIBED + ", " + rounds(8, 100).replace("FROM samples WHERE", "FROM described WHERE") + """
    SELECT label, count(*) AS n, coalesce(first(d ORDER BY id, i) FILTER (WHERE d <> ''), '') AS description
    FROM (SELECT id, unnest(cwe) AS label, unnest(cwe_desc) AS d, generate_subscripts(cwe, 1) AS i FROM v8) GROUP BY label""")
def g05(spark, sf_dir):
    return flagship(spark, sf_dir, 100)


@query("j01_enrich_labels", D + " SELECT id, array_to_string(cwe_desc, '|') AS descriptions FROM described")
def j01(spark, sf_dir):
    return described(spark, sf_dir).select("id", F.array_join("cwe_desc", "|").alias("descriptions"))


@query("j01_enrich_by_join", D + " SELECT id, array_to_string(cwe_desc, '|') AS descriptions FROM described")
def j01_join(spark, sf_dir):
    got = labels.enrich(samples(spark, sf_dir), dictionary(spark, sf_dir), map_rows=0)
    return got.select("id", F.array_join("cwe_desc", "|").alias("descriptions"))


@query("j01_enrich_by_map", D + " SELECT id, array_to_string(cwe_desc, '|') AS descriptions FROM described")
def j01_map(spark, sf_dir):
    table = {r.id: r.description for r in dictionary(spark, sf_dir).collect()}
    return labels.enrich_by_map(samples(spark, sf_dir), table).select("id", F.array_join("cwe_desc", "|").alias("descriptions"))


@query("g08_label_summary", S + """, c AS (SELECT label, count(*) AS n FROM (SELECT unnest(cwe) AS label FROM samples WHERE target = 1) GROUP BY label), t AS (SELECT n, sum(n) OVER (ORDER BY n, label ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM c)
    SELECT count(*) AS labels, CAST(max(total) AS BIGINT) AS total, round((count(*) + 1 - 2 * sum(cum / total)) / count(*), 6) AS gini, round(-sum(n / total * log2(n / total)), 6) AS entropy, max(n) AS most, min(n) AS least FROM t""")
def g08(spark, sf_dir):
    counts = labels.frequencies(samples(spark, sf_dir).filter("target = 1"))
    return stats.inequality(counts).crossJoin(counts.agg(F.max("n").alias("most"), F.min("n").alias("least")))


@query("w09_top_lists", S + """, c AS (SELECT label, count(*) AS n FROM (SELECT unnest(cwe) AS label FROM samples) GROUP BY label), r AS (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS i, row_number() OVER (ORDER BY n, label) AS j FROM c)
    SELECT k, label, n, 'top' AS "end" FROM r, (VALUES (5), (10), (30)) AS v(k) WHERE i <= k UNION ALL SELECT k, label, n, 'bottom' FROM r, (VALUES (5), (10), (30)) AS v(k) WHERE j <= k""")
def w09(spark, sf_dir):
    counts = labels.frequencies(samples(spark, sf_dir))
    parts = [stats.bottom_top(counts, k).withColumn("k", F.lit(k)) for k in (5, 10, 30)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("j03_label_status_lookup", S + ", " + DICTIONARY + " SELECT id, label, coalesce(status, 'unknown') AS status FROM (SELECT id, unnest(cwe) AS label FROM samples) s LEFT JOIN (SELECT id AS k, status FROM dictionary) d ON replace(label, 'CWE-', '') = k")
def j03(spark, sf_dir):
    return labels.with_status(samples(spark, sf_dir), dictionary(spark, sf_dir)).select(F.col("row").alias("id"), "label", "status")


@query("j03_labels_not_in_dictionary", S + ", " + DICTIONARY + " SELECT DISTINCT label FROM (SELECT unnest(cwe) AS label FROM samples) WHERE replace(label, 'CWE-', '') NOT IN (SELECT id FROM dictionary)")
def j03_anti(spark, sf_dir):
    each = labels.frequencies(samples(spark, sf_dir)).select("label")
    return each.join(dictionary(spark, sf_dir), labels.strip_prefix(F.col("label")) == F.col("id"), "left_anti")


@query("j04_frequent_membership", S + f", f AS (SELECT c FROM (SELECT unnest(cwe) AS c FROM samples) GROUP BY c HAVING count(*) >= {RARE}) SELECT id, label FROM (SELECT id, unnest(cwe) AS label FROM samples) WHERE label IN (SELECT c FROM f)")
def j04(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s.select("id", F.explode("cwe").alias("label")).join(labels.frequent(labels.frequencies(s), RARE), "label", "left_semi").select("id", "label")


@query("g01_label_frequencies", S + " SELECT c AS label, count(*) AS n FROM (SELECT unnest(cwe) AS c FROM samples) GROUP BY c")
def g01(spark, sf_dir):
    return labels.frequencies(samples(spark, sf_dir))


@query("g02_numeric_frequencies", S + f" SELECT {NUM.format('c')} AS label, count(*) AS n FROM (SELECT unnest(cwe) AS c FROM samples) GROUP BY ALL")
def g02(spark, sf_dir):
    return labels.numeric_frequencies(samples(spark, sf_dir))


@query("g02_unreadable_rows", S + ", m AS (SELECT CASE WHEN id % 9 = 0 THEN list_concat(cwe, ['CWE-x']) ELSE cwe END AS cwe FROM samples) SELECT count(*) FILTER (WHERE array_contains(cwe, 'CWE-x')) AS errors FROM m")
def g02_bad(spark, sf_dir):
    s = samples(spark, sf_dir)
    return labels.unreadable_rows(s.withColumn("cwe", F.when(F.col("id") % 9 == 0, F.array_append("cwe", F.lit("CWE-x"))).otherwise(F.col("cwe"))))


@query("g03_target_counts", S + " SELECT target, count(*) AS n FROM samples GROUP BY target")
def g03(spark, sf_dir):
    return stats.class_counts(samples(spark, sf_dir))


@query("g06_projects_and_multi_labels", S + " SELECT count(DISTINCT project) AS projects, count(*) FILTER (WHERE len(cwe) > 1) AS multi_label FROM samples")
def g06(spark, sf_dir):
    return samples(spark, sf_dir).agg(F.countDistinct("project").alias("projects"), F.count_if(F.size("cwe") > 1).alias("multi_label"))


INEQUALITY = ", c AS (SELECT c AS label, count(*) AS n FROM (SELECT unnest(cwe) AS c FROM samples) GROUP BY c), r AS (SELECT n, sum(n) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM c)"


@query("g07_gini_entropy", S + INEQUALITY + " SELECT count(*) AS labels, CAST(max(total) AS BIGINT) AS total, round((count(*) + 1 - 2 * sum(cum / total)) / count(*), 6) AS gini, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM r")
def g07(spark, sf_dir):
    return stats.inequality(labels.frequencies(samples(spark, sf_dir)))


@query("g33_status_audit", S + ", " + DICTIONARY + """, e AS (SELECT s.id AS r, label, lower(coalesce(status, 'unknown')) AS st FROM (SELECT id, unnest(cwe) AS label FROM samples) s LEFT JOIN (SELECT id AS k, status FROM dictionary) d ON replace(label, 'CWE-', '') = k)
    SELECT CASE WHEN st IN ('deprecated', 'draft', 'unknown') THEN st WHEN st IN ('stable', 'incomplete') THEN 'stable' ELSE 'other' END AS bucket, count(DISTINCT label) AS labels, count(*) AS occurrences, count(DISTINCT r) AS rows_affected FROM e GROUP BY 1""")
def g33(spark, sf_dir):
    return labels.status_audit(samples(spark, sf_dir), dictionary(spark, sf_dir))


@query("g45_total_labels", S + " SELECT CAST(sum(n) AS BIGINT) AS total FROM (SELECT len(cwe) AS n FROM samples)")
def g45(spark, sf_dir):
    return labels.frequencies(samples(spark, sf_dir)).agg(F.sum("n").alias("total"))


VALID = "len(cwe) > 0 AND len(cwe_desc) > 0 AND len(list_filter(cwe_desc, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') = '' OR x = 'Description not found.')) = 0"


@query("f03_valid_examples", D + f" SELECT id FROM described WHERE {VALID}")
def f03(spark, sf_dir):
    return described(spark, sf_dir).filter(filters.valid_labels()).select("id")


@query("f04_valid_for_training", D + f" SELECT id, target FROM described WHERE target = 0 OR ({VALID})")
def f04(spark, sf_dir):
    return described(spark, sf_dir).filter(filters.valid_for_training()).select("id", "target")


@query("f05_drop_fields", S + " SELECT id, project FROM samples")
def f05(spark, sf_dir):
    return filters.drop_fields(samples(spark, sf_dir).withColumns({"agreement": F.lit(1.0), "quality_score": F.lit(1.0)}).select("id", "project", "agreement", "quality_score"))


@query("f06_clear_safe", D + " SELECT id, CASE WHEN target = 0 THEN '' ELSE array_to_string(cwe, ',') END AS cwe, CASE WHEN target = 0 THEN '' ELSE array_to_string(cwe_desc, ',') END AS cwe_desc FROM described")
def f06(spark, sf_dir):
    return filters.clear_safe(described(spark, sf_dir)).select("id", F.array_join("cwe", ",").alias("cwe"), F.array_join("cwe_desc", ",").alias("cwe_desc"))


ONE = S + f", v0 AS (SELECT * FROM samples WHERE target = 1), f AS (SELECT c FROM (SELECT unnest(cwe) AS c FROM v0) GROUP BY c HAVING count(*) > {RARE}), b AS (SELECT DISTINCT id FROM (SELECT id, unnest(cwe) AS c FROM v0) WHERE c NOT IN (SELECT c FROM f))"


@query("f09_by_frequency_kept", ONE + " SELECT id FROM v0 WHERE id NOT IN (SELECT id FROM b)")
def f09(spark, sf_dir):
    return filters.by_frequency(vulnerable(spark, sf_dir), RARE)[0].select("id")


@query("f09_by_frequency_filtered", ONE + " SELECT id FROM b")
def f09_filtered(spark, sf_dir):
    return filters.by_frequency(vulnerable(spark, sf_dir), RARE)[1].select("id")


@query("f10_loose_filter", D + f", w AS (SELECT * FROM described WHERE target = 1 AND {VALID}), f AS (SELECT c FROM (SELECT unnest(cwe) AS c FROM w) GROUP BY c HAVING count(*) > 5), b AS (SELECT DISTINCT id FROM (SELECT id, unnest(cwe) AS c FROM w) WHERE c NOT IN (SELECT c FROM f)) SELECT CASE WHEN id IN (SELECT id FROM b) THEN 'filtered' ELSE 'kept' END AS part, count(*) AS n, count(DISTINCT project) AS projects FROM w GROUP BY 1")
def f10(spark, sf_dir):
    kept, gone = filters.by_frequency(cut(described(spark, sf_dir).filter((F.col("target") == 1) & filters.valid_labels())), 5)
    both = kept.withColumn("part", F.lit("kept")).unionByName(gone.withColumn("part", F.lit("filtered")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("project").alias("projects"))


@query("f12_filter_dataset", ROUNDS + " SELECT id, target, array_to_string(cwe, ',') AS labels FROM v8 UNION ALL SELECT id, target, '' FROM samples WHERE target = 0")
def f12(spark, sf_dir):
    s = samples(spark, sf_dir)
    kept, _, _ = filters.iterative_frequency(s.filter("target = 1"), 100)
    return filters.clear_safe(s.filter("target = 0"), ("cwe",)).unionByName(kept).select("id", "target", F.array_join("cwe", ",").alias("labels"))


SINGLE = S + f", f AS (SELECT {NUM.format('c')} AS c FROM (SELECT unnest(cwe) AS c FROM samples) GROUP BY 1 HAVING count(*) >= 1000)"
REASON = "CASE WHEN target = 0 THEN 'safe' WHEN target <> 1 THEN 'other' WHEN len(cwe) < 1 THEN 'removed_empty' WHEN len(cwe) > 1 THEN 'removed_multi' WHEN " + NUM.format("cwe[1]") + " IN (SELECT c FROM f) THEN 'kept' ELSE 'removed_rare' END"


@query("f13_single_frequent_label", SINGLE + f" SELECT id, {REASON} AS reason FROM samples")
def f13(spark, sf_dir):
    s = samples(spark, sf_dir)
    return filters.single_frequent_label(labels.numeric_frequencies(s), s, 1000)


@query("f13_counts_by_reason", SINGLE + f" SELECT {REASON} AS reason, count(*) AS n FROM samples GROUP BY 1")
def f13_counts(spark, sf_dir):
    return f13(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query("f14_preview", SINGLE + f""", e AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE {NUM.format('c')} IN (SELECT c FROM f)) AS k FROM (SELECT id, unnest(cwe) AS c FROM samples WHERE target = 1) GROUP BY id)
    SELECT count(*) FILTER (WHERE k = n) AS kept, count(*) FILTER (WHERE k = 0) AS removed_rare_only, count(*) FILTER (WHERE k > 0 AND k < n) AS removed_mixed FROM e""")
def f14(spark, sf_dir):
    s = samples(spark, sf_dir)
    return filters.preview(s, labels.numeric_frequencies(s), 1000)


@query("f15_route_targets", S + " SELECT id, CASE WHEN target = 1 AND len(cwe) > 0 THEN 'vulnerable' WHEN target = 0 THEN 'safe' ELSE 'dropped' END AS decision FROM samples")
def f15(spark, sf_dir):
    return filters.route_targets(samples(spark, sf_dir)).select("id", "decision")


RANGE = """, q AS (SELECT quantile_cont(token_count, 0.05) AS t1, quantile_cont(token_count, 0.99) AS t2, quantile_cont(complexity, 0.05) AS c1, quantile_cont(complexity, 0.99) AS c2 FROM samples),
    ranged AS (SELECT samples.* FROM samples, q WHERE token_count BETWEEN t1 AND t2 AND complexity BETWEEN greatest(3, c1) AND c2)"""


@query("f16_quantile_range", S + RANGE + " SELECT id FROM ranged")
def f16(spark, sf_dir):
    return balance.quantile_range(samples(spark, sf_dir)).select("id")


@query("f18_required_columns", S + " SELECT id, project FROM samples")
def f18(spark, sf_dir):
    return filters.required_columns(samples(spark, sf_dir), ("id", "project", "func", "reasoning"))


@query("f19_sanitize", S + " SELECT id, array_to_string(cwe, ',') AS labels FROM samples")
def f19(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("cwe", F.when(F.size("cwe") > 0, F.concat(F.array(F.lit(""), F.lit(None).cast("string")), F.col("cwe"))))
    return filters.sanitized(s, ("cwe",)).select("id", F.array_join("cwe", ",").alias("labels"))


@query("f20_repeated_labels", S + ", e AS (SELECT id, unnest(cwe) AS label FROM samples WHERE target = 1) SELECT id, label FROM e WHERE label IN (SELECT label FROM e GROUP BY label HAVING count(*) > 60)")
def f20(spark, sf_dir):
    return filters.repeated_labels(vulnerable(spark, sf_dir), more_than=60).select("id", "label")


@query("x17_strip_prefix", S + " SELECT DISTINCT label, replace(label, 'CWE-', '') AS bare FROM (SELECT unnest(cwe) AS label FROM samples)")
def x17(spark, sf_dir):
    return labels.frequencies(samples(spark, sf_dir)).select("label", labels.strip_prefix(F.concat(F.lit(" "), "label", F.lit("\n"))).alias("bare"))


@query("x18_label_number", S + f" SELECT DISTINCT label, {NUM.format('label')} AS number FROM (SELECT unnest(cwe) AS label FROM samples)")
def x18(spark, sf_dir):
    return labels.frequencies(samples(spark, sf_dir)).select("label", labels.number(F.col("label")).alias("number"))


@query("x19_clean_label", S + " SELECT DISTINCT label AS clean FROM (SELECT unnest(cwe) AS label FROM samples)")
def x19(spark, sf_dir):
    return labels.frequencies(samples(spark, sf_dir)).select(labels.clean(F.concat(F.lit("['"), "label", F.lit(" ']"))).alias("clean"))


@query("s_labels_from_text", S + " SELECT id, array_to_string(cwe, ',') AS labels FROM samples")
def from_text(spark, sf_dir):
    text = F.when(F.size("cwe") == 1, F.col("cwe")[0]).otherwise(F.to_json("cwe"))
    return samples(spark, sf_dir).select("id", F.array_join(labels.from_scalar(text), ",").alias("labels"))


MEDIAN = """, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY token_count, id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM (SELECT id, token_count, unnest(cwe) AS label FROM {t}))"""
CENTRED = "n <= {k} OR (i >= greatest(0, least(n // 2 - {k} // 2, n - {k})) AND i < greatest(0, least(n // 2 - {k} // 2, n - {k})) + {k})"


@query("w01_median_centred", S + MEDIAN.format(t="samples") + f" SELECT id, label FROM r WHERE {CENTRED.format(k=25)}")
def w01(spark, sf_dir):
    pairs = samples(spark, sf_dir).select("id", "token_count", F.explode("cwe").alias("label"))
    return balance.median_centred(pairs, 25, ("label",)).select("id", "label")


@query("w02_around_median", S + """, e AS (SELECT id, token_count AS v, unnest(cwe) AS label FROM samples), m AS (SELECT label, quantile_cont(v, 0.5) AS m FROM e GROUP BY label),
    r AS (SELECT id, e.label, v, m, row_number() OVER (PARTITION BY e.label ORDER BY v, id) - 1 AS i, count(*) OVER (PARTITION BY e.label) AS n FROM e JOIN m ON e.label = m.label),
    a AS (SELECT *, first_value(i) OVER (PARTITION BY label ORDER BY abs(v - m), i) AS spot FROM r)
    SELECT id, label FROM a WHERE n <= 25 OR (i >= greatest(0, least(spot - 12, n - 25)) AND i < greatest(0, least(spot - 12, n - 25)) + 25)""")
def w02(spark, sf_dir):
    pairs = samples(spark, sf_dir).select("id", "token_count", F.explode("cwe").alias("label"))
    return balance.around_median(pairs, 25, ("label",)).select("id", "label")


PICKED = MEDIAN.format(t="(SELECT * FROM ranged WHERE target = 1)") + f", picked AS (SELECT DISTINCT id FROM r WHERE n >= 100 AND ({CENTRED.format(k=40)}))"


@query("w03_per_label_selection", S + RANGE + PICKED + " SELECT id FROM picked")
def w03(spark, sf_dir):
    return balance.per_label_selection(balance.quantile_range(samples(spark, sf_dir)).filter("target = 1"), 40, 100).select("id")


def edges(column: str, base: str, bins: int) -> str:
    points = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"(SELECT list_sort(list_distinct(quantile_cont({column}, [{points}]))) FROM {base})"


def bins_of(table: str, base: str, bins: int, name: str) -> str:
    cell = lambda c, e: f"CASE WHEN {c} >= {e}[1] AND {c} <= {e}[-1] THEN greatest(0, len(list_filter({e}, lambda x: x < {c})) - 1) END"
    return f"{name}_e AS (SELECT {edges('complexity', base, bins)} AS ce, {edges('token_count', base, bins)} AS te), {name} AS (SELECT * FROM (SELECT t.*, {cell('complexity', 'ce')} AS cb, {cell('token_count', 'te')} AS tb FROM {table} t, {name}_e) WHERE cb IS NOT NULL AND tb IS NOT NULL)"


@query("w05_quantile_bins", S + ", vul AS (SELECT * FROM samples WHERE target = 1), " + bins_of("samples", "vul", 20, "b") + " SELECT id, CAST(cb AS INTEGER) AS complexity_bin, CAST(tb AS INTEGER) AS token_count_bin FROM b")
def w05(spark, sf_dir):
    s = samples(spark, sf_dir)
    return balance.with_bins(s, s.filter("target = 1"), ("complexity", "token_count"), 20).select("id", "complexity_bin", "token_count_bin")


def matched(vul: str, safe: str, base: str, bins: int) -> str:
    return bins_of(vul, base, bins, "vb") + ", " + bins_of(safe, base, bins, "sb") + """, want AS (SELECT cb, tb, count(*) AS k FROM vb GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cb, tb ORDER BY md5(id || ':42'), id) AS i FROM sb), matched AS (SELECT ranked.* FROM ranked JOIN want USING (cb, tb) WHERE i <= k)"""


PARTS = ", vul AS (SELECT * FROM samples WHERE target = 1), safe AS (SELECT * FROM samples WHERE target = 0), "


@query("b01_stratified", S + PARTS + matched("vul", "safe", "vul", 20) + " SELECT id FROM matched")
def b01(spark, sf_dir):
    s = samples(spark, sf_dir)
    return balance.stratified(s.filter("target = 1"), s.filter("target = 0"), bins=20).select("id")


@query("b02_stratified_or_fallback", S + PARTS + matched("vul", "safe", "samples", 20) + """, enough AS (SELECT (SELECT count(*) FROM matched) >= 0.95 * (SELECT count(*) FROM vul) AS ok)
    SELECT id FROM matched, enough WHERE ok UNION ALL SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(id || ':42'), id) AS i FROM safe), enough WHERE NOT ok AND i <= (SELECT count(*) FROM vul)""")
def b02(spark, sf_dir):
    s = cut(samples(spark, sf_dir))
    return balance.stratified_or_fallback(s.filter("target = 1"), s.filter("target = 0")).select("id")


@query("b03_fallback", S + " SELECT id FROM (SELECT id FROM samples WHERE target = 0 ORDER BY md5(id || ':42'), id LIMIT 500)")
def b03(spark, sf_dir):
    return balance.fallback(samples(spark, sf_dir).filter("target = 0"), 500).select("id")


@query("b04_shuffled", S + " SELECT id FROM samples")
def b04(spark, sf_dir):
    return balance.shuffled(samples(spark, sf_dir)).select("id")


@query("b05_balance", S + RANGE + PICKED + ", vul AS (SELECT * FROM samples WHERE id IN (SELECT id FROM picked)), safe AS (SELECT * FROM ranged WHERE target = 0), " + matched("vul", "safe", "vul", 20) + " SELECT id, target FROM vul UNION ALL SELECT id, target FROM matched")
def b05(spark, sf_dir):
    return balance.balance(cut(samples(spark, sf_dir)), 40, 100, 20).select("id", "target")


@query("b06_oversampling_plan", S + ", c AS (SELECT count(*) FILTER (WHERE target <> 1) AS safe, count(*) FILTER (WHERE target = 1 AND len(cwe) > 0) AS vulnerable FROM samples) SELECT safe, vulnerable, CAST(floor(safe * 0.6 / 0.4) AS BIGINT) AS wanted, CAST(greatest(0, floor(safe * 0.6 / 0.4) - vulnerable) AS BIGINT) AS draws FROM c")
def b06(spark, sf_dir):
    return balance.oversampling_plan(samples(spark, sf_dir), 0.6)


@query("b06_oversampling_weights", S + ", c AS (SELECT c AS label, count(*) AS n FROM (SELECT unnest(cwe) AS c FROM samples WHERE target = 1) GROUP BY c) SELECT label, n, round((1.0 / n) / sum(1.0 / n) OVER (), 6) AS probability FROM c")
def b06_weights(spark, sf_dir):
    return balance.oversampling_weights(samples(spark, sf_dir))


@query("b06_oversampled_counts", S + ", c AS (SELECT count(*) FILTER (WHERE target <> 1) AS safe, count(*) FILTER (WHERE target = 1 AND len(cwe) > 0) AS v, count(*) FILTER (WHERE target = 1) AS a FROM samples) SELECT 0 AS target, safe AS n FROM c UNION ALL SELECT 1, CAST(a + greatest(0, floor(safe * 0.6 / 0.4) - v) AS BIGINT) FROM c")
def b06_counts(spark, sf_dir):
    return stats.class_counts(balance.oversample(cut(samples(spark, sf_dir)), 0.6))


@query("b07_group_split_disjoint", S + " SELECT count(DISTINCT project) AS projects, count(DISTINCT project) AS assigned, CAST(0 AS BIGINT) AS shared FROM samples")
def b07(spark, sf_dir):
    s = cut(samples(spark, sf_dir))
    rows = split.split_rows(s, split.assign_groups(s, least=1))
    return split.membership(rows).agg(F.count("*").alias("projects"), F.count_if((F.col("in_train") + F.col("in_val") + F.col("in_test")) == 1).alias("assigned"), F.count_if((F.col("in_train") + F.col("in_val") + F.col("in_test")) > 1).alias("shared"))


@query("b08_split_table")
def b08(spark, sf_dir):
    s = cut(samples(spark, sf_dir))
    return split.split_sizes(split.split_rows(s, split.assign_groups(s, least=1)))


@query("b09_stratified_split", S + """, r AS (SELECT id, target, row_number() OVER (PARTITION BY target ORDER BY md5(id || ':42'), id) AS i, count(*) OVER (PARTITION BY target) AS n FROM samples)
    SELECT id, CASE WHEN i <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""")
def b09(spark, sf_dir):
    return balance.stratified_split(samples(spark, sf_dir), "target").select("id", "split")


P = S + ", p AS (SELECT *, CASE WHEN id % 10 < 7 THEN 'train' WHEN id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM samples)"


def parts(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("split", F.when(F.col("id") % 10 < 7, "train").when(F.col("id") % 10 < 9, "val").otherwise("test"))


@query("g09_project_profiles", S + """, c AS (SELECT project, string_agg(label || '=' || n, ',' ORDER BY label) AS counts FROM (SELECT project, label, count(*) AS n FROM (SELECT project, unnest(cwe) AS label FROM samples WHERE target = 1) GROUP BY ALL) GROUP BY project)
    SELECT project, count(*) FILTER (WHERE target = 1) AS vulnerable, count(*) FILTER (WHERE target <> 1) AS clean, max(counts) AS counts FROM samples LEFT JOIN c USING (project) GROUP BY project""")
def g09(spark, sf_dir):
    return split.profiles(samples(spark, sf_dir)).select("project", "vulnerable", "clean", F.array_join(F.transform(F.map_entries("cwe_counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("counts"))


@query("g10_global_counts", S + " SELECT label, count(*) AS n FROM (SELECT unnest(cwe) AS label FROM samples WHERE target = 1) GROUP BY label")
def g10(spark, sf_dir):
    return split.profiles(samples(spark, sf_dir)).select(F.explode("cwe_counts").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n"))


RISK = S + """, g AS (SELECT project, label, count(*) AS n FROM (SELECT project, unnest(cwe) AS label FROM samples WHERE target = 1) GROUP BY ALL),
    e AS (SELECT label, CAST(sum(n) AS BIGINT) AS total, count(*) AS groups, max(n) AS most FROM g GROUP BY label)"""


@query("g11_label_risk", RISK + " SELECT label, total, groups, most, round(most / total, 6) AS concentration, total - most AS guaranteed, CASE WHEN groups = 1 THEN 'CRITICAL' WHEN total - most < 100 THEN 'HIGH' WHEN most / total > 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM e")
def g11(spark, sf_dir):
    return split.label_risk(split.group_labels(samples(spark, sf_dir)), 100)


@query("g12_rare_labels", S + " SELECT label, count(*) AS n FROM (SELECT unnest(cwe) AS label FROM samples) GROUP BY label HAVING count(*) < 400 / 0.8")
def g12(spark, sf_dir):
    return split.rare_labels(labels.frequencies(samples(spark, sf_dir)), 400, 0.8)


@query("g13_coverage_pivot", P + " SELECT label, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test, count(*) AS total, count(*) FILTER (WHERE split = 'train') < 200 AS short FROM (SELECT split, unnest(cwe) AS label FROM p) GROUP BY label")
def g13(spark, sf_dir):
    return split.coverage(parts(spark, sf_dir), least=200)


@query("g14_split_sizes", P + """, z AS (SELECT split, count(DISTINCT project) AS groups, count(*) AS rows FROM p GROUP BY split UNION ALL SELECT 'all', count(DISTINCT project), count(*) FROM p)
    SELECT split, groups, round(groups * 100.0 / (SELECT count(DISTINCT project) FROM p), 4) AS pct_groups, rows, round(rows / groups, 4) AS rows_per_group FROM z""")
def g14(spark, sf_dir):
    return split.split_sizes(parts(spark, sf_dir))


MEMBERS = ", m AS (SELECT project, max(CAST(split = 'train' AS INTEGER)) AS in_train, max(CAST(split = 'val' AS INTEGER)) AS in_val, max(CAST(split = 'test' AS INTEGER)) AS in_test FROM {p} GROUP BY project)"
SPARSE = P + ", q AS (SELECT * FROM p WHERE split = 'train' OR (length(project) % 2 = 0 AND split = 'val') OR (right(project, 1) < '6' AND split = 'test'))"


def sparse(spark, sf_dir):
    return parts(spark, sf_dir).filter("split = 'train' OR (length(project) % 2 = 0 AND split = 'val') OR (right(project, 1) < '6' AND split = 'test')")


@query("g15_leakage", SPARSE + MEMBERS.format(p="q") + " SELECT count(*) FILTER (WHERE in_train + in_val = 2) AS train_val, count(*) FILTER (WHERE in_train + in_test = 2) AS train_test, count(*) FILTER (WHERE in_val + in_test = 2) AS val_test, count(*) FILTER (WHERE in_train + in_val + in_test = 3) AS all_three, count(*) AS \"union\" FROM m")
def g15(spark, sf_dir):
    return split.leakage(sparse(spark, sf_dir))


@query("u06_venn_regions", SPARSE + MEMBERS.format(p="q") + " SELECT in_train, in_val, in_test, count(*) AS n FROM m GROUP BY ALL")
def u06(spark, sf_dir):
    return split.regions(sparse(spark, sf_dir))


@query("j05_split_assignment", S + ", a AS (SELECT DISTINCT project, CASE WHEN right(project, 1) < '5' THEN 'train' ELSE 'test' END AS split FROM samples) SELECT id, split FROM samples JOIN a USING (project)")
def j05(spark, sf_dir):
    s = samples(spark, sf_dir)
    return split.split_rows(s, s.select("project", F.when(F.substring("project", -1, 1) < "5", "train").otherwise("test").alias("split")).distinct()).select("id", "split")


@query("j07_before_after", S + ", a AS (SELECT label, count(*) AS b FROM (SELECT unnest(cwe) AS label FROM samples) GROUP BY label), c AS (SELECT label, count(*) AS n FROM (SELECT unnest(cwe) AS label FROM samples WHERE target = 1 AND len(cwe) < 2) GROUP BY label) SELECT label, coalesce(b, 0) AS before, coalesce(n, 0) AS after, coalesce(n, 0) - coalesce(b, 0) AS change FROM a FULL JOIN c USING (label)")
def j07(spark, sf_dir):
    s = samples(spark, sf_dir)
    return writers.compared(labels.frequencies(s), labels.frequencies(s.filter((F.col("target") == 1) & (F.size("cwe") < 2))))


@query("j10_bin_matched_lookup", S + PARTS + bins_of("vul", "vul", 10, "vb") + ", " + bins_of("safe", "vul", 10, "sb") + " SELECT CAST(cb AS INTEGER) AS complexity_bin, CAST(tb AS INTEGER) AS token_count_bin, v, s FROM (SELECT cb, tb, count(*) AS v FROM vb GROUP BY ALL) JOIN (SELECT cb, tb, count(*) AS s FROM sb GROUP BY ALL) USING (cb, tb)")
def j10(spark, sf_dir):
    s = samples(spark, sf_dir)
    v = s.filter("target = 1")
    names = ["complexity_bin", "token_count_bin"]
    a = balance.with_bins(v, v, ("complexity", "token_count"), 10).groupBy(*names).agg(F.count("*").alias("v"))
    return a.join(balance.with_bins(s.filter("target = 0"), v, ("complexity", "token_count"), 10).groupBy(*names).agg(F.count("*").alias("s")), names)


@query("w07_label_order", S + ", c AS (SELECT c AS label, count(*) AS n FROM (SELECT unnest(cwe) AS c FROM samples) GROUP BY c) SELECT label, n, row_number() OVER (ORDER BY TRY_CAST(regexp_extract(label, '(\\d+)', 1) AS INTEGER) NULLS LAST, label) AS place FROM c")
def w07(spark, sf_dir):
    return labels.frequencies(samples(spark, sf_dir)).withColumn("place", F.row_number().over(Window.orderBy(*labels.label_order(F.col("label")))).cast("long"))


@query("w08_top_bottom", S + ", c AS (SELECT c AS label, count(*) AS n FROM (SELECT unnest(cwe) AS c FROM samples) GROUP BY c) (SELECT label, n, 'top' AS \"end\" FROM c ORDER BY n DESC, label LIMIT 10) UNION ALL (SELECT label, n, 'bottom' FROM c ORDER BY n, label LIMIT 10)")
def w08(spark, sf_dir):
    return stats.bottom_top(labels.frequencies(samples(spark, sf_dir)), 10)


@query("w10_cumulative_sum", S + INEQUALITY.split(", r AS")[0] + " SELECT label, CAST(sum(n) OVER (ORDER BY n, label ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM c")
def w10(spark, sf_dir):
    return labels.frequencies(samples(spark, sf_dir)).select("label", F.sum("n").over(Window.orderBy("n", "label").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))


@query("w11_limit", S + " SELECT id FROM samples ORDER BY id LIMIT 100")
def w11(spark, sf_dir):
    return samples(spark, sf_dir).select("id").orderBy("id").limit(100)


@query("w12_first_vulnerable", S + " SELECT id FROM samples WHERE target = 1 ORDER BY id LIMIT 25")
def w12(spark, sf_dir):
    return vulnerable(spark, sf_dir).select("id").orderBy("id").limit(25)


@query("u01_union_all", S + " SELECT id, target FROM samples WHERE target = 1 UNION ALL SELECT id, target FROM samples WHERE target = 0")
def u01(spark, sf_dir):
    s = samples(spark, sf_dir).select("id", "target")
    return s.filter("target = 1").unionByName(s.filter("target = 0"))


@query("u02_union_distinct", S + " SELECT id FROM samples WHERE target = 1 UNION SELECT id FROM samples WHERE complexity > 4")
def u02(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s.filter("target = 1").select("id").union(s.filter("complexity > 4").select("id")).distinct()


@query("u03_intersect", SPARSE + " SELECT project FROM q WHERE split = 'train' INTERSECT SELECT project FROM q WHERE split = 'val'")
def u03(spark, sf_dir):
    s = sparse(spark, sf_dir)
    return s.filter("split = 'train'").select("project").intersect(s.filter("split = 'val'").select("project"))


@query("u04_except", S + " SELECT c AS label FROM (SELECT unnest(cwe) AS c FROM samples) EXCEPT SELECT c FROM (SELECT unnest(cwe) AS c FROM samples WHERE complexity < 2 AND target = 1)")
def u04(spark, sf_dir):
    s = samples(spark, sf_dir)
    return labels.frequencies(s).select("label").exceptAll(labels.frequencies(s.filter("complexity < 2 AND target = 1")).select("label"))


@query("u05_key_union", S + " SELECT c AS label FROM (SELECT unnest(cwe) AS c FROM samples WHERE target = 1) UNION SELECT c FROM (SELECT unnest(cwe) AS c FROM samples WHERE target = 0)")
def u05(spark, sf_dir):
    s = samples(spark, sf_dir)
    return labels.frequencies(s.filter("target = 1")).select("label").union(labels.frequencies(s.filter("target = 0")).select("label")).distinct()


@query("u08_unique", S + " SELECT count(DISTINCT project) AS projects, count(DISTINCT target) AS targets FROM samples")
def u08(spark, sf_dir):
    return samples(spark, sf_dir).agg(F.countDistinct("project").alias("projects"), F.countDistinct("target").alias("targets"))


for _name, _where, _sql in (("all", "true", "true"), ("vulnerable", "target = 1", "target = 1"), ("safe", "target = 0", "target = 0")):

    @query(f"g26_describe_{_name}", S + f" SELECT count(token_count) AS count, round(avg(token_count), 6) AS mean, round(stddev_samp(token_count), 6) AS std, round(CAST(min(token_count) AS DOUBLE), 6) AS min, round(CAST(max(token_count) AS DOUBLE), 6) AS max, " + ", ".join(f"round(quantile_cont(token_count, {p}), 6) AS p{p * 100:g}" for p in stats.PERCENTILES) + f" FROM samples WHERE {_sql}")
    def g26(spark, sf_dir, where=_where):
        return stats.describe(samples(spark, sf_dir).filter(where), "token_count")


@query("g27_population_stats", S + " SELECT project, count(token_count) AS count, round(avg(token_count), 6) AS mean, round(stddev_pop(token_count), 6) AS std, round(CAST(min(token_count) AS DOUBLE), 6) AS min, round(CAST(max(token_count) AS DOUBLE), 6) AS max, " + ", ".join(f"round(quantile_cont(token_count, {p}), 6) AS p{p * 100:g}" for p in stats.PERCENTILES) + " FROM samples GROUP BY project")
def g27(spark, sf_dir):
    return stats.describe(samples(spark, sf_dir), "token_count", sample=False, by=("project",))


LIMITS = (50000, 100000, 150000, 200000)


@query("g28_over_limits", S + " SELECT k AS \"limit\", round(count(*) FILTER (WHERE token_count > k) * 100.0 / count(*), 4) AS pct FROM samples, (SELECT CAST(unnest([50000, 100000, 150000, 200000]) AS INTEGER) AS k) GROUP BY k")
def g28(spark, sf_dir):
    return stats.over_limits(samples(spark, sf_dir), "token_count", LIMITS)


@query("g29_recommended_lengths", S + " SELECT CAST(ceil(quantile_cont(token_count, 0.95) / 512) * 512 AS BIGINT) AS balanced, CAST(ceil(quantile_cont(token_count, 0.99) / 512) * 512 AS BIGINT) AS conservative, CAST(ceil(max(token_count) / 512) * 512 AS BIGINT) AS \"full\" FROM samples")
def g29(spark, sf_dir):
    return stats.recommended_lengths(samples(spark, sf_dir), "token_count")


@query("g30_correlation", S + " SELECT round(corr(complexity, token_count), 4) AS r, round(corr(complexity, token_count) * corr(complexity, token_count), 4) AS r2, round(regr_slope(token_count, complexity), 4) AS slope, round(regr_intercept(token_count, complexity), 4) AS intercept FROM samples")
def g30(spark, sf_dir):
    return stats.correlation(samples(spark, sf_dir), "complexity", "token_count")


@query("g32_token_summary", S + " SELECT min(token_count) AS min, max(token_count) AS max, round(avg(token_count), 1) AS avg, count(token_count) AS count FROM samples")
def g32(spark, sf_dir):
    return stats.token_summary(samples(spark, sf_dir), "token_count")


@query("g47_violin_stats", S + " SELECT target, count(complexity) AS count, round(avg(complexity), 6) AS mean, round(stddev_samp(complexity), 6) AS std, round(CAST(min(complexity) AS DOUBLE), 6) AS min, round(CAST(max(complexity) AS DOUBLE), 6) AS max, round(quantile_cont(complexity, 0.5), 6) AS p50 FROM samples GROUP BY target")
def g47(spark, sf_dir):
    return stats.describe(samples(spark, sf_dir), "complexity", (0.5,), by=("target",))


@query("w04_ecdf", S + " SELECT id, token_count, round(row_number() OVER (ORDER BY token_count, id) / (SELECT count(*) FROM samples), 6) AS cdf FROM samples")
def w04(spark, sf_dir):
    return stats.ecdf(samples(spark, sf_dir), "token_count", "id")


@query("w06_histogram", S + ", e AS (SELECT CAST(min(token_count) AS DOUBLE) AS lo, CAST(max(token_count) AS DOUBLE) AS hi FROM samples) SELECT CAST(least(49, greatest(0, floor((token_count - lo) / ((hi - lo) / 50)))) AS INTEGER) AS bin, count(*) AS n FROM samples, e GROUP BY 1")
def w06(spark, sf_dir):
    return stats.histogram(samples(spark, sf_dir), "token_count")


@query("w13_percentiles", S + " SELECT CAST(p AS DOUBLE) AS point, round(v, 6) AS value FROM (SELECT unnest({0}) AS p, unnest(quantile_cont(token_count, {0})) AS v FROM samples)".format(list(stats.PERCENTILES[:-1])))
def w13(spark, sf_dir):
    return stats.percentiles(samples(spark, sf_dir), "token_count")
