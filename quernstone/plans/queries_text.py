"""Queries over texts, messages and model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import ccode, prompts, responses, scalars, tokens
from quernstone.operators import baseline_ml, filters
from quernstone.plans.registry import query
from quernstone.plans.standins import DESCRIBED, PREDICTIONS, SAMPLES, TEXTS, described, predictions, samples, texts
from quernstone.session import table

S = "WITH " + SAMPLES
T = "WITH " + TEXTS
D = "WITH " + DESCRIBED
PHRASES = ("the of", "licensed under", "all rights reserved")
LEAK = "(" + " OR ".join(f"contains(lower(reasoning), '{p}')" for p in PHRASES) + ")"


@query("f07_contaminated", T + f" SELECT id FROM texts WHERE {LEAK}")
def f07(spark, sf_dir):
    return filters.split_contaminated(texts(spark, sf_dir), phrases=PHRASES)[1].select("id")


@query("f07_clean", T + f" SELECT id FROM texts WHERE NOT {LEAK}")
def f07_clean(spark, sf_dir):
    return filters.split_contaminated(texts(spark, sf_dir), phrases=PHRASES)[0].select("id")


@query("g44_contamination_summary", T + f" SELECT count(*) AS total, count(*) FILTER (WHERE {LEAK}) AS contaminated, count(*) FILTER (WHERE NOT {LEAK} AND target = 1) AS clean_vulnerable, count(*) FILTER (WHERE NOT {LEAK} AND target = 0) AS clean_safe, round(count(*) FILTER (WHERE {LEAK}) * 100.0 / count(*), 4) AS contaminated_pct FROM texts")
def g44(spark, sf_dir):
    return filters.contamination_summary(texts(spark, sf_dir), phrases=PHRASES)


@query("f08_unsubstantiated", S + " SELECT id FROM samples WHERE complexity < 5")
def f08(spark, sf_dir):
    verdict = F.struct((F.col("target") == 1).alias("is_vulnerable"), F.when(F.col("complexity") >= 5, F.col("cwe")).alias("unsubstantiated_cwes"))
    return filters.drop_unsubstantiated(samples(spark, sf_dir).withColumn("verdict", verdict)).select("id")


@query("f21_reasoned_safe_rows", T + " SELECT id FROM texts WHERE target <> 1 AND reasoning <> ''")
def f21(spark, sf_dir):
    return texts(spark, sf_dir).filter("target <> 1 AND reasoning <> ''").select("id")


@query("f24_truncated", T + " SELECT id, substr(reasoning, 1, 200) AS head FROM texts")
def f24(spark, sf_dir):
    return texts(spark, sf_dir).select("id", filters.head_text(F.col("reasoning"), 200).alias("head"))


@query("f25_with_response", T + " SELECT id, length(reasoning) AS chars, target = 1 AS is_vulnerable FROM texts")
def f25(spark, sf_dir):
    got = texts(spark, sf_dir).withColumns({"verdict": F.struct((F.col("target") == 1).alias("is_vulnerable")), "chars": F.length("reasoning").cast("long")})
    return got.select("id", "chars", "verdict.is_vulnerable")


@query("f02_cpp_signs", "WITH c AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'class A : public B {' WHEN 1 THEN 'x = new int;' WHEN 2 THEN 'std::string s;' WHEN 3 THEN 'int main() { return 0; }' WHEN 4 THEN 'template <T> f' ELSE text END AS code FROM documents) SELECT doc_id, regexp_matches(code, '\\b(try|catch|throw|new|delete)\\b') OR doc_id % 6 IN (0, 1, 2, 4) OR regexp_matches(code, '\\b\\w+::\\w+') AS cpp FROM c")
def f02(spark, sf_dir):
    kind = F.col("doc_id") % 6
    code = F.when(kind == 0, "class A : public B {").when(kind == 1, "x = new int;").when(kind == 2, "std::string s;").when(kind == 3, "int main() { return 0; }").when(kind == 4, "template <T> f").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", ccode.looks_cpp(code).alias("cpp"))


@query("x01_ascii_only", "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS clean FROM documents")
def x01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.ascii_only(F.col("text")).alias("clean"))


def made(spark, sf_dir, *forms):
    """(doc_id, func): the forms in turn, {n} being the document's number."""
    n = F.col("doc_id")
    turn = F.element_at(F.array(*map(F.lit, forms)), (n % len(forms) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(turn, F.lit("{n}"), n.cast("string")).alias("func"))


def made_sql(*results: str | None) -> str:
    """The results of made() in turn, as SQL."""
    quote = lambda x: "replace('" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "', '{n}', CAST(doc_id AS VARCHAR))"
    return f"CASE doc_id % {len(results)} " + " ".join(f"WHEN {i} THEN {'NULL' if r is None else quote(r)}" for i, r in enumerate(results)) + " END"


def code(spark, sf_dir):
    """Functions made from documents' numbers: some open, some with comments and directives, some that are none."""
    n = F.col("doc_id")
    parts = [
        F.concat(F.lit("int f"), n.cast("string"), F.lit("(int a) {")), F.when(n % 2 == 0, "\n/* note { */ // x"), F.when(n % 3 == 0, "\n#ifdef A"), F.lit("\n  if (a > 1 && a < 9) { a++; }"),
        F.when(n % 5 == 0, '\n  while (a) { a--; puts("}}"); }'), F.lit("\n  return a ? 1 : 0;"), F.when(n % 4 != 0, "\n}"),
    ]
    whole = F.concat(*(F.coalesce(p, F.lit("")) for p in parts))
    kind = n % 11
    text = F.when(kind == 7, F.concat(F.lit("int f"), n.cast("string"), F.lit("(void) { a(); } }"))).when(kind == 8, F.concat(F.lit("#error no\n"), whole)).when(kind == 9, "// nothing else").when(kind == 10, F.concat(F.lit("int a"), n.cast("string"), F.lit(";"))).otherwise(whole)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("func"))


STATUS = "CASE doc_id % 11 WHEN 7 THEN 'unbalanced' WHEN 8 THEN 'preprocessor' WHEN 9 THEN 'empty' WHEN 10 THEN 'no_function' ELSE 'ok' END"
#: What is left of the functions of code(): of those whose conditional holds nothing, the head.
CLEAN = """CASE WHEN doc_id % 11 >= 7 THEN NULL WHEN doc_id % 3 = 0 THEN 'int f' || doc_id || '(int a) {' || chr(10) || '}'
    ELSE 'int f' || doc_id || '(int a) {' || chr(10) || '  if (a > 1 && a < 9) { a++; }' || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '  while (a) { a--; puts("}}"); }' ELSE '' END || chr(10) || '  return a ? 1 : 0;' || chr(10) || '}' END"""


@query("x11_complexity_and_status", f"SELECT doc_id, {STATUS} AS status, CASE WHEN doc_id % 11 < 7 THEN CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 4 + CAST(doc_id % 5 = 0 AS INTEGER) END AS INTEGER) END AS cyclomatic_complexity FROM documents")
def x11(spark, sf_dir):
    return ccode.clean(code(spark, sf_dir)).select("doc_id", "status", "cyclomatic_complexity")


@query("g04_processing_counters", f"SELECT {STATUS} AS status, count(*) AS n FROM documents GROUP BY 1")
def g04(spark, sf_dir):
    return ccode.clean(code(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query("f01_early_filter", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 11 < 7")
def f01(spark, sf_dir):
    got = code(spark, sf_dir).withColumn("func", F.when(F.col("doc_id") % 2 == 0, F.col("func")).otherwise("// only a comment"))
    return ccode.clean(got.filter(~ccode.looks_cpp(F.col("func")))).filter("status = 'ok'").select("doc_id")


@query("x02_x10_clean_functions", f"SELECT doc_id, {CLEAN} AS clean, {STATUS} AS status FROM documents")
def x10(spark, sf_dir):
    return ccode.clean(code(spark, sf_dir)).select("doc_id", "clean", "status")


@query("e01_step_callback", f"SELECT doc_id, upper({CLEAN}) AS clean FROM documents WHERE doc_id % 11 < 7")
def e01(spark, sf_dir):
    return ccode.clean(code(spark, sf_dir), step=str.upper).filter("status = 'ok'").select("doc_id", "clean")


KEPT = "int f{n}(int a) { return a; }"


@query("x03_function_bodies", "SELECT doc_id, " + made_sql(KEPT, "static " + KEPT, None, KEPT, KEPT) + " AS body FROM documents")
def x03(spark, sf_dir):
    got = made(spark, sf_dir, "} ; " + KEPT, "#if K == {n}\nstatic " + KEPT, "int g{n} = 3;", KEPT, "/* x */\n" + KEPT)
    return got.select("doc_id", ccode.applied(ccode.body, F.col("func")).alias("body"))


@query("x04_closed_directives", "SELECT doc_id, 'int f(void) {' || chr(10) || repeat('#if A' || chr(10), doc_id % 3) || '  a();' || chr(10) || repeat('#endif' || chr(10), doc_id % 2) || '}' || repeat(chr(10) || '#endif', greatest(0, doc_id % 3 - doc_id % 2)) AS closed FROM documents")
def x04(spark, sf_dir):
    n = F.col("doc_id")
    func = F.concat(F.lit("int f(void) {\n"), F.repeat(F.lit("#if A\n"), (n % 3).cast("int")), F.lit("  a();\n"), F.repeat(F.lit("#endif\n"), (n % 2).cast("int")), F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", ccode.applied(ccode.with_closed_directives, func).alias("closed"))


@query("x05_closed_braces", """SELECT doc_id, rtrim('int f(void) {' || repeat(' if (a) {', doc_id % 3) || ' puts("{}}"); /* { */ ' || repeat('}', doc_id % 2)) || repeat(chr(10) || '}', greatest(0, 1 + doc_id % 3 - doc_id % 2)) AS closed FROM documents""")
def x05(spark, sf_dir):
    n = F.col("doc_id")
    func = F.concat(F.lit("int f(void) {"), F.repeat(F.lit(" if (a) {"), (n % 3).cast("int")), F.lit(' puts("{}}"); /* { */ '), F.repeat(F.lit("}"), (n % 2).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", ccode.applied(ccode.with_closed_braces, func).alias("closed"))


UNTYPED = ("f{n}(int a) { return a; }", "glue(f{n}, NAME)(int *a, int b) { *a = b; }", "glue(f{n}, NAME) { a(); }", "static f{n}(void) { }")
TYPED = ("char *f{n}(p) char *p; { return p; }", "int a{n} = 10;", "f{n}(a);")


@query("x06_return_types", "SELECT doc_id, " + made_sql(*("int " + x for x in UNTYPED[:3]), "static int f{n}(void) { }", *TYPED) + " AS typed FROM documents")
def x06(spark, sf_dir):
    return made(spark, sf_dir, *UNTYPED, *TYPED).select("doc_id", ccode.applied(ccode.with_return_type, F.col("func")).alias("typed"))


MACROS = "#define N {n}\n#define TWICE(x) ((x) + (x))\n"


@query("x07_preprocessed", "SELECT doc_id, " + made_sql("int f(void) { return (({n}) + ({n})); }", "int g{n};", None, "int h(void) { return {n}; }") + " AS code FROM documents")
def x07(spark, sf_dir):
    got = made(spark, sf_dir, MACROS + "int f(void) { return TWICE(N); }", MACROS + "#if N < 0 || defined(B)\nint f;\n#elif N % 4 == 1\nint g{n};\n#else\nint h;\n#endif", "#ifdef A\nint f{n};", "#undef N\n" + MACROS + "#if 0\n#if 1\nint g;\n#endif\n#else\n\nint h(void) { return N; }\n#endif")
    return got.select("doc_id", ccode.applied(ccode.preprocess, F.col("func")).alias("code"))


@query("x08_format_status")
def x08(spark, sf_dir):
    got = made(spark, sf_dir, KEPT)
    return got.select("doc_id", ccode.applied(lambda c: ccode.format_code(c)[1], F.col("func")).alias("status"))


@query("x09_without_dangling_directives", "SELECT doc_id, " + made_sql("int a;\nint b{n};", "#if A\nint a{n};\n#else\nint b;\n#endif", "int a;\nint c;", "int a{n};", "int a;\n#if B\nint b{n};\n#endif\nint c;") + " AS code FROM documents")
def x09(spark, sf_dir):
    got = made(spark, sf_dir, "int a;\n#endif\nint b{n};", "#if A\nint a{n};\n#else\nint b;\n#endif", "int a;\n#else\nint b{n};\n#endif\nint c;", "#elif B\nint a{n};", "int a;\n#else\n#if B\nint b{n};\n#endif\nint c;\n#endif")
    return got.select("doc_id", ccode.applied(ccode.without_dangling_directives, F.col("func")).alias("code"))


@query("x12_is_function", "SELECT doc_id, doc_id % 5 IN (0, 3) AS is_function FROM documents")
def x12(spark, sf_dir):
    got = made(spark, sf_dir, KEPT, "int f{n}(int a);", "struct s{n} { int a; };", "#define A\nint *f{n}(void)\n{\n}", "int a[] = { {n} };")
    return got.select("doc_id", ccode.applied(ccode.is_function, F.col("func"), "boolean").alias("is_function"))


@query("x13_pre_token_counts", T + " SELECT id, CAST(len(regexp_extract_all(reasoning, '[A-Za-z0-9_]+|[^\\s\\x0BA-Za-z0-9_]')) AS INTEGER) AS tokens FROM texts")
def x13(spark, sf_dir):
    return texts(spark, sf_dir).select("id", tokens.pre_token_count(F.col("reasoning")).alias("tokens"))


@query("x13_bpe_counts")
def x13_bpe(spark, sf_dir):
    return texts(spark, sf_dir).select("id", tokens.bpe_count()(F.col("reasoning")).alias("tokens"))


@query("x14_component_bpe_counts")
def x14(spark, sf_dir):
    c = tokens.component_counts(F.lit("Check this:"), F.concat(F.lit(" "), "reasoning"), F.lit(" Done."), tokens.bpe_count())
    return texts(spark, sf_dir).select("id", c.alias("c")).select("id", "c.*")


@query("x15_component_counts", T + " SELECT id, CAST(len(regexp_extract_all(reasoning, '[A-Za-z0-9_]+|[^\\s\\x0BA-Za-z0-9_]')) AS INTEGER) AS \"user\", 3 AS system, 2 AS assistant FROM texts")
def x15(spark, sf_dir):
    c = tokens.component_counts(F.lit("Check this: "), F.concat("reasoning", F.lit(" ")), F.lit("Done."))
    return texts(spark, sf_dir).select("id", c.alias("c")).select("id", "c.user", "c.system", "c.assistant")


@query("x16_duration", "SELECT doc_id, printf('%02d:%02d:%02d', CAST(floor(n_chars / 3600) AS BIGINT), CAST(floor(n_chars % 3600 / 60) AS BIGINT), n_chars % 60) AS duration FROM documents")
def x16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.duration(F.col("n_chars")).alias("duration"))


@query("x20_clip", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, value / 50)) END AS clipped FROM events")
def x20(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", responses.clip(F.when(F.col("event_id") % 4 != 0, F.col("value") / 50).cast("string")).alias("clipped"))


@query("x21_json_block", "SELECT event_id, props AS json FROM events")
def x21(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", responses.json_block(F.concat(F.lit("Answer:\n"), "props", F.lit("\nend"))).alias("json"))


@query("x22_parse_judgement", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0.5 ELSE CASE WHEN k / 50 > 1 THEN 1.0 ELSE k / 50 END END AS quality_score, CASE event_id % 3 WHEN 0 THEN 0.3 ELSE 0.5 END AS confidence, event_id % 3 = 0 AS parse_error,
    CASE event_id % 3 WHEN 0 THEN 'Failed to parse response' WHEN 1 THEN 'ok' ELSE 'No justification provided' END AS justification FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""")
def x22(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.lit("no { json")).when(kind == 1, F.concat(F.lit('Here: {\n "quality_score": '), (k / 50).cast("string"), F.lit(', // note\n "justification": "ok"\n}'))).otherwise(F.concat(F.lit('{"quality_score": "'), (k / 50).cast("string"), F.lit('"}')))
    return table(spark, sf_dir, "events").select("event_id", responses.parse_judgement(text).alias("j")).select("event_id", "j.quality_score", "j.confidence", "j.parse_error", "j.justification")


def answers(spark, sf_dir):
    """Model answers by number of event: of eight kinds, with reasons, labels and descriptions that follow the number."""
    n = F.col("event_id")
    kind, label = n % 8, n * 7 % 10100
    reason = F.repeat(F.when(kind == 6, F.lit(" ")).otherwise(F.lit("x")), (n % 97).cast("int"))
    quoted = F.when(kind == 4, F.concat(F.lit('"'), label.cast("string"), F.lit('"'))).otherwise(label.cast("string"))
    listed = F.when(n % 3 == 0, (label + 1).cast("string")).when(n % 2 == 0, F.concat_ws(", ", label.cast("string"), label.cast("string"))).otherwise(label.cast("string"))
    one = F.concat(F.lit('{"cwe_id": '), quoted, F.lit(', "description": "'), F.repeat(F.lit("d"), (n % 13).cast("int")), F.lit('"}'))
    verdict = F.when(kind == 7, (n % 2 == 0).cast("string")).when(kind == 4, F.when(n % 5 == 0, '"no"').otherwise('"yes"')).otherwise((n % 5 != 0).cast("string"))
    whole = F.concat(
        F.when(kind == 5, "Sure: ").otherwise(""), F.lit('{"reasoning": "'), reason, F.lit('", "vulnerabilities": ['), F.when(kind == 7, "").otherwise(one), F.lit('], "verdict": {"is_vulnerable": '), verdict,
        F.lit(', "cwe_list": ['), F.when(kind == 7, "").otherwise(listed), F.lit("]}}"), F.when(kind == 5, "\nDone.").otherwise(""),
    )
    text = F.when(kind == 0, F.repeat(F.lit(" "), (n % 5).cast("int"))).when(kind == 1, F.concat(F.lit("I cannot say, case "), n.cast("string"))).when(kind == 2, F.concat(F.lit('{"reasoning": '), n.cast("string"), F.lit(', "verdict"}'))).otherwise(whole)
    return table(spark, sf_dir, "events").select("event_id", text.alias("answer"))


def outcome(reasoning: int, description: int) -> str:
    """The outcome of answers() in SQL."""
    return f"""CASE event_id % 8 WHEN 0 THEN 'empty_response' WHEN 1 THEN 'missing_verdict' WHEN 2 THEN 'invalid_json' ELSE
        CASE WHEN (event_id % 8 = 6 OR event_id % 97 = 0) AND event_id % 97 >= {reasoning} THEN 'empty_reasoning'
             WHEN event_id % 97 < {reasoning} OR (event_id % 8 <> 7 AND (event_id * 7 % 10100 NOT BETWEEN 1 AND 9999 OR event_id % 13 < {description})) THEN 'validation_error'
             WHEN CASE WHEN event_id % 8 = 7 THEN event_id % 2 = 0 ELSE event_id % 3 = 0 END THEN 'mismatch' ELSE 'success' END END"""


OUTCOME = outcome(50, 1)


@query("x24_response_validation", f"SELECT event_id, {OUTCOME} AS outcome FROM events")
def x24(spark, sf_dir):
    return responses.with_error(answers(spark, sf_dir), "answer").select("event_id", F.coalesce("error", F.lit("success")).alias("outcome"))


@query("x25_generation_validation", f"SELECT event_id, {outcome(0, 10)} AS outcome FROM events")
def x25(spark, sf_dir):
    return responses.with_error(answers(spark, sf_dir), "answer", 0, 10).select("event_id", F.coalesce("error", F.lit("success")).alias("outcome"))


@query("x23_parsed_samples", f"""SELECT event_id, CASE WHEN event_id % 8 <> 7 THEN CAST(event_id * 7 % 10100 AS INTEGER) END AS cwe_id, CASE WHEN event_id % 8 = 7 THEN event_id % 2 = 0 ELSE event_id % 5 <> 0 END AS is_vulnerable, CAST(event_id % 97 AS INTEGER) AS chars
    FROM events WHERE {OUTCOME} = 'success'""")
def x23(spark, sf_dir):
    got = responses.with_error(answers(spark, sf_dir), "answer").filter("error IS NULL")
    return got.select("event_id", F.get("parsed.vulnerabilities", 0)["cwe_id"].alias("cwe_id"), "parsed.is_vulnerable", F.length("parsed.reasoning").alias("chars"))


@query("g41_parser_stats", f"SELECT {OUTCOME} AS outcome, count(*) AS n FROM events GROUP BY 1")
def g41(spark, sf_dir):
    return responses.parser_stats(answers(spark, sf_dir), "answer")


def results(spark, sf_dir):
    a = answers(spark, sf_dir)
    content = F.struct(F.struct(F.array(F.struct(F.struct(F.col("answer").alias("content")).alias("message"))).alias("choices")).alias("body"))
    kind = F.col("event_id") % 10
    line = F.when(kind == 0, F.to_json(F.struct(F.col("event_id").cast("string").alias("custom_id"), F.lit("timeout").alias("error")))).when(kind == 1, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("custom_id"), content.alias("response"))))
    return responses.batch_results(a.select(line.alias("value")))


RESULT = f"CASE event_id % 10 WHEN 0 THEN 'request_error' WHEN 1 THEN 'bad_line' ELSE nullif({OUTCOME}, 'success') END"


@query("s13_batch_results", f"SELECT CASE WHEN event_id % 10 <> 1 THEN CAST(event_id AS VARCHAR) END AS custom_id, {RESULT} AS error FROM events")
def s13(spark, sf_dir):
    return results(spark, sf_dir).select("custom_id", "error")


@query("g42_batch_statistics", f"SELECT coalesce({RESULT}, 'ok') AS status, count(*) AS n FROM events GROUP BY 1")
def g42(spark, sf_dir):
    return results(spark, sf_dir).groupBy(F.coalesce("error", F.lit("ok")).alias("status")).agg(F.count("*").alias("n"))


@query("x26_reasoning_with_json", D + " SELECT id, CASE WHEN target = 1 THEN 'true' ELSE 'false' END AS verdict, CAST(len(cwe) AS INTEGER) AS labels FROM described")
def x26(spark, sf_dir):
    d = described(spark, sf_dir)
    text = prompts.with_assessment(F.lit("Because. "), F.col("target"), F.col("cwe"), F.col("cwe_desc"))
    block = F.regexp_extract(text, r"(?s)```json\n(.*)\n```$", 1)
    r = F.from_json(block, "vulnerabilities array<struct<cwe_id int, description string>>, verdict struct<is_vulnerable boolean, cwe_list array<int>>")
    return d.select("id", r["verdict"]["is_vulnerable"].cast("string").alias("verdict"), F.size(r["verdict"]["cwe_list"]).alias("labels"))


@query("x27_chat_text", T + " SELECT id, '<|im_start|>system' || chr(10) || 'You review C functions for weaknesses.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Review this function:' || chr(10) || reasoning || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || 'ok<|im_end|>' || chr(10) AS head FROM texts")
def x27(spark, sf_dir):
    return texts(spark, sf_dir).select("id", prompts.chat_text(prompts.as_messages(F.col("reasoning"), F.lit("ok"))).alias("head"))


@query("x28_messages", T + " SELECT id, CAST(CASE WHEN target = 1 THEN 3 ELSE 2 END AS INTEGER) AS n, CASE WHEN target = 1 THEN 'assistant' ELSE 'user' END AS last_role FROM texts")
def x28(spark, sf_dir):
    m = prompts.as_messages(F.col("reasoning"), F.when(F.col("target") == 1, F.lit("yes")))
    return texts(spark, sf_dir).select("id", F.size(m).alias("n"), F.element_at(m, -1)["role"].alias("last_role"))


@query("x29_x30_prompts_by_mode", T + " SELECT id, 'Review this function:' || chr(10) || substr(reasoning, 1, 50) || chr(10) || 'Remember to distrust callers.' AS prompt FROM texts")
def x29(spark, sf_dir):
    return texts(spark, sf_dir).select("id", prompts.user_prompt(F.substring("reasoning", 1, 50), "pessimistic", "inference").alias("prompt"))


BULLETS = "list_transform(generate_series(1, len(cwe)), lambda i: '- ' || cwe[i] || ': ' || cwe_desc[i])"


@query("x31_known_outcome", D + f" SELECT id, CASE WHEN target <> 1 THEN 'The function is SAFE.' WHEN len(cwe) > 0 THEN 'The function is VULNERABLE. Its weaknesses:' || chr(10) || array_to_string({BULLETS}, chr(10)) ELSE 'The function is VULNERABLE. Its weaknesses are not given.' END AS outcome FROM described")
def x31(spark, sf_dir):
    return described(spark, sf_dir).select("id", prompts.known_outcome(F.col("target"), F.col("cwe"), F.col("cwe_desc")).alias("outcome"))


@query("x32_x33_judge_prompt", D + f" SELECT id, '## project' || chr(10) || project || chr(10) || chr(10) || '## weaknesses' || chr(10) || CASE WHEN target = 1 THEN array_to_string({BULLETS}, chr(10)) ELSE 'None' END AS prompt FROM described")
def x33(spark, sf_dir):
    info = prompts.judge_info(F.col("target"), F.col("cwe"), F.col("cwe_desc"))
    return described(spark, sf_dir).select("id", prompts.judge_prompt({"project": F.col("project"), "weaknesses": info}).alias("prompt"))


@query("x34_delimiters", "SELECT 'a' AS model, '[INST]' AS user_mark UNION ALL SELECT 'deepseek-x', '### Instruction:' UNION ALL SELECT 'q', '<|im_start|>user'")
def x34(spark, sf_dir):
    rows = [("a", "..[INST].."), ("deepseek-x", ""), ("q", "<|im_start|>")]
    return spark.createDataFrame([(m, prompts.delimiters(m, t)[0]) for m, t in rows], "model string, user_mark string")


@query("x35_weight_mask", """WITH i AS (SELECT event_id, [1, 2, CAST(event_id % 5 AS INTEGER), 7, 8, CAST(event_id % 3 AS INTEGER)] AS ids, CAST(event_id % 4 AS INTEGER) AS skip FROM events)
    SELECT event_id, array_to_string(list_transform(generate_series(1, 6), lambda k: CASE WHEN k <= skip THEN '0.0' WHEN k >= 4 THEN '1.5' ELSE '1.0' END), ',') AS weights FROM i""")
def x35(spark, sf_dir):
    number = lambda k: (F.col("event_id") % k).cast("int")
    ids = F.array(F.lit(1), F.lit(2), number(5), F.lit(7), F.lit(8), number(3))
    loss = F.transform(ids, lambda x, i: F.when(i < number(4), -100).otherwise(x))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(scalars.weight_mask(ids, loss, (7, 8)), lambda x: x.cast("string")), ",").alias("weights"))


@query("x36_weighted_mean", "SELECT vec_id, round(list_sum(list_transform(generate_series(1, len(embedding)), lambda i: CAST(embedding[i] AS DOUBLE) * i)) / (len(embedding) * (len(embedding) + 1) / 2), 6) AS mean FROM embeddings")
def x36(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scalars.weighted_mean(F.col("embedding"), F.transform("embedding", lambda x, i: (i + 1).cast("double"))), 6).alias("mean"))


@query("x37_training_steps", "WITH n AS (SELECT source, count(*) * 100 AS rows FROM documents GROUP BY source) SELECT source, CAST(rows // 32 AS BIGINT) AS steps_per_epoch, CAST(rows // 32 * 3 AS BIGINT) AS total_steps, CAST(floor(rows // 32 * 3 * 0.1) AS BIGINT) AS warmup_steps, CAST(greatest(rows // 32 // 4, 50) AS BIGINT) AS eval_steps FROM n")
def x37(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg((F.count("*") * 100).alias("rows"))
    return n.select("source", scalars.training_steps(F.col("rows"), 8, 4, 3, 0.1).alias("s")).select("source", "s.*")


@query("x43_formatting", "SELECT source, format('{:,}', sum(n_chars)) AS chars FROM documents GROUP BY source")
def x43(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(scalars.thousands(F.sum("n_chars")).alias("chars"))


@query("j09_pair_distances", "SELECT vec_id, round(sqrt(pow(CAST(embedding[1] AS DOUBLE) - embedding[3], 2) + pow(CAST(embedding[2] AS DOUBLE) - embedding[4], 2)), 5) AS gap FROM embeddings")
def j09(spark, sf_dir):
    v = lambda i: F.array(F.element_at("embedding", i).cast("double"), F.element_at("embedding", i + 1).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.element_at(scalars.pair_distances(F.array(v(1), v(3))), 1), 5).alias("gap"))


@query("m01_word_counts", "SELECT word, count(*) AS n, count(DISTINCT doc_id) AS rows FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_]+')) AS word FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS text FROM documents)) GROUP BY word")
def m01(spark, sf_dir):
    plain = table(spark, sf_dir, "documents").select(F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("text"))
    return baseline_ml.word_counts(plain, "text")


@query("m04_m05_encoded_labels", S + ", e AS (SELECT id, unnest(cwe) AS label FROM samples WHERE target = 1), k AS (SELECT * FROM e WHERE label IN (SELECT label FROM e GROUP BY label HAVING count(*) > 60)) SELECT id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_index FROM k")
def m04(spark, sf_dir):
    rows = filters.repeated_labels(samples(spark, sf_dir).filter("target = 1"), more_than=60).select("id", "label")
    return baseline_ml.encode_labels(rows)


@query("m02_g46_forest_predictions")
def m02(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", "quality")
    return baseline_ml.evaluate(d, "text", "quality", "doc_id", trees=10, depth=5, vocabulary=2000)


@query("f25_prediction_json", "WITH " + PREDICTIONS + " SELECT id, '{\"cwes\":[' || array_to_string(list_sort(pred_cwes), ',') || ']}' AS json FROM predictions")
def prediction_text(spark, sf_dir):
    return predictions(spark, sf_dir).select("id", F.to_json(F.struct(F.array_sort("pred_cwes").alias("cwes"))).alias("json"))


@query("b10_training_pipeline")
def b10(spark, sf_dir):
    from quernstone.plans.queries_data import scratch
    from quernstone.plans.training import prepare

    rows = described(spark, sf_dir).withColumns({"func": F.concat(F.lit("int f"), F.col("id").cast("string"), F.lit("(void);")), "reasoning": F.lit("Because of the labels.")})
    done = prepare(rows, scratch(spark, "training"), least=1)
    return done.groupBy("split", "target").agg(F.count("*").alias("n"), F.min(F.length("text")).alias("shortest"))
