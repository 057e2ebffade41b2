"""A built-in suite of small C functions with known weaknesses, and running a model's predictions over it or over any table of code.

A model is a callable from a text to an answer (a JSON response). It is called in tasks, batch by batch; a call that
fails gives its row the error instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.functions import responses
from quernstone.operators import evaluate

#: Weaknesses and their finer kinds; labels that are too wide where a finer one is asked for.
FAMILIES: Mapping[int, Sequence[int]] = {119: (787, 125, 120), 400: (401,), 672: (416, 415)}
WIDE = (119, 20, 703)

DDL = "id string, category string, ambiguity string, expected array<int>, accepted array<int>, code string"
CASES: tuple[tuple[str, str, str, list[int], list[int], str], ...] = (
    ("a01", "mem_write", "unambiguous", [787], [119], "void mark(void) {\n    int slots[4];\n    slots[40] = 1;\n}"),
    ("a02", "mem_write", "unambiguous", [787], [119, 121], "void squares(void) {\n    long sq[6];\n    for (int k = 0; k < 12; k++)\n        sq[k] = (long)k * k;\n}"),
    ("a03", "mem_write", "unambiguous", [120], [119, 787], "void stamp(const char line[96]) {\n    char box[24];\n    memcpy(box, line, 96);\n}"),
    ("b01", "mem_read", "unambiguous", [125], [119], "int last(void) {\n    int v[3] = {7, 8, 9};\n    return v[30];\n}"),
    ("b02", "mem_read", "unambiguous", [125], [119], "int total(void) {\n    short v[8] = {0};\n    int t = 0;\n    for (int k = 0; k != 32; k++)\n        t += v[k];\n    return t;\n}"),
    ("c01", "unbounded_copy", "unambiguous", [120], [119, 787], "void name_it(const char *given) {\n    char own[32];\n    strcpy(own, given);\n    use(own);\n}"),
    ("c02", "unbounded_copy", "unambiguous", [120], [119, 787], "void ask(void) {\n    char answer[80];\n    gets(answer);\n}"),
    ("c03", "unbounded_copy", "unambiguous", [120], [119, 787], 'void title(const char *who) {\n    char text[20];\n    sprintf(text, "Report of %s", who);\n    show(text);\n}'),
    ("d01", "integer_arith", "unambiguous", [190], [], "void *grid(unsigned w, unsigned h) {\n    unsigned bytes = w * h * 4;\n    return malloc(bytes);\n}"),
    ("d02", "integer_arith", "low", [475], [703], "int *row(int n) {\n    int *p = malloc(n * sizeof *p);\n    p[0] = n;\n    return p;\n}"),
    ("d03", "integer_arith", "high", [], [190], "int sum(int a, int b) {\n    return a + b;\n}"),
    ("e01", "ptr_lifetime", "unambiguous", [416], [], "void late_write(void) {\n    int *p = malloc(sizeof *p);\n    free(p);\n    *p = 3;\n}"),
    ("e02", "ptr_lifetime", "unambiguous", [416], [], "int late_read(void) {\n    int *p = calloc(1, sizeof *p);\n    free(p);\n    return *p;\n}"),
    ("e03", "ptr_lifetime", "unambiguous", [415], [], "void twice(char *p) {\n    free(p);\n    done();\n    free(p);\n}"),
    ("e04", "ptr_lifetime", "high", [], [401], "void once(void) {\n    char *p = malloc(16);\n    (void)p;\n}"),
    ("e05", "ptr_lifetime", "unambiguous", [401], [476, 703], "void serve(void) {\n    for (;;) {\n        char *p = malloc(512);\n        handle(p);\n    }\n}"),
    ("e06", "ptr_lifetime", "unambiguous", [401], [476], "void poll_all(void) {\n    while (1) {\n        struct job *j = malloc(sizeof *j);\n        start(j);\n    }\n}"),
    ("f01", "null_access", "low", [476], [400, 703], "void fill(void) {\n    char *p = malloc(1000);\n    p[0] = 0;\n    free(p);\n}"),
    ("f02", "null_access", "unambiguous", [476], [], "int size_of(struct tree *t, int key) {\n    struct node *n = find(t, key);\n    return n->size;\n}"),
    ("g01", "control_benign", "unambiguous", [], [], "void keep(const char *given) {\n    char own[32];\n    strncpy(own, given, sizeof own - 1);\n    own[31] = 0;\n    use(own);\n}"),
    ("g02", "control_benign", "unambiguous", [], [], "int at(const int v[9], int k) {\n    if (k < 0 || k > 8)\n        return -1;\n    return v[k];\n}"),
    ("g03", "control_benign", "unambiguous", [], [], "int ready(void) {\n    int *p = malloc(sizeof *p);\n    if (!p)\n        return -1;\n    *p = 1;\n    free(p);\n    return 0;\n}"),
    ("h01", "ambiguous_context", "moderate", [120], [119, 787], "void put(char *to, const char *from) {\n    while ((*to++ = *from++))\n        ;\n}"),
    ("h02", "ambiguous_context", "moderate", [120], [119, 787], "void load(int fd) {\n    char part[64];\n    read_record(fd, part);\n    use(part);\n}"),
)


def cases(spark: SparkSession, categories: Sequence[str] | None = None) -> DataFrame:
    """(id, category, ambiguity, expected, accepted, code) of the suite, or of some of its categories."""
    return spark.createDataFrame([c for c in CASES if categories is None or c[1] in categories], DDL)


def answered(df: DataFrame, predict: Callable[[str], str], code: str = "code") -> DataFrame:
    """Adds answer and error: what predict gives for each row's code, or why it failed. Null code is not asked about."""

    @F.pandas_udf("answer string, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part:
                try:
                    rows.append((None, "no code") if text is None else (predict(text), None))
                except Exception as failed:  # whatever a model raises belongs to its row
                    rows.append((None, f"{type(failed).__name__}: {failed}"))
            yield pd.DataFrame(rows, columns=["answer", "error"], dtype=object)

    return df.withColumn("__a", run(F.col(code))).select("*", "__a.answer", "__a.error").drop("__a")


def diagnosed(df: DataFrame, predict: Callable[[str], str], families: Mapping[int, Sequence[int]] = FAMILIES, wide: Sequence[int] = WIDE) -> DataFrame:
    """cases() (or rows like them) with predicted labels, evaluate.diagnose()'s columns and error; an answer that cannot be read is an error too."""
    got = responses.with_parsed(answered(df, predict), "answer", "__p")
    got = got.withColumn("error", F.coalesce("error", F.when(F.col("__p.cwe_list").isNull(), "no verdict")))
    got = got.withColumn("predicted", F.coalesce(F.array_compact("__p.cwe_list"), F.array().cast("array<int>"))).drop("__p", "answer")
    return evaluate.diagnose(got, families, wide, error="error")
