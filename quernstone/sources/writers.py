"""Writers: JSON lines, CSV, routed and partitioned tables, small reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Bytes that joined() copies at a time.
COPY_BYTES = 1 << 20


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists", single: bool = False, refuse_empty: bool = False) -> None:
    """JSON lines; single asks for one file, refuse_empty raises on a table without rows."""
    if refuse_empty and df.isEmpty():
        raise ValueError("no rows to write")
    if single:
        joined(df, path, mode)
    else:
        df.write.mode(mode).json(path)


def joined(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in one file: parts are written by all tasks, then the driver joins them in order, COPY_BYTES at a time.

    The rows are seen under path once the whole file is there.
    """
    jvm = df.sparkSession._jvm
    hadoop, conf = jvm.org.apache.hadoop, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    folder = hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    if fs.exists(folder) and mode.lower() not in ("append", "overwrite"):
        if mode.lower() == "ignore":
            return
        df.limit(0).write.mode(mode).json(path)  # raises
    parts = hadoop.fs.Path(folder, f"_parts-{uuid.uuid4().hex}")
    try:
        df.write.json(parts.toString())
        files = sorted((f.getPath() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-")), key=lambda p: (int(p.getName().split("-")[1]), p.getName()))
        whole = hadoop.fs.Path(parts, "_whole")
        out = fs.create(whole)
        try:
            for f in files:
                source = fs.open(f)
                try:
                    hadoop.io.IOUtils.copyBytes(source, out, COPY_BYTES, False)
                finally:
                    source.close()
        finally:
            out.close()
        if mode.lower() == "overwrite":
            for f in fs.listStatus(folder):
                if f.getPath().getName() != parts.getName():
                    fs.delete(f.getPath(), True)
        if not fs.rename(whole, hadoop.fs.Path(folder, files[0].getName() if files else "part-00000.json")):
            raise OSError(f"the joined file cannot be moved into {path}")
        fs.create(hadoop.fs.Path(folder, "_SUCCESS"), True).close()
    finally:
        fs.delete(parts, True)


def label_counts_csv(counts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CWE_ID, Count, Description, the most frequent first, all text quoted."""
    out = counts.select(F.col("label").alias("CWE_ID"), F.col("n").alias("Count"), F.coalesce("description", F.lit("")).alias("Description"))
    out.orderBy(F.desc("Count"), "CWE_ID").coalesce(1).write.mode(mode).option("header", True).option("quoteAll", True).csv(path)


def routed(df: DataFrame, path: str, decision: str = "decision", mode: str = "errorifexists") -> None:
    """One pass over df into a folder for each decision."""
    df.write.mode(mode).partitionBy(decision).json(path)


def by_split(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(split).parquet(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def stats_json(small: DataFrame, indent: int = 2) -> str:
    """JSON text of a small aggregate."""
    return json.dumps([r.asDict(recursive=True) for r in small.collect()], indent=indent, default=str, ensure_ascii=False)


def compared(before: DataFrame, after: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """(label, before, after, change): counts over the union of labels."""
    a, b = before.select(label, F.col(n).alias("before")), after.select(label, F.col(n).alias("after"))
    return a.join(b, label, "full").select(label, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")).withColumn("change", F.col("after") - F.col("before"))


def request_lines(df: DataFrame, request: Column) -> DataFrame:
    """One text column of request lines, as write.text wants it."""
    return df.select(request.alias("value"))


def markdown(small: DataFrame, title: str = "") -> str:
    """Markdown table of a small aggregate."""
    rows = [[str(v) for v in r] for r in small.collect()]
    lines = [f"## {title}", ""] if title else []
    return "\n".join([*lines, "| " + " | ".join(small.columns) + " |", "|" + " --- |" * len(small.columns), *("| " + " | ".join(r) + " |" for r in rows)])


def latex(small: DataFrame, caption: str = "") -> str:
    """LaTeX table of a small aggregate."""
    safe = lambda x: str(x).replace("&", r"\&").replace("%", r"\%").replace("_", r"\_")
    rows = [" & ".join(map(safe, r)) + r" \\" for r in small.collect()]
    head = " & ".join(map(safe, small.columns)) + r" \\"
    return "\n".join([r"\begin{table}", r"\begin{tabular}{" + "l" * len(small.columns) + "}", head, r"\hline", *rows, r"\end{tabular}", rf"\caption{{{safe(caption)}}}", r"\end{table}"])


def yaml_documents(documents: Sequence[Mapping[str, object]]) -> str:
    """Flat mappings as YAML documents; texts of several lines as literal blocks."""

    def value(v: object) -> str:
        if isinstance(v, str) and "\n" in v:
            return "|-\n" + "\n".join("  " + x for x in v.split("\n"))
        return json.dumps(v, ensure_ascii=False, default=str)

    return "".join("---\n" + "".join(f"{k}: {value(v)}\n" for k, v in d.items()) for d in documents)
