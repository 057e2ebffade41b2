"""From filtered samples to balanced, split and formatted training data, in stages that are kept on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from quernstone.functions import prompts
from quernstone.operators import balance, filters, split
from quernstone.sources import writers


def staged(path: str, make: Callable[[], DataFrame], spark) -> DataFrame:
    """The table at path, written first if it is not there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    writers.by_split(make(), path)
    return spark.read.parquet(path)


def formatted(df: DataFrame, func: str = "func", mode: str = "free") -> DataFrame:
    """Train and val rows with valid labels, and all test rows, as chat text."""
    kept = df.filter((F.col("split") == "test") | filters.valid_for_training())
    answer = prompts.with_assessment(F.col("reasoning"), F.col("target"), F.col("cwe"), F.col("cwe_desc"))
    return kept.withColumn("text", prompts.chat_text(prompts.as_messages(F.col(func), answer, mode)))


def prepare(df: DataFrame, folder: str, ratio: float = 0.5, test: float = 0.1, val: float = 0.1, least: int = 30, seed: int = 42) -> DataFrame:
    """Splits by project, balances the training part, formats; each stage is reused where it exists."""
    spark = df.sparkSession
    parts = staged(f"{folder}/split", lambda: split.split_rows(df, split.assign_groups(df, test, val, least, seed)), spark)
    even = staged(f"{folder}/balanced", lambda: balance.oversample(parts.filter("split = 'train'"), ratio, seed).unionByName(parts.filter("split <> 'train'")), spark)
    return staged(f"{folder}/formatted", lambda: formatted(even), spark)
