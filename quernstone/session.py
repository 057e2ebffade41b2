"""Session helpers shared by every operator."""

from __future__ import annotations

import hashlib
import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Bytes of one Arrow batch.
ARROW_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    The archive is written by the driver (below the shared checkpoint folder when that is a file path) and
    fetched by executors through Spark, so workers need no installation and no common path.
    """
    settle(spark)
    context = spark.sparkContext
    if getattr(context, "_quernstone_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(str(path.relative_to(PACKAGE.parent))), path.read_bytes())
    data = buffer.getvalue()
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    base = Path(shared.removeprefix("file://").removeprefix("file:")) if shared.startswith(("file:", "/")) else Path(tempfile.mkdtemp())
    base.mkdir(parents=True, exist_ok=True)
    target = base / f"quernstone-{hashlib.sha1(data).hexdigest()[:12]}.zip"
    if not target.exists():
        target.write_bytes(data)
    context.addPyFile(str(target))
    context._quernstone_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the checkpoint folder that the context was given.

    Only where there is neither and all runs in one process on this machine (local tests) is it a temporary folder; on
    a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if named:
        return named
    if context.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quernstone-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(spark: SparkSession) -> None:
    """Session settings that operators rely on.

    A rule of Spark 4.1 by which a union of equally partitioned inputs claims their partitioning is turned off: once
    adaptive execution has coalesced the inputs differently, groups come out split or the job fails. Batches that go
    to Python are limited by bytes, so that long texts do not make large ones.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below sf_dir."""
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
