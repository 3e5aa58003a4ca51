"""Sinks: exports and versioned state tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def export_json_lines(df: DataFrame, path: str) -> None:
    """SK1 as lines: one object for each; ``json_export`` writes one array."""
    df.write.mode("overwrite").json(path)


def flat_columns(df: DataFrame) -> list[Column]:
    nested = ("array", "map", "struct")
    return [F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(nested) else F.col(f"`{c}`") for c, t in df.dtypes]


def export_csv(df: DataFrame, path: str) -> None:
    """SK2: with a header; nested values as JSON text."""
    df.select(*flat_columns(df)).write.mode("overwrite").option("header", True).csv(path)


def save_version(df: DataFrame, root: str, version: int, replace: bool = False) -> str:
    """SK7, U2: the next version of a state table; a plan may read the one before.

    ``replace``: a version that is written again takes the place of the first try.
    """
    path = f"{root.rstrip('/')}/v{version:08d}"
    df.write.mode("overwrite" if replace else "errorifexists").parquet(path)
    return path


#: Folders of sessions in one process that name none: application -> folder.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a session in one process may name none; elsewhere a machine's own
    folder would lose files that other executors need.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _OWN.get(context.applicationId)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN[context.applicationId] = tempfile.mkdtemp(prefix="jobstrata-")
    return base.rstrip("/")


def written_once(df: DataFrame, tag: str) -> DataFrame:
    """A table for a step that several others read: written to the shared folder, and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> str | None:
    """The newest version that was written as a whole, of those before a number."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    names = sorted(s.getPath().toString() for s in fs.listStatus(where))
    if before is not None:
        names = [n for n in names if int(n.rsplit("/v", 1)[1]) < before]
    whole = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(n + "/_SUCCESS"))]
    return whole[-1] if whole else None
