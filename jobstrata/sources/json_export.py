"""SK1: one pretty-printed JSON array of any number of rows.

A data source writer: each task writes its rows as they stand in the array, so
no row passes the driver.  At the end the driver writes the brackets and the
commas between parts as files of a few bytes, whose names put them between the
parts: the files of the folder, in order of their names, are the array byte by
byte.  With ``single`` they are joined to one file, a buffer at a time, which is
what a path that ends in ``.json`` asks for.

What a task writes goes to a folder of its attempt; only a write that succeeds
as a whole moves files to where they are seen, and one that fails removes its own.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import salary_display

BUFFER = 1 << 20
_quoted = json.JSONEncoder(ensure_ascii=False).encode


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Any file system that pyarrow knows; a path without a scheme is a local one."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def _value(x: object) -> str:
    if isinstance(x, (list, dict)):
        return json.dumps(x, ensure_ascii=False, indent=2, default=str).replace("\n", "\n    ")
    return json.dumps(x, ensure_ascii=False, default=lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v))


def _values(column: pa.Array) -> list[str]:
    """The values of a column as they stand in the array; plain types by the column."""
    t = column.type
    if pa.types.is_integer(t):
        return ["null" if x is None else str(x) for x in column.to_pylist()]
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return ["null" if x is None else _quoted(x) for x in column.to_pylist()]
    return [_value(x) for x in column.to_pylist()]


def rows_text(batch: pa.RecordBatch) -> str:
    """The objects of a batch, each as ``row_text`` gives it."""
    if not batch.num_columns:
        return ",\n".join(["  {}"] * batch.num_rows)
    members = ",\n".join(f"    {json.dumps(n, ensure_ascii=False)}: ".replace("{", "{{").replace("}", "}}") + "{}" for n in batch.schema.names)
    return ",\n".join(map(("  {{\n" + members + "\n  }}").format, *map(_values, batch.columns)))


def row_text(names: list[str], row: tuple) -> str:
    """One object of the array, indented as its member."""
    if not names:
        return "  {}"
    return "  {\n" + ",\n".join(f"    {n}: {_value(v)}" for n, v in zip(names, row, strict=True)) + "\n  }"


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str | None  # None: a task without rows


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, single: bool, overwrite: bool):
        self.path, self.single, self.overwrite = path, single, overwrite
        self.draft = f"{path}.{uuid.uuid4().hex}.draft"
        fs, at = file_system(path)
        if not overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound:
            raise ValueError(f"{path} is there already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        fs, folder = file_system(self.draft)
        fs.create_dir(folder, recursive=True)
        name, out, lead = f"{context.partitionId():08d}-{context.taskAttemptId()}", None, ""
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                out = out or fs.open_output_stream(f"{folder}/{name}")
                out.write((lead + rows_text(batch)).encode())
                lead = ",\n"
        finally:
            if out is not None:
                out.close()
        return Written(context.partitionId(), name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.draft)
        _, target = file_system(self.path)
        parts = [m.name for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.part)]
        if self.overwrite:
            self._remove(fs, target)
        if self.single:
            with fs.open_output_stream(f"{folder}/joined") as out:
                out.write(b"[\n" if parts else b"[")
                for k, name in enumerate(parts):
                    out.write(b",\n" if k else b"")
                    with fs.open_input_stream(f"{folder}/{name}") as one:
                        while chunk := one.read(BUFFER):
                            out.write(chunk)
                out.write(b"\n]" if parts else b"]")
            fs.move(f"{folder}/joined", target)
            fs.delete_dir(folder)
            return
        fs.create_dir(f"{folder}/all", recursive=True)
        for k, name in enumerate(parts):
            self._small(fs, f"{folder}/all/{k:08d}-a", b",\n" if k else b"[\n")
            fs.move(f"{folder}/{name}", f"{folder}/all/{k:08d}-b.json")
        self._small(fs, f"{folder}/all/{len(parts):08d}-z", b"\n]" if parts else b"[]")
        fs.move(f"{folder}/all", target)
        fs.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(*file_system(self.draft))

    @staticmethod
    def _small(fs: pafs.FileSystem, name: str, data: bytes) -> None:
        with fs.open_output_stream(name) as out:
            out.write(data)

    @staticmethod
    def _remove(fs: pafs.FileSystem, at: str) -> None:
        kind = fs.get_file_info(at).type
        if kind == pafs.FileType.Directory:
            fs.delete_dir(at)
        elif kind == pafs.FileType.File:
            fs.delete_file(at)


class JsonArray(DataSource):
    """``df.write.format("json_array").save(path)``; rows keep the order of the table."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        path = self.options["path"]
        single = self.options.get("single", str(path.endswith(".json"))).lower() == "true"
        return _Writer(path, single, overwrite)


def export_json(jobs: DataFrame, path: str, overwrite: bool = True, single: bool | None = None) -> None:
    """SK1: jobs as one JSON array, each with ``salary_display`` at its end.

    The order of the array is that of the rows, so sort before if one is wanted.
    """
    spark: SparkSession = jobs.sparkSession
    spark.dataSource.register(JsonArray)
    if {"salary_from", "salary_to", "salary_currency"} <= set(jobs.columns):
        jobs = jobs.withColumn("salary_display", salary_display(F.col("salary_from"), F.col("salary_to"), F.col("salary_currency")))
    writer = jobs.write.format("json_array").mode("overwrite" if overwrite else "append")
    if single is not None:
        writer = writer.option("single", str(single).lower())
    writer.save(path)
