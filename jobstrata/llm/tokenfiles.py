"""Token counts of flat token files by a separator scan.

A token file is a run of 16-bit identifiers, the texts one after the other,
each closed by an end identifier, and nothing else: no header, no index.  Each
task writes one such file, under a name of its attempt, and gives the names of
its texts in their order as a table; a file that an attempt left which didn't
succeed is in no table and never read.

Files are read in blocks of a fixed number of identifiers, cut without regard
to texts, so one file may take many tasks.  A block is searched for the end
identifier on its own; a prefix scan over the blocks of a file (how many
separators came before, where the last one stood) stitches texts that cross
block borders.

The folder may lie in any file system that pyarrow knows, shared by all
executors.

Defined results: null text counts as empty and has 0 tokens; an empty table
has no files; identifiers after a file's last separator belong to no text;
repeated rows are counted each; a vocabulary that 16 bits can't hold, or that
holds the end identifier, is an error.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import load_ranks, text_encoder
from .common import doc_rows, n_parts, release, shared_dir, slabs, staged, table

#: Identifiers of a block, and bytes that a task holds before it writes them.
BLOCK, BUFFER = 1 << 20, 1 << 20
END = 50256

NAMES = "file string, ordinal long, doc_id long"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def write_files(docs: DataFrame, path: str, rank_path: str, pattern: str, end_id: int = END) -> DataFrame:
    """One flat token file for each partition with rows; gives file, ordinal and doc_id of each text."""

    def run(batches):
        release("bpe")
        mark = np.array([end_id], "<u2").tobytes()
        fs, folder = file_system(path)
        name, out, hold, size, ordinal = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.u16", None, [], 0, 0
        for b in batches:
            for s in slabs(b):
                enc = text_encoder(rank_path, pattern)
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/{name}")
                for i in range(len(s)):
                    hold += [np.frombuffer(enc.packed(str(s.raw(i), "utf-8")), "<u4").astype("<u2").tobytes(), mark]
                    size += len(hold[-2]) + 2
                    if size >= BUFFER:
                        out.write(b"".join(hold))
                        hold, size = [], 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(s)), pa.array(np.arange(ordinal, ordinal + len(s))), pa.array(s.ids, pa.int64())], names=["file", "ordinal", "doc_id"]
                )
                ordinal += len(s)
        if out is not None:
            out.write(b"".join(hold))
            out.close()

    if end_id > 0xFFFF or any(rank > 0xFFFF or rank == end_id for rank in load_ranks(rank_path).values()):
        raise ValueError("token files hold 16-bit identifiers, none of them the end identifier")
    return staged(docs.mapInArrow(run, NAMES), "tokennames")


def blocks(files: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """file, block, at and bytes of the pieces of files (file), by their sizes."""

    def run(batches):
        fs, folder = file_system(path)
        for b in batches:
            for name in b.column("file").to_pylist():
                size = fs.get_file_info(f"{folder}/{name}").size
                at = np.arange(0, size, 2 * block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(np.arange(len(at))), pa.array(at), pa.array(np.minimum(size - at, 2 * block))], names=["file", "block", "at", "bytes"]
                )

    return files.mapInArrow(run, "file string, block long, at long, bytes long")


def separators(names: DataFrame, path: str, end_id: int = END, block: int = BLOCK) -> DataFrame:
    """file, ordinal, start and n_tokens of each text in the files that ``names`` names."""

    def run(batches):
        fs, folder = file_system(path)
        for b in batches:
            for name, number, at, size in zip(*(b.column(c).to_pylist() for c in ("file", "block", "at", "bytes")), strict=True):
                with fs.open_input_file(f"{folder}/{name}") as f:
                    ends = np.flatnonzero(np.frombuffer(f.read_at(size, at), "<u2") == end_id) + at // 2
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number]), pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "ends"])

    pieces = blocks(names.select("file").distinct(), path, block).repartition(n_parts(names.sparkSession), "file", "block")
    found = pieces.mapInArrow(run, "file string, block long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select(
        "file", "ends", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("done"), F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1)).alias("last")
    )
    start = F.expr("if(k = 0, last, ends[k - 1]) + 1")
    return (
        found.select("file", "done", "last", "ends", F.posexplode("ends").alias("k", "end"))
        .select("file", (F.col("done") + F.col("k")).cast("long").alias("ordinal"), start.cast("long").alias("start"), (F.col("end") - start).cast("long").alias("n_tokens"))
    )


def token_counts(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, file and start of each text, by way of token files in the shared folder."""
    spark: SparkSession = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    names = write_files(doc_rows(docs, id_col, text_col), path, rank_path, pattern)
    # both sides grow with the texts, though as files they look small enough to broadcast
    return names.join(separators(names, path, block=block).hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "start")


def op5_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
