"""Helpers shared by the training-data operators.

All scans work on Arrow batches.  A batch is walked in *slabs* of a bounded
number of text bytes, so that the numpy temporaries of one worker stay small
whatever the batch holds; only a single text longer than the slab makes a
larger one.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLAB_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session that runs in one process may do without: it gets a folder
    of its own.  Elsewhere a machine's own folder would lose tables.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = _OWN.get(spark.sparkContext.applicationId)
    if base is None:
        base = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="jobstrata-")
    return base


#: Folders made for sessions in one process: application -> folder.
_OWN: dict[str, str] = {}


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    The shuffle files that only the written plan needed are released.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


#: What this worker process keeps between tasks: name -> how to let go of it.
HELD: dict[str, Callable[[], None]] = {}


def release(but: str = "") -> None:
    """Let go of what other operators have left in this worker process."""
    for name, drop in HELD.items():
        if name != but:
            drop()
    trim()


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes of an Arrow batch: both sides hold a batch as a whole.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, unless the session asks for sizes of its own (other
    than Spark's defaults).  Plans read these settings when they run, so they stay set.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size) == "67108864b":
        spark.conf.set(size, str(BATCH_BYTES))


def doc_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text), under these names, whatever else the table holds."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


class Slab:
    """Texts of some rows as one flat byte array.

    data: uint8, all texts one after the other; offs: int64, n + 1 borders;
    ids: list of ids (None where null).
    """

    __slots__ = ("data", "offs", "ids")

    def __init__(self, data: np.ndarray, offs: np.ndarray, ids: list):
        self.data, self.offs, self.ids = data, offs, ids

    def __len__(self) -> int:
        return len(self.offs) - 1

    def raw(self, i: int) -> memoryview:
        return memoryview(self.data)[self.offs[i] : self.offs[i + 1]]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, o, d = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(o, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slabs(batch: pa.RecordBatch, limit: int = SLAB_BYTES) -> Iterator[Slab]:
    """Cut a (doc_id, text) batch into slabs of about ``limit`` bytes."""
    data, offs = flat(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    i, n = 0, len(ids)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Slab(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ids[i:j])
        i = j


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def map_slabs(df: DataFrame, f: Callable[[Slab], dict | None], schema: str, limit: int = SLAB_BYTES, holds: str = "") -> DataFrame:
    """``f`` turns a slab into a dict of columns (in the schema's order)."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches):
        release(holds)
        for b in batches:
            for s in slabs(b, limit):
                out = f(s)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) if not isinstance(out[x.name], pa.Array) else out[x.name] for x in arrow], schema=arrow)
        trim()  # an idle worker keeps its process

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def binary_column(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())


# --- hashing -----------------------------------------------------------------

#: Odd multiplier of the polynomial hash modulo 2^64 and its inverse.
_B = 0x9E3779B97F4A7C15 | 1
_BI = pow(_B, -1, 1 << 64)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    while len(_POW) < n:
        m = len(_POW)
        with np.errstate(over="ignore"):
            _POW = np.concatenate([_POW, _POW * np.uint64(pow(_B, m, 1 << 64))])
            _INV = np.concatenate([_INV, _INV * np.uint64(pow(_BI, m, 1 << 64))])
    return _POW[:n], _INV[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], the same for the same bytes."""
    n = len(data)
    power, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * power[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def class_table(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars if isinstance(chars, bytes) else chars.encode("latin-1"))] = True
    return out


#: Bytes of words for ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_SPACE = ~class_table(b" \t\n\x0b\x0c\r")
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def runs(flags: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a text's border.

    Returns starts, ends and, for each text and one past the last, the index
    of its first run.
    """
    n = len(flags)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    prev = np.zeros(n, bool)
    prev[1:] = flags[:-1]
    starts = np.flatnonzero(flags & (~prev | edge[:n]))
    nxt = np.zeros(n, bool)
    nxt[:-1] = flags[1:]
    ends = np.flatnonzero(flags & (~nxt | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def char_starts(data: np.ndarray) -> np.ndarray:
    """cum[i]: code points that begin before byte i."""
    cum = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=cum[1:])
    return cum
