"""State tables in buckets, tied together by one manifest (SK7, U2, E9).

The rows of a table lie in buckets by the hash of a key.  A version of the
whole store is one small file, the manifest, which names each bucket's folder
for each table.  A change reads and writes the buckets it touches and names
the others as they were; all tables change at once, when the new manifest is
moved into place.  What a run that broke off has written is named by no
manifest and never read; ``vacuum`` removes it.

    root/manifest/v00000007.json
    root/jobs/v00000007-<attempt>/bucket=12/part-...parquet
    root/history/v00000007/part-...parquet            (logs: one folder a version)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a store; a manifest has at most that many entries for each table.
BUCKETS = 1024


class Files:
    """The few operations on a file system that versions need, by Hadoop's interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def move_into_place(self, text: str, name: str) -> None:
        """Write a file as a whole; it is an error if another writer was first."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self.fs.create(self.path(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # an existing file is an error
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(draft), self.path(name), none)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    """Tables (name -> DDL or schema) that share a key column, under ``root``.

    A root belongs to one writer; a second one that commits the same version fails.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str | StructType], key: str = "site_id", buckets: int = BUCKETS):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.tables = {n: StructType.fromDDL(s) if isinstance(s, str) else s for n, s in tables.items()}
        self.files = Files(spark, root)
        self.buckets = self.manifest().get("buckets", buckets)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("long")), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return [int(n[1:9]) for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json")]

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return {} if version is None else json.loads(self.files.text(f"{self.root}/manifest/v{version:08d}.json"))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def read(self, name: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """A table, or some of its buckets; other buckets' files aren't opened."""
        held = self.manifest(version).get("tables", {}).get(name, {})
        wanted = held if buckets is None else [str(b) for b in buckets if str(b) in held]
        paths = [f"{self.root}/{held[b]}" for b in wanted]
        return self.spark.read.schema(self.tables[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.tables[name])

    def log(self, name: str, schema: str | StructType, version: int | None = None) -> DataFrame:
        """All rows logged up to a version."""
        last = self.version() if version is None else version
        kept = [n for n in self.files.names(f"{self.root}/{name}") if last is not None and int(n[1:9]) <= last]
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{n}" for n in kept]) if kept else self.spark.createDataFrame([], schema)

    def begin(self, version: int) -> Change:
        return Change(self, version)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove what no manifest of the last ``keep`` versions names, and these manifests."""
        versions = sorted(self.versions())
        if not versions:
            return []
        kept = versions[-keep:]
        named = {path.split("/bucket=")[0] for v in kept for held in self.manifest(v)["tables"].values() for path in held.values()}
        gone = [f"manifest/v{v:08d}.json" for v in versions[:-keep]]
        for name in self.tables:
            # folders of later versions may be in the making
            gone += [p for n in self.files.names(f"{self.root}/{name}") if int(n[1:9]) <= versions[-1] and (p := f"{name}/{n}") not in named]
        for p in gone:
            self.files.delete(f"{self.root}/{p}")
        return gone


class Change:
    """One new version in the making; nothing of it is seen before ``commit``."""

    def __init__(self, store: Store, version: int):
        self.store, self.version = store, version
        self.base = store.manifest()
        if self.base and version <= self.base["version"]:
            raise ValueError(f"version {version} is there already")
        self.attempt = uuid.uuid4().hex[:12]
        self.tables = {n: dict(held) for n, held in self.base.get("tables", {}).items()}

    def put(self, name: str, rows: DataFrame, buckets: Iterable[int]) -> None:
        """``rows`` are all rows that these buckets hold from now on."""
        store, folder = self.store, f"{name}/v{self.version:08d}-{self.attempt}"
        shaped = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in store.tables[name]])
        # a rebalance, so that one bucket may take many tasks
        shaped.withColumn("bucket", store.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{store.root}/{folder}")
        made = {n.removeprefix("bucket=") for n in store.files.names(f"{store.root}/{folder}") if n.startswith("bucket=")}
        if stray := made - {str(b) for b in buckets}:
            raise ValueError(f"rows of {name} in buckets that weren't named: {sorted(stray)[:5]}")
        held = self.tables.setdefault(name, {})
        for b in map(str, buckets):
            held.pop(b, None)
            if b in made:
                held[b] = f"{folder}/bucket={b}"

    def add(self, name: str, rows: DataFrame) -> None:
        """Rows of a log; a run that is tried again replaces its own."""
        rows.write.mode("overwrite").parquet(f"{self.store.root}/{name}/v{self.version:08d}")

    def keep(self, rows: DataFrame, tag: str) -> DataFrame:
        """A step that several others read, as a table that goes when the change is committed."""
        path = f"{self.store.root}/_steps/v{self.version:08d}-{self.attempt}/{tag}"
        rows.write.parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def commit(self) -> None:
        store = self.store
        text = json.dumps({"version": self.version, "key": store.key, "buckets": store.buckets, "tables": self.tables}, sort_keys=True)
        store.files.move_into_place(text, f"{store.root}/manifest/v{self.version:08d}.json")
        store.files.delete(f"{store.root}/_steps")
