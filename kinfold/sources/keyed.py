"""Keyed tables that are rewritten in part: buckets by the hash of a key, versions, and one pointer that makes a version current.

A table's rows lie under <root>/<table>/v=<version>/bucket=<bucket>. A commit writes the buckets that it changes under a
new version and then, in one step, a pointer file that says which version each bucket of each table is of. What was
written before a pointer that never came is not read by anyone and is overwritten by the next commit. So a commit that is lost
half way, or made twice, leaves the same content. There is one writer at a time; readers keep the version they began with.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """Columns of a table (DDL), and those whose hash decides on a row's bucket."""

    schema: str
    key: tuple[str, ...]


@dataclass
class Pointer:
    """The version of each bucket that has rows, by table; how far each source of changes has been committed."""

    version: int = 0
    tables: dict[str, dict[int, int]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


class KeyedStore:
    """Keyed tables under root. The number of buckets is fixed when the first version is written; choose it so that a bucket is some 100 MB."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], buckets: int = 64):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        found = self._read_pointer()
        self.buckets = found[1] if found else buckets

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/pointers")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _read_pointer(self, version: int | None = None) -> tuple[Pointer, int] | None:
        versions = self._versions()
        if not versions:
            return None
        at = versions[-1] if version is None else version
        said = json.loads(self.spark.read.text(f"{self.root}/pointers/{at}.json", wholetext=True).first()[0])
        return Pointer(at, {t: {int(b): v for b, v in x.items()} for t, x in said["tables"].items()}, said["marks"]), said["buckets"]

    def pointer(self) -> Pointer:
        found = self._read_pointer()
        return found[0] if found else Pointer()

    def bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[table].key), F.lit(self.buckets)).cast("int")

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets that rows (with the table's key) belong to: at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket(table)).distinct().collect())

    def read(self, table: str, buckets: list[int] | None = None, at: Pointer | None = None) -> DataFrame:
        """The rows of some or all buckets, as of a pointer; only their files are opened."""
        at, schema = at or self.pointer(), self.tables[table].schema
        live = at.tables.get(table, {})
        paths = [f"{self.root}/{table}/v={live[b]}/bucket={b}" for b in (live if buckets is None else buckets) if b in live]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*sorted(paths))

    def commit(self, changes: dict[str, tuple[DataFrame, list[int]]], source: str = "", mark: int = 0) -> Pointer:
        """Replace the content of some buckets of some tables (all their rows are given), and say how far a source has come.

        Rows are dealt by bucket, and a bucket of very many rows to several files. Other buckets stay as they are.
        """
        now = self.pointer()
        new = Pointer(now.version + 1, {t: dict(x) for t, x in now.tables.items()}, now.marks | {source: mark})
        for table, (rows, buckets) in changes.items():
            path = f"{self.root}/{table}/v={new.version}"
            columns = [f.name for f in self.spark.createDataFrame([], self.tables[table].schema).schema]
            rows.select(*columns, self.bucket(table).alias("bucket")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            written = {int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(self._path(path)) if f.getPath().getName().startswith("bucket=")}
            if stray := written - set(buckets):
                raise ValueError(f"{table}: rows of buckets {sorted(stray)}, which this commit does not replace")
            live = new.tables.setdefault(table, {})
            for b in buckets:
                live.pop(b, None)
            live.update(dict.fromkeys(written, new.version))
        said = {"buckets": self.buckets, "tables": new.tables, "marks": new.marks}
        draft, final = self._path(f"{self.root}/pointers/.draft"), self._path(f"{self.root}/pointers/{new.version}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {new.version} has been committed by another writer")
        return new

    def vacuum(self, keep: int = 2) -> None:
        """Delete what none of the last `keep` versions reads."""
        versions = self._versions()
        used: dict[str, set[int]] = defaultdict(set)
        for v in versions[-keep:]:
            for table, live in self._read_pointer(v)[0].tables.items():
                used[table] |= {(b, at) for b, at in live.items()}
        for table in self.tables:
            top = self._path(f"{self.root}/{table}")
            for folder in self._fs.listStatus(top) if self._fs.exists(top) else []:
                v = int(folder.getPath().getName().removeprefix("v="))
                if v <= versions[-1]:
                    for b in self._fs.listStatus(folder.getPath()):
                        name = b.getPath().getName()
                        if name.startswith("bucket=") and (int(name.split("=")[1]), v) not in used[table]:
                            self._fs.delete(b.getPath(), True)
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/pointers/{v}.json"), False)
