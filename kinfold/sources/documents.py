"""Stored documents as a data source: <root>/<SHA-256 of the person>/<row key>.json, read and written by tasks.

A filter on person_id opens that person's folder alone. A file's size is known before it is read: one over the cap is not,
but stands as a corrupt row. A scan has such rows (their error says why); read_one(), a look-up, raises.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

FORMAT = "kinfold_documents"
CAP = 1_048_576
SCHEMA = "person_id string, row_key string, folder string, size long, raw string, error string"
_ARROW = pa.schema([("person_id", pa.string()), ("row_key", pa.string()), ("folder", pa.string()), ("size", pa.int64()), ("raw", pa.string()), ("error", pa.string())])


def folder_of(person_id: str) -> str:
    return hashlib.sha256(person_id.encode()).hexdigest()


def _open(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.FileSystem.from_uri("file://" + root.removeprefix("file:")))


@dataclass
class Folders(InputPartition):
    """Folders that one task lists and reads."""

    names: list[str] = field(default_factory=list)


class Reader(DataSourceReader):
    """Options: path; cap, in bytes; folders_per_task; folder, the only one to read, with documents of unknown people as well."""

    def __init__(self, options):
        self.root, self.cap, self.per_task = options["path"].rstrip("/"), int(options.get("cap", CAP)), int(options.get("folders_per_task", 1_000))
        self.folders: list[str] | None = [options["folder"]] if "folder" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with people becomes a choice of folders. Spark applies the filter all the same: a folder may hold a misfiled document."""
        for f in filters:
            people = [f.value] if isinstance(f, EqualTo) and f.attribute == ("person_id",) else list(f.value) if isinstance(f, In) and f.attribute == ("person_id",) else None
            if people is not None:
                named = {folder_of(p) for p in people if isinstance(p, str)}
                self.folders = sorted(named if self.folders is None else named & set(self.folders))
            yield f

    def partitions(self) -> list[InputPartition]:
        """Names of folders are all that the driver sees."""
        names = self.folders
        if names is None:
            system, path = _open(self.root)
            found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
            names = sorted(i.base_name for i in found if i.type == fs.FileType.Directory)
        return [Folders(names[k : k + self.per_task]) for k in range(0, len(names), self.per_task)] or [Folders()]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        system, path = _open(self.root)
        rows, held = [], 0
        for folder in partition.names:
            for info in sorted(system.get_file_info(fs.FileSelector(f"{path}/{folder}", allow_not_found=True)), key=lambda i: i.base_name):
                if info.type == fs.FileType.File and info.extension == "json":
                    rows.append(self._row(system, folder, info))
                    held += len(rows[-1]["raw"] or "")
                    if held > 1 << 24 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _row(self, system: fs.FileSystem, folder: str, info: fs.FileInfo) -> dict:
        row = {"person_id": None, "row_key": unquote(info.base_name.removesuffix(".json")), "folder": folder, "size": info.size, "raw": None, "error": None}
        if info.size > self.cap:
            return row | {"error": "too_large"}
        with system.open_input_stream(info.path) as f:
            data = f.read()
        try:
            raw = data.decode()
        except UnicodeDecodeError:
            return row | {"error": "not_text"}
        try:
            said = json.loads(raw)
        except ValueError:
            return row | {"raw": raw, "error": "not_json"}
        person = said.get("personId") if isinstance(said, dict) else None
        if not isinstance(person, str):
            return row | {"raw": raw, "error": "no_person"}
        return row | {"raw": raw, "person_id": person, "error": None if folder_of(person) == folder else "misfiled"}


@dataclass
class Written(WriterCommitMessage):
    files: int


class Writer(DataSourceArrowWriter):
    """Writes person_id, row_key, raw. A file is there whole or not at all, and a task that runs again overwrites what it wrote."""

    def __init__(self, options):
        self.root = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _open(self.root)
        made, n = set(), 0
        for batch in iterator:
            for r in batch.select(["person_id", "row_key", "raw"]).to_pylist():
                folder = f"{path}/{folder_of(r['person_id'])}"
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(r["raw"].encode())
                system.move(draft, f"{folder}/{quote(r['row_key'], safe='')}.json")
                n += 1
        return Written(n)


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options)


def read(spark: SparkSession, root: str, **options) -> DataFrame:
    """SCHEMA of all documents under root, of the people alone that a filter on person_id names. error is null for sound ones."""
    spark.dataSource.register(Documents)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(root)


def write(rows: DataFrame, root: str) -> None:
    """Write person_id, row_key, raw (no nulls) as documents; one of a name that is there is replaced."""
    rows.sparkSession.dataSource.register(Documents)
    full = rows.select("person_id", "row_key", F.lit("").alias("folder"), F.lit(0).cast("long").alias("size"), "raw", F.lit(None).cast("string").alias("error"))
    full.write.format(FORMAT).mode("append").save(root)


class CorruptDocument(ValueError):
    """A document that was asked for by name is there but cannot be read."""


def read_one(spark: SparkSession, root: str, person_id: str, row_key: str) -> str | None:
    """A document's text; None if there is none. A corrupt or misfiled one raises."""
    folder = folder_of(person_id)
    row = read(spark, root, folder=folder).where(F.col("row_key") == row_key).first()
    if row is None:
        return None
    if row.error:
        raise CorruptDocument(f"{folder}/{row_key}: {row.error}")
    return row.raw

