"""Sources: keyed tables whose rows have an ordinal, listed before they are read."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Any, Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexflow.sources.globs import matches
from indexflow.types import FieldType, basic, from_spark, require_key, table


class Source(Protocol):
    """What a flow reads. ``listing`` has the key columns and __ordinal; ``read`` adds the other fields for some keys."""

    def fields(self, spark: SparkSession) -> FieldType: ...

    def listing(self, spark: SparkSession) -> DataFrame: ...

    def read(self, spark: SparkSession, keys: DataFrame | None = None) -> DataFrame: ...


#: Folders listed on the driver at most to find subfolders to deal out, and bytes of contents in one batch.
EXPANDED, BATCH_BYTES = 64, 8 << 20
LISTED = "filename string, __ordinal long"


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    uri = root if "://" in root or root.startswith("file:") else f"file://{root}" if root.startswith("/") else None
    if uri is None:
        import os

        uri = f"file://{os.path.abspath(root)}"
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class FileSource:
    """Files below a root, hidden ones too: key filename, relative to the root; ordinal the change time in microseconds.

    Folders are listed and contents fetched by executors, through the file system that ``connect`` opens there (by default that of the
    root's URI, with credentials from the environment). Only wanted files are opened. A file that is gone by then has no
    row. Text is UTF-8 in which what is malformed becomes U+FFFD.
    """

    root: str
    binary: bool = False
    included_patterns: list[str] | None = None
    excluded_patterns: list[str] | None = None
    prefix: str = ""
    prune: bool = True
    watch: bool = False
    connect: Callable[[], tuple[fs.FileSystem, str]] | None = field(default=None, compare=False, repr=False)

    def fields(self, spark: SparkSession) -> FieldType:
        return table("KTable", filename=basic("Str"), content=basic("Bytes" if self.binary else "Str"))

    def _connect(self) -> Callable[[], tuple[fs.FileSystem, str]]:
        root = self.root
        return self.connect or (lambda: open_root(root))

    def listing(self, spark: SparkSession) -> DataFrame:
        """Folders near the root are dealt out to tasks, which walk all that is below them."""
        connect = self._connect()
        system, top = connect()
        deep, flat, todo = [], [], [self.prefix.rpartition("/")[0]]
        while todo and len(flat) < EXPANDED:
            here = todo.pop(0)
            flat.append(here)
            todo += [f"{here}/{f.base_name}".lstrip("/") for f in system.get_file_info(fs.FileSelector(f"{top.rstrip('/')}/{here}".rstrip("/") or "/", allow_not_found=True)) if f.type == fs.FileType.Directory]
        deep = todo

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, base = connect()
            base = base.rstrip("/")
            for batch in batches:
                for folder, below in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    stack = [folder]
                    while stack:
                        here = stack.pop()
                        found = own.get_file_info(fs.FileSelector(f"{base}/{here}".rstrip("/") or "/", allow_not_found=True))
                        name = lambda f, here=here: f"{here}/{f.base_name}".lstrip("/")
                        files = [f for f in found if f.type == fs.FileType.File]
                        stack += [name(f) for f in found if below and f.type == fs.FileType.Directory]
                        yield pa.RecordBatch.from_arrays([pa.array([name(f) for f in files], pa.string()), pa.array([None if f.mtime_ns is None else f.mtime_ns // 1000 for f in files], pa.int64())], ["filename", "__ordinal"])

        folders = spark.createDataFrame([(x, False) for x in flat] + [(x, True) for x in deep], "folder string, below boolean")
        found = folders.repartition(max(1, min(len(flat) + len(deep), spark.sparkContext.defaultParallelism))).mapInArrow(walk, LISTED)
        keep = matches(F.col("filename"), self.included_patterns, self.excluded_patterns, prune=self.prune)
        return found.where(keep & F.col("filename").startswith(self.prefix) if self.prefix else keep)

    def change_stream(self, spark: SparkSession) -> DataFrame | None:
        """New files as they come, for sources to watch; removed and hidden ones are seen by the next listing only."""
        if not self.watch:
            return None
        return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(self.root).select("path")

    def read(self, spark: SparkSession, keys: DataFrame | None = None) -> DataFrame:
        connect = self._connect()

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, base = connect()
            made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.binary(), pa.int64()), strict=True)], ["filename", "content", "__ordinal"])
            for batch in batches:
                rows, size = [], 0
                for name in batch.column(0).to_pylist():
                    path = f"{base.rstrip('/')}/{name}"
                    info = own.get_file_info(path)
                    if info.type != fs.FileType.File:
                        continue
                    try:
                        with own.open_input_stream(path, compression=None) as f:
                            body = f.read()
                    except FileNotFoundError:
                        continue
                    rows.append((name, body, None if info.mtime_ns is None else info.mtime_ns // 1000))
                    size += len(body)
                    if size >= BATCH_BYTES:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

        names = (self.listing(spark) if keys is None else keys).select("filename").repartition(4 * spark.sparkContext.defaultParallelism, "filename")
        files = names.mapInArrow(fetch, "filename string, content binary, __ordinal long")
        content = F.col("content") if self.binary else F.make_valid_utf8(F.col("content").cast("string"))
        return files.select("filename", content.alias("content"), "__ordinal")


def LocalFile(path: str, binary: bool = False, included_patterns: list[str] | None = None, excluded_patterns: list[str] | None = None) -> FileSource:  # noqa: N802
    return FileSource(path, binary, included_patterns, excluded_patterns)


def AmazonS3(bucket_name: str, prefix: str | None = None, binary: bool = False, included_patterns: list[str] | None = None, excluded_patterns: list[str] | None = None, **options: Any) -> FileSource:  # noqa: N802
    """Objects of a bucket; keys are whole object keys. ``options`` are those of pyarrow's S3 file system; credentials come from the environment otherwise."""
    return FileSource(f"s3://{bucket_name}", binary, included_patterns, excluded_patterns, prefix or "", prune=False, connect=lambda: (fs.S3FileSystem(**options), bucket_name))


def AzureBlob(account_name: str, container_name: str, prefix: str | None = None, binary: bool = False, included_patterns: list[str] | None = None, excluded_patterns: list[str] | None = None, account_key: str | None = None, sas_token: str | None = None) -> FileSource:  # noqa: N802
    """Blobs of a container, by an account key or a shared-access token, or else by credentials from the environment."""
    secrets = {k: v for k, v in (("account_key", account_key), ("sas_token", sas_token)) if v}
    return FileSource(f"abfs://{container_name}@{account_name}", binary, included_patterns, excluded_patterns, prefix or "", prune=False, connect=lambda: (fs.AzureFileSystem(account_name=account_name, **secrets), container_name))


#: Of more wanted rows the range of keys isn't looked for, which takes a join of its own and seldom skips anything then.
RANGE_ROWS = 50_000


@dataclass(frozen=True)
class TableSource:
    """Any DataFrame, or a Parquet path, with key columns and maybe an ordinal column."""

    data: DataFrame | str = field(compare=False)
    key: tuple[str, ...] | str = "id"
    ordinal: str | None = None

    @property
    def keys(self) -> list[str]:
        return [self.key] if isinstance(self.key, str) else list(self.key)

    def _df(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.data) if isinstance(self.data, str) else self.data

    def _ordinal(self) -> Any:
        return (F.col(self.ordinal) if self.ordinal else F.lit(None)).cast("long").alias("__ordinal")

    def fields(self, spark: SparkSession) -> FieldType:
        df = self._df(spark)
        own = [(f.name, from_spark(f.dataType, f.nullable and f.name not in self.keys, f.metadata)) for f in df.schema]
        own = [x for k in self.keys for x in own if x[0] == k] + [x for x in own if x[0] not in self.keys and x[0] != self.ordinal]
        for name, t in own[: len(self.keys)]:
            require_key(t, name)
        return FieldType("KTable", fields=tuple(own))

    def listing(self, spark: SparkSession) -> DataFrame:
        return self._df(spark).select(*self.keys, self._ordinal())

    def read(self, spark: SparkSession, keys: DataFrame | None = None) -> DataFrame:
        df = self._df(spark)
        if keys is not None:
            few = getattr(keys, "_indexflow_rows", 0) <= RANGE_ROWS
            keys = keys.select(*self.keys)
            if few and len(self.keys) == 1 and df.schema[self.keys[0]].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "date", "timestamp"):
                # what the scan can skip by its statistics
                low, high = keys.agg(F.min(self.keys[0]), F.max(self.keys[0])).first()
                df = df.where(F.col(f"`{self.keys[0]}`").between(F.lit(low), F.lit(high)) if low is not None else F.lit(False))
            df = df.join(keys, self.keys, "left_semi")
        return df.select(*(n for n, _ in self.fields(spark).fields), self._ordinal())

    def scan(self, spark: SparkSession) -> DataFrame:
        """All rows that some keys could ask for, for many keys: a join with them would deal out the whole table once more."""
        return self.read(spark).where(reduce(and_, (F.col(f"`{k}`").isNotNull() for k in self.keys)))


def micros(at: datetime.datetime) -> int:
    """A time as an ordinal."""
    return int(at.timestamp() * 1_000_000)
