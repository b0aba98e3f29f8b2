"""A flow's stored state: Parquet tables dealt into buckets by a hash of their key, and numbered manifests.

A manifest names the folders of every bucket. Writing its successor under the next number publishes all tables at once, and
only one writer can take that number. An update writes the buckets that it changes; the others' folders are named again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a table made from now on. One task rewrites a bucket or a part of it, so large targets want thousands.
BUCKETS = 8
PART = "part__"
#: A table of more rows isn't broadcast: Spark goes by the size of files, and keys take a hundredth of their size there.
BROADCAST_ROWS = 50_000
#: With more keys for each bucket they aren't looked up: all buckets are taken, as hardly any could be spared.
FULL_ROWS = 1_000


def few(rows: int) -> bool:
    return rows <= BROADCAST_ROWS


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table that is known to be one, so that joins and unions with it are left out of plans."""
    return spark.range(0).where("false").select(*(F.lit(None).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema))


def unless_few(df: DataFrame, rows: int) -> DataFrame:
    """A side of joins that is shuffled, not broadcast, if it has many rows."""
    return df if few(rows) else df.hint("merge")


@dataclass
class Manifest:
    """What is published: folders of tables by name, whole or by bucket, the setup of targets, and the last run."""

    version: int = 0
    run: int = 0
    tables: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    parts: dict[str, dict[str, str]] = field(default_factory=dict)
    buckets: dict[str, int] = field(default_factory=dict)
    setup: dict[str, Any] = field(default_factory=dict)

    def paths(self) -> set[str]:
        return {*self.tables.values()}.union(*(p.values() for p in self.parts.values()))

    def names(self) -> list[str]:
        return [*self.tables, *self.parts]

    def remove(self, name: str) -> None:
        for of in (self.tables, self.schemas, self.parts, self.buckets):
            of.pop(name, None)


class Conflict(RuntimeError):
    pass


class FlowState:
    """State under one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._staged: list[str] = []

    def _versions(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.root}/manifest-*.json")) or []
        return sorted(int(f.getPath().getName()[9:-5]) for f in found)

    def _read(self, version: int) -> Manifest:
        stream = self._fs.open(self._path(f"{self.root}/manifest-{version:09d}.json"))
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def load(self) -> Manifest:
        versions = self._versions()
        return self._read(versions[-1]) if versions else Manifest()

    def publish(self, manifest: Manifest) -> None:
        """Rename the manifest to the next number, which fails if another run took it: a conflict. Then clear what is out of use."""
        version = manifest.version + 1
        now = max(self._versions(), default=0)
        if now != manifest.version:
            raise Conflict(f"version {now} was published while version {manifest.version} was being worked on")
        body = json.dumps(asdict(manifest) | {"version": version}, sort_keys=True, indent=1)
        tmp, final = f"{self.root}/.manifest-{uuid.uuid4().hex}", f"{self.root}/manifest-{version:09d}.json"
        out = self._fs.create(self._path(tmp), True)
        out.write(bytearray(body.encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri() if "://" in self.root else self._fs.getUri(), self._conf).rename(self._path(tmp), self._path(final), options)
        except Py4JJavaError as bad:
            if "FileAlreadyExists" not in str(bad.java_exception):
                raise
            self._fs.delete(self._path(tmp), False)
            raise Conflict(f"version {version} was published by another run") from bad
        manifest.version = version
        self._tidy()

    def _tidy(self) -> None:
        """Keep the last two versions, for readers of the one before; delete what only older ones or this run's steps used."""
        versions = self._versions()
        used = set().union(*(self._read(v).paths() for v in versions[-2:]))
        old: set[str] = set()
        for v in versions[:-2]:
            old |= self._read(v).paths()
            self._fs.delete(self._path(f"{self.root}/manifest-{v:09d}.json"), False)
        live = {self._top(p) for p in used}
        for p in old - used:
            self._fs.delete(self._path(p), True)
        for top in {self._top(p) for p in old} | {*self._staged}:
            if top not in live:
                self._fs.delete(self._path(top), True)
        self._staged.clear()

    def _top(self, path: str) -> str:
        return f"{self.root}/tables/" + path[len(self.root) + len("/tables/") :].split("/")[0]

    def _new(self, name: str) -> str:
        path = f"{self.root}/tables/{name}-{uuid.uuid4().hex}"
        self._staged.append(path)
        return path

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table that nothing refers to yet, and read it again."""
        path, seen = self._new(name), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        rows = seen.get.get("n", 0)
        out = unless_few(self.spark.read.schema(df.schema).parquet(path), rows) if rows else no_rows(self.spark, df.schema)
        out._indexflow_path, out._indexflow_rows = path, rows
        return out

    def bucket(self, manifest: Manifest, name: str, by: str) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(manifest.buckets.get(name, self.buckets))).cast("int")

    def numbers(self, manifest: Manifest, name: str, keys: DataFrame, by: str, rows: int = 0) -> set[int]:
        """The buckets of a table in which some keys lie; all if so many ``rows`` of keys are given that none is likely to lack one; none if there is no table."""
        if name not in manifest.schemas:
            return set()
        if rows > FULL_ROWS * (n := manifest.buckets.get(name, self.buckets)):
            return {*range(n)}
        return {r[0] for r in keys.select(self.bucket(manifest, name, by)).distinct().collect()}

    def table(self, manifest: Manifest, name: str, only: set[int] | None = None) -> DataFrame | None:
        """A table, or some buckets of it; None where there is none."""
        if name not in manifest.schemas:
            return None
        schema = T.StructType.fromJson(json.loads(manifest.schemas[name]))
        paths = [manifest.tables[name]] if name in manifest.tables else [p for b, p in manifest.parts[name].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def point(manifest: Manifest, name: str, staged: DataFrame) -> None:
        manifest.tables[name] = staged._indexflow_path
        manifest.schemas[name] = staged.schema.json()

    def replace(self, manifest: Manifest, name: str, rows: DataFrame, by: str, at: set[int] | None = None) -> None:
        """Make ``rows`` the contents of the buckets ``at`` of a table, or of all, dealt by the column ``by``."""
        path = self._new(name)
        if at is None:
            manifest.remove(name)
        n = manifest.buckets.setdefault(name, self.buckets)
        kept = {} if at is None else {b: p for b, p in manifest.parts.get(name, {}).items() if int(b) not in at}
        dealt = rows.withColumn(PART, F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
        dealt.hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(path)
        made = (f.getPath().getName() for f in self._fs.listStatus(self._path(path)))
        manifest.parts[name] = kept | {d.split("=")[1]: f"{path}/{d}" for d in made if d.startswith(f"{PART}=")}
        manifest.schemas[name] = rows.schema.json()

    def rewrite(self, manifest: Manifest, name: str, gone: DataFrame, on: list[str], add: DataFrame, by: str, at: set[int] | None = None) -> None:
        """A table without the rows that match ``gone`` and with those of ``add``. Only the buckets ``at``, by default those with keys of either, are written."""
        if name not in manifest.schemas:
            self.replace(manifest, name, add, by)
            return
        at = self.numbers(manifest, name, gone.select(by).unionByName(add.select(by)), by) if at is None else at
        if at:
            self.replace(manifest, name, self.table(manifest, name, at).join(gone, on, "left_anti").unionByName(add), by, at)

    def sweep(self) -> int:
        """Delete tables that no manifest kept names; not while another run is at work."""
        used = set().union(*(self._read(v).paths() for v in self._versions()))
        live, removed = {self._top(p) for p in used}, 0
        folder = self._path(f"{self.root}/tables")
        for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if f"{self.root}/tables/{f.getPath().getName()}" not in live:
                self._fs.delete(f.getPath(), True)
                removed += 1
        return removed

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)
