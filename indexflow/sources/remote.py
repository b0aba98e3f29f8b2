"""Sources behind services: a file drive, and change notices of an object store from a queue.

The services' clients are passed in; nothing here opens a connection by itself.
"""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexflow.types import FieldType, basic, table

FOLDER = "application/vnd.google-apps.folder"
NATIVE = "application/vnd.google-apps."
#: Fixed export formats of native documents: for text, for bytes.
EXPORTS = {
    "document": ("text/markdown", "application/pdf"),
    "spreadsheet": ("text/csv", "application/pdf"),
    "presentation": ("text/plain", "application/pdf"),
    "drawing": ("image/svg+xml", "image/png"),
    "script": ("application/vnd.google-apps.script+json", "application/vnd.google-apps.script+json"),
}


class DriveClient(Protocol):
    def children(self, folder_id: str) -> Iterable[dict[str, Any]]: ...  # id, name, mimeType, modified (microseconds), trashed

    def content(self, file_id: str, export: str | None) -> bytes: ...

    def recent(self, since: int) -> Iterable[dict[str, Any]]: ...  # as children, with parents


@dataclass(frozen=True)
class GoogleDrive:
    """Files below root folders: key file_id; folders and trashed files are left out, an id found twice counts once."""

    client: Callable[[], DriveClient] = field(compare=False)
    root_folder_ids: tuple[str, ...]
    binary: bool = False

    def fields(self, spark: SparkSession) -> FieldType:
        return table("KTable", file_id=basic("Str"), filename=basic("Str"), mime_type=basic("Str"), content=basic("Bytes" if self.binary else "Str"))

    def export(self, mime: str) -> tuple[bool, str | None]:
        """Whether a type can be read, and the format to export it to."""
        if not mime.startswith(NATIVE):
            return True, None
        formats = EXPORTS.get(mime.removeprefix(NATIVE))
        return formats is not None, formats and formats[self.binary]

    def walk(self) -> Iterator[dict[str, Any]]:
        client, todo, seen = self.client(), list(self.root_folder_ids), set(self.root_folder_ids)
        while todo:
            for f in client.children(todo.pop()):
                if f.get("trashed") or f["id"] in seen:
                    continue
                seen.add(f["id"])
                if f["mimeType"] == FOLDER:
                    todo.append(f["id"])
                elif self.export(f["mimeType"])[0]:
                    yield f

    def listing(self, spark: SparkSession) -> DataFrame:
        rows = [(f["id"], f["name"], f["mimeType"], f.get("modified")) for f in self.walk()]
        return spark.createDataFrame(rows, "file_id string, filename string, mime_type string, __ordinal long")

    def read(self, spark: SparkSession, keys: DataFrame | None = None) -> DataFrame:
        files = self.listing(spark) if keys is None else keys
        if "mime_type" not in files.columns:
            files = self.listing(spark).join(keys.select("file_id"), "file_id", "left_semi")
        files = files.select("file_id", "filename", "mime_type", "__ordinal")
        make, export = self.client, self.export

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = make()
            for batch in batches:
                for i, (file, mime) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    body = pa.array([client.content(file, export(mime)[1])], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:3]), body, batch.column(3).slice(i, 1)], ["file_id", "filename", "mime_type", "content", "__ordinal"])

        got = files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(fetch, "file_id string, filename string, mime_type string, content binary, __ordinal long")
        return got if self.binary else got.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))

    def changed(self, since: int, now: int) -> tuple[list[dict[str, Any]], int]:
        """Files changed after ``since`` below the roots, and the next cutoff: no later than a second before now."""
        below = {f["id"] for f in self.walk()}
        found = [f for f in self.client().recent(since) if f["modified"] > since]
        latest = max([since, *(f["modified"] for f in found)])
        return [f for f in found if f["id"] in below], min(latest, now - 1_000_000)


def object_changes(message: str, bucket: str, prefix: str = "") -> list[tuple[str, bool]]:
    """(key, whether it still exists) of every change of the bucket that a notice names; none for other notices.

    The prefix is tested on the decoded key.
    """
    try:
        records = json.loads(message).get("Records", [])
    except (ValueError, AttributeError):
        return []
    out = []
    for r in records if isinstance(records, list) else []:
        event, s3 = r.get("eventName", ""), r.get("s3", {})
        key = urllib.parse.unquote_plus(s3.get("object", {}).get("key", ""))
        if s3.get("bucket", {}).get("name") == bucket and key.startswith(prefix) and key:
            if event.startswith("ObjectCreated:"):
                out.append((key, True))
            elif event.startswith("ObjectRemoved:"):
                out.append((key, False))
    return out


@dataclass(frozen=True)
class Polled:
    """A source with news of its changes: ``wait_for`` blocks a while, and calls what it is given when something changed.

    It calls before it confirms the news to its service, so that nothing is confirmed before targets are up to date.
    """

    source: Any
    wait_for: Callable[[Callable[[], None]], Any] = field(compare=False)

    @property
    def keys(self) -> list[str]:
        return getattr(self.source, "keys", None) or [self.source.fields(None).fields[0][0]]

    def fields(self, spark: SparkSession) -> FieldType:
        return self.source.fields(spark)

    def listing(self, spark: SparkSession) -> DataFrame:
        return self.source.listing(spark)

    def read(self, spark: SparkSession, keys: DataFrame | None = None) -> DataFrame:
        return self.source.read(spark, keys)


def with_queue(source: Any, queue: QueueClient, bucket: str, prefix: str = "") -> Polled:
    """An object store whose changes a queue announces."""
    return Polled(source, lambda changed: drain(queue, bucket, prefix, lambda _: changed()))


def with_recent_changes(source: GoogleDrive, interval_s: float, now: Callable[[], int], pause: Callable[[float], Any]) -> Polled:
    """A drive that is asked for recent changes after every interval; times are in microseconds."""
    cutoff = [now()]

    def wait(changed: Callable[[], None]) -> None:
        pause(interval_s)
        found, after = source.changed(cutoff[0], now())
        if found:
            changed()
        cutoff[0] = after

    return Polled(source, wait)


class QueueClient(Protocol):
    def receive(self, most: int, wait_s: int) -> list[tuple[str, str]]: ...  # (receipt, body)

    def delete(self, receipt: str) -> None: ...


def drain(queue: QueueClient, bucket: str, prefix: str, apply: Callable[[list[tuple[str, bool]]], None], *, most: int = 10, wait_s: int = 20) -> int:
    """Take one batch of notices, apply the changes, then delete the notices; what names none of our objects is deleted at once."""
    waiting: list[str] = []
    changes: list[tuple[str, bool]] = []
    for receipt, body in queue.receive(most, wait_s):
        if found := object_changes(body, bucket, prefix):
            changes += found
            waiting.append(receipt)
        else:
            queue.delete(receipt)
    if changes:
        apply(changes)
    for receipt in waiting:
        queue.delete(receipt)
    return len(changes)
