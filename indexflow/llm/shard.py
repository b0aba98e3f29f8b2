"""Sharding by jump consistent hashing.

A row's shard follows from a stable 64-bit key and the number of shards alone, without a table of
shards; one more shard takes rows only into itself. Slots number a shard's rows from 0 without a gap: rows are
numbered inside each input partition as they stream by, and a small table of rows per shard and
partition gives every partition its offset, so no row is shuffled and no shard is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexflow.llm.common import Workspace, arrow_map


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key, out = keys.astype(np.uint64), np.full(len(keys), -1, dtype=np.int64)
    live, at = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = at
            key = key * np.uint64(2862933555777941757) + np.uint64(1)
            at = ((out[live] + 1) * (float(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
            on = at < shards
            live, at, key = live[on], at[on], key[on]
    return out


def place(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", name: str = "shard") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot and grown_shard, the shard where there is one more.

    size is the text's UTF-8 bytes plus 16, a null text having none and the crc of nothing, 0. Equal ids, nulls
    among them, share a shard; repeated rows get slots of their own. Other columns are not read. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, name)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(id_col).alias("key"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
        for batch in batches:
            key = batch.column(3).to_numpy().view(np.uint64)
            shard = jump(key, shards)
            order = np.argsort(shard, kind="stable")
            n = np.bincount(shard, minlength=shards)
            local = np.empty(len(shard), dtype=np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(n) - n - seen, n)
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shard, pa.int32()), pa.array(jump(key, shards + 1), pa.int32()), pa.array(np.full(len(shard), pid), pa.int32()), pa.array(local, pa.int64())], ["id", "size", "text_crc32", "shard", "grown_shard", "pid", "local"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = ws.save(rows.transform(arrow_map, number, f"id {kind}, size long, text_crc32 long, shard int, grown_shard int, pid int, local long"), "placed")
    counts = placed.groupBy("shard", "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("pid")
    offsets = counts.select("shard", "pid", (F.sum("n").over(before) - F.col("n")).alias("offset"))
    return placed.join(offsets, ["shard", "pid"]).select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("local")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, shards: int, path: str, *, id_col: str = "doc_id", shard_col: str = "shard") -> None:
    """Write ``docs`` as Parquet in a folder per shard. Large shards are split over tasks by the rebalancing shuffle."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(jump(key, shards), pa.int32())], [*kept, shard_col])

    kept = [c for c in docs.columns if c.lower() != shard_col.lower()]
    schema = docs.select(*(F.col(f"`{c}`") for c in kept), F.lit(0).alias(shard_col)).schema
    keyed = docs.select(*(F.col(f"`{c}`") for c in kept), F.xxhash64(id_col).alias("__key"))
    keyed.transform(arrow_map, number, schema).hint("rebalance", F.col(shard_col)).write.partitionBy(shard_col).parquet(path)
