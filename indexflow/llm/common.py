"""Shared folders, written tables and word hashing used by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text handled at once inside one Arrow batch, and an Arrow batch where the session sets no limit, in bytes.
SLICE_BYTES = BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Words whose hashes a Python worker remembers before it starts afresh, and bytes of such a word at most.
MEMO_WORDS, MEMO_BYTES = 300_000, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, from spark.checkpoint.dir.

    Only where that setting is absent and Spark runs in this process, as in local tests, a temporary folder is chosen.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='indexflow-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Tables written in the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.saved: list[str] = []

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._saved_at = path
        self.saved.append(path)
        return out

    def clear(self, *kept: DataFrame) -> None:
        """Delete the tables saved so far but those in ``kept``, from which a result is still to be made."""
        jvm, left = self.spark._jvm, {df._saved_at for df in kept}
        for path in [p for p in self.saved if p not in left]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.saved = [p for p in self.saved if p in left]


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system; idle workers stay and add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any) -> DataFrame:
    """mapInArrow with batches bounded in bytes and workers that give memory back. A limit that the session sets is kept."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text each; one long text is a range of its own."""
    n = len(texts)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, total = 0, 0
    for i in range(n):
        if i > start and total + sizes[i] > limit:
            yield start, i
            start, total = i, 0
        total += int(sizes[i])
    if start < n:
        yield start, n


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of short words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that begin at each position but the last k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, 0x9E3779B97F4A7C15 * k & (1 << 64) - 1, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(h)
