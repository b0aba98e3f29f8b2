"""Benchmark decontamination by winnowing.

Texts are cut into windows of ``window`` words. The smallest of the k-gram hashes inside a window is its
fingerprint, so a window that stands in a document too keeps its fingerprint there: every shared span of a window or
more is found. Fingerprints of documents are joined with those of items together with the hash of the whole window around them,
which is what a hit is extended to. Items of fewer words are one window of their own length, without a fingerprint.

A bitmap of the items' fingerprints and one of their windows, of bounded size, tell most windows of documents before the
join, so that little more than real hits is shuffled; with very many items they tell fewer, and the join decides all the same.
A hit has equal hashes of 64 bits for both the fingerprint and the window, so a false one is to be expected only where windows of documents
times windows of items near 2**128 (2**64 for items shorter than a window).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexflow.llm.common import WordHashes, Workspace, arrow_map, as_bytes, gram_hashes, text_slices

#: Bits of each bitmap of the items' hashes, at most; both are broadcast.
FILTER_BITS = 1 << 27
#: A word is a run of a-z, 0-9 and bytes from 0x80 on; A-Z count as a-z.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """The position of the rightmost smallest hash of every run of ``span`` hashes."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    best = np.arange(span - 1, len(grams))
    for back in range(1, span):
        at = np.arange(span - 1 - back, len(grams) - back)
        best = np.where(grams[at] < grams[best], at, best)
    return best


def is_set(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = values & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def bitmap(rows: DataFrame, col: str, bits: int) -> np.ndarray:
    """A bitmap of a power of two of bits, made on the executors; what reaches the driver is bounded by its size."""
    at = F.col(col).bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    words = rows.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("mask")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["word"]] = words["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def windows(h: np.ndarray, doc: np.ndarray, n: int, window: int, k: int, prints: np.ndarray | None = None, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, fingerprint, hash) of the windows of ``n`` words in a flat run of documents' words, without those that the bitmaps exclude.

    Windows shorter than ``window`` have the fingerprint 0.
    """
    starts = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :]) if len(h) >= n else np.empty(0, dtype=np.int64)
    found = np.zeros(len(starts), dtype=np.uint64)
    if n == window and len(starts):
        grams = gram_hashes(h, k)
        best = winnow(grams, window - k + 1)
        if prints is not None:
            maybe = np.zeros(len(grams), dtype=bool)
            chosen = best[np.flatnonzero(np.diff(best, prepend=-1))]  # a fingerprint serves many windows
            maybe[chosen] = is_set(prints, grams[chosen])
            starts = starts[maybe[best[starts]]]
        found = grams[best[starts]]
    if 4 * n * len(starts) < len(h):
        hashes = gram_hashes(h[(starts[:, None] + np.arange(n)).reshape(-1)], n)[::n] if len(starts) else found[:0]
    else:
        hashes = gram_hashes(h, n)[starts]
    if whole is not None:
        keep = is_set(whole, hashes)
        starts, found, hashes = starts[keep], found[keep], hashes[keep]
    return starts, found, hashes


def spans(starts: np.ndarray, sizes: np.ndarray) -> list[dict[str, int]]:
    """The union of word ranges, as disjoint spans [start, end)."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), (starts + sizes).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """(item, n, print, hash) of every window of every item, once an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                h = memo.of(words_of(text))
                n = min(len(h), window)
                if n:
                    _, prints, hashes = windows(h, np.zeros(len(h), dtype=np.int64), n, window, k)
                    both = np.unique(np.stack((prints, hashes)), axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * both.shape[1], pa.string()), pa.array(np.full(both.shape[1], n), pa.int32()), pa.array(both[0]), pa.array(both[1])], ["item", "n", "print", "hash"])

    return items.transform(arrow_map, run, "item string, n int, print long, hash long")


def overlaps(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, k: int = 5, keep: list[str] | None = None, filter_bits: int = FILTER_BITS, name: str = "overlaps") -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, hit_spans and hit_items of every whole text.

    hit_spans are the word ranges [start, end) covered by windows of items, disjoint and in order; hit_items are the ids of
    the items with such windows, as strings in order. Texts that are null or hold no word have
    none of either; items without words are nowhere. Repeated rows and items count as often as they stand, columns of docs with
    the three names are replaced, and empty tables give no hits.
    """
    spark = docs.sparkSession
    if not 1 <= k <= window:
        raise ValueError("k must be from 1 to window")
    ws = Workspace(spark, name)
    pieces = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    key = ["n", "print", "hash"]
    listed = ws.save(item_windows(pieces, window, k).groupBy(*key).agg(F.collect_set("item").alias("items")), "windows")
    sizes = {r["n"]: r["count"] for r in listed.groupBy("n").count().collect()}
    lengths = sorted(sizes)
    bits = min(filter_bits, max(64, 1 << (16 * sum(sizes.values())).bit_length()))
    shared = spark.sparkContext.broadcast((bitmap(listed.where(F.col("n") == window), "print", bits), bitmap(listed, "hash", bits)))

    made = ("n_words", "hit_spans", "hit_items")
    kept = [c for c in (keep or docs.columns) if c.lower() not in made]
    w = len(kept)
    hit = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("print", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("start", T.IntegerType())])
    columns = T.StructType([docs.schema[c] for c in kept] + [T.StructField("__row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("__hits", T.ArrayType(hit))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (prints, whole), row = WordHashes(), shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            col = batch.column(w)
            for lo, hi in text_slices(col):
                split = [words_of(t) for t in as_bytes(col.slice(lo, hi - lo))]
                count = np.array([len(x) for x in split], dtype=np.int64)
                first = np.cumsum(count) - count
                h, doc = memo.of([x for xs in split for x in xs]), np.repeat(np.arange(len(split)), count)
                found = [(n, *windows(h, doc, n, window, k, prints, whole)) for n in lengths]
                start = np.concatenate([f[1] for f in found] or [np.empty(0, dtype=np.int64)])
                owner = doc[start]
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(len(split) + 1))
                n = np.concatenate([np.full(len(f[1]), f[0]) for f in found] or [start])[order]
                values = [np.concatenate([f[i] for f in found] or [start.astype(np.uint64)])[order].view(np.int64) for i in (2, 3)]
                hits = pa.StructArray.from_arrays([pa.array(n, pa.int32()), *map(pa.array, values), pa.array((start - first[owner])[order], pa.int32())], ["n", "print", "hash", "start"])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(w)), pa.array(np.arange(row, row + len(split))), pa.array(count), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), hits)], columns.names)
                row += len(split)

    work = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias("__text"))
    searched = ws.save(work.transform(arrow_map, search, columns), "searched")
    likely = searched.where("size(__hits) > 0")
    hits = likely.select("__row", F.explode("__hits").alias("h")).select("__row", "h.*").join(listed, key).select("__row", "n", "start", "items")
    grouped = hits.groupBy("__row").agg(F.collect_set(F.struct("start", "n")).alias("at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [(np.array([x["start"] for x in xs]), np.array([x["n"] for x in xs])) for xs in batch.column(1).to_pylist()]
            names = [sorted(xs, key=lambda x: x.encode()) for xs in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spans(*x) for x in at], arrow_span), pa.array(names, pa.list_(pa.string()))], ["__row", "hit_spans", "hit_items"])

    found = grouped.transform(arrow_map, merged, T.StructType([T.StructField("__row", T.LongType()), T.StructField("hit_spans", T.ArrayType(span)), T.StructField("hit_items", T.ArrayType(T.StringType()))]))
    none = [F.array().cast(T.ArrayType(span)).alias("hit_spans"), F.array().cast("array<string>").alias("hit_items")]
    cols = [F.col(f"`{c}`") for c in kept]
    clean = searched.where("size(__hits) = 0").select(*cols, "n_words", *none)
    hit_rows = likely.drop("__hits").join(found, "__row", "left").select(*cols, "n_words", F.coalesce("hit_spans", none[0]).alias("hit_spans"), F.coalesce("hit_items", none[1]).alias("hit_items"))
    return clean.unionByName(hit_rows)


def hit_words() -> Column:
    """The number of words that hit_spans cover."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
