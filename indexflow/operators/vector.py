"""Exact vector search. The metrics are cosine and inner product, where larger is nearer, and L2, where smaller is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "ip")
#: Queries that are broadcast at once.
QUERY_BLOCK = 1000
#: Rows that are scored at once.
ROW_BLOCK = 1000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score(a: Column, b: Column, metric: str) -> Column:
    """The metric of two vectors in double precision; cosine with a zero vector is null."""
    if metric == "cosine":
        norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norms > 0, dot(a, b) / norms)
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))
    if metric == "ip":
        return dot(a, b)
    raise ValueError(f"{metric!r} is none of {METRICS}")


def top_k(rows: DataFrame, query: list[float], k: int, *, vector: str, metric: str = "cosine", tie: str) -> DataFrame:
    """The ``k`` rows nearest to one query with their score; ties go to the smaller ``tie``. Vectors of another length and nulls are left out."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = rows.where(F.size(vector) == len(query)).withColumn("score", score(F.col(vector), q, metric)).where("score is not null")
    return scored.orderBy(F.col("score").asc() if metric == "l2" else F.col("score").desc(), tie).limit(k)


def nearness(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """The metric of all pairs of queries and rows, L2 with its sign turned, so that larger is nearer."""
    s = q @ x.T
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return s / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None, :]
    if metric == "l2":
        return -np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(2)) if q.size * len(x) < 1 << 22 else -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * s, 0))
    return s


def better(best: tuple[np.ndarray, ...], s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The best ``k`` of each query among those so far and new ones; scores equal to 12 digits go to the smaller id."""
    query, value, found, least = best
    near = np.round(s, 12)
    own, at = np.nonzero((near >= least[:, None]) & np.isfinite(s))
    if not len(own):
        return best
    query, value, found = np.concatenate((query, own)), np.concatenate((value, s[own, at])), np.concatenate((found, ids[at]))
    order = np.lexsort((found, -np.round(value, 12), query))
    query = query[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    kept, last = order[rank < k], order[rank == k - 1]
    least[query[rank == k - 1]] = np.round(value[last], 12)
    return query[rank < k], value[kept], found[kept], least


def top_k_batch(rows: DataFrame, queries: DataFrame, k: int, *, id_col: str, vector: str, metric: str = "cosine") -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` nearest rows to every query (columns query_id, query).

    Queries go out in blocks of a fixed number. Rows are scored in blocks of a fixed number by one matrix product each, and a task
    keeps its best ``k`` per query, so that no more than those are shuffled.
    """
    spark = rows.sparkSession
    asked = queries.select(F.col("query_id").cast("long"), F.col("query").cast("array<double>")).where("query is not null").toLocalIterator()
    blocks: list[list] = [[]]
    for r in asked:
        if len(blocks[-1]) == QUERY_BLOCK:
            blocks.append([])
        blocks[-1].append((r[0], r[1]))
    parts = []
    for block in blocks:
        dims = sorted({len(v) for _, v in block})
        shared = spark.sparkContext.broadcast({d: (np.array([i for i, v in block if len(v) == d]), np.array([v for _, v in block if len(v) == d])) for d in dims})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            # by dimension: query, score and id of the best rows so far, and the k-th score of each query
            best = {d: (*(np.empty(0, t) for t in (np.int64, np.float64, np.int64)), np.full(len(q), -np.inf)) for d, (_, q) in shared.value.items()}
            for whole in batches:
                for batch in (whole.slice(i, ROW_BLOCK) for i in range(0, whole.num_rows, ROW_BLOCK)):
                    ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
                    for d, (_, q) in shared.value.items():
                        at = np.flatnonzero(sizes == d)
                        if len(at) and d:
                            x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                            best[d] = better(best[d], nearness(q, x, metric), ids[at], k)
            for d, (query, value, found, _) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[d][0][query], pa.int64()), pa.array(found, pa.int64()), pa.array(-value if metric == "l2" else value, pa.float64())], ["query_id", "id", "score"])

        parts.append(rows.select(F.col(id_col).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "query_id long, id long, score double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    near = F.round("score", 12)
    w = Window.partitionBy("query_id").orderBy(near.asc() if metric == "l2" else near.desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
