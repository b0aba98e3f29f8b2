"""Near-duplicate embeddings by an inverted multi-index.

Vectors of unit length are cut in half and each half has a codebook of its own, fitted on a bounded sample; the
pairs of codewords form a grid of cells, and every vector lies in one. A vector visits cells in the order of
their distance, the sum over both halves: the ``t`` nearest are found among the pairs (i, j) of sorted
codewords with i * j <= t. ``t`` is the least number for which the target recall is met on sampled pairs and on
sampled vectors moved to the threshold itself. What meets in a cell is verified in double precision.

A pair counts once, from the side of the lower cell where both sides visit each other. Copies collapse before, with
their number as weight. The cells of a row of the grid, which share the first codeword, are dealt out together, so that a vector that visits
several of them is sent once; large rows are dealt out in blocks of residents and of comers, and no task holds more than
two blocks. A block reports numbers of links and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexflow.llm.common import Workspace, arrow_map
from indexflow.llm.components import components

#: Vectors that codebooks and the number of visits are fitted on, at most.
SAMPLE_ROWS = 20_000
#: Vectors to a cell on average, and at most in a block of a row of cells.
PER_CELL, BLOCK = 256, 2048
#: Codewords of a half at least, where the sample has four vectors to each.
LEAST_CODES = 16


def unit_vectors(vectors: pa.Array) -> list[np.ndarray | None]:
    """Doubles of length one; None for a null, empty or zero vector, or one with a null or non-finite component."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    cuts = vectors.offsets.to_numpy()
    out: list[np.ndarray | None] = []
    for i, null in enumerate(vectors.is_null().to_pylist()):
        v = flat[cuts[i] : cuts[i + 1]]
        if null or not len(v) or not np.isfinite(v).all() or not v.any():
            out.append(None)
            continue
        v = v / np.abs(v).max()
        out.append(v / np.sqrt(v @ v))
    return out


def unit_rows(raw: list[bytes], dim: int) -> np.ndarray:
    """Doubles of length one from vectors as they are stored, as floats or doubles."""
    x = np.frombuffer(b"".join(raw), dtype=np.float32 if len(raw[0]) == 4 * dim else np.float64).reshape(len(raw), dim).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def codebook(points: np.ndarray, codes: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from points of the sample."""
    centres = points[rng.choice(len(points), codes, replace=False)]
    for _ in range(rounds):
        near = distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=codes)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


class MultiIndex:
    """Two codebooks for one dimension of vectors."""

    def __init__(self, sample: np.ndarray, codes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.cut, self.codes = sample.shape[1] // 2, max(1, min(codes, len(sample) // 4))
        self.books = [codebook(h, self.codes, rng) if h.shape[1] else np.zeros((self.codes, 0)) for h in self.halves(sample)]
        self.visits = self.codes**2

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def traverse(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The nearest cells of each vector in order; the first is its own."""
        d = [distances(h, b) for h, b in zip(self.halves(x), self.books, strict=True)]
        order = [np.argsort(v, axis=1, kind="stable") for v in d]
        d = [np.take_along_axis(v, o, 1) for v, o in zip(d, order, strict=True)]
        i, j = np.nonzero(np.outer(np.arange(1, self.codes + 1), np.arange(1, self.codes + 1)) <= visits)
        sums = d[0][:, i] + d[1][:, j]
        first = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        rows = np.arange(len(x))[:, None]
        return order[0][rows, i[first]] * self.codes + order[1][rows, j[first]]

    def calibrate(self, sample: np.ndarray, labels: list[int], threshold: float, recall: float, seed: int = 11) -> None:
        """Set the visits by which the share ``recall`` of sampled links is found from one side alone."""
        rng = np.random.default_rng(seed)
        some = sample[rng.choice(len(sample), min(len(sample), 4000), replace=False)]
        off = rng.standard_normal(some.shape)
        off -= (off * some).sum(1)[:, None] * some
        norm = np.sqrt((off * off).sum(1))[:, None]
        moved = threshold * some + np.sqrt(max(0.0, 1 - threshold**2)) * np.divide(off, norm, out=np.zeros_like(off), where=norm > 0)
        pairs = [(some, moved)]
        by = np.array(labels)
        for label in np.unique(by):
            own = sample[by == label][:2000]
            a, b = np.nonzero(np.triu(own @ own.T >= threshold, 1))
            pick = rng.choice(len(a), min(len(a), 4000), replace=False) if len(a) else []
            pairs.append((own[a[pick]], own[b[pick]]))
        ranks = [self.ranks(x, y) for x, y in pairs if len(x)]
        real = np.concatenate(ranks[1:]) if len(ranks) > 1 else ranks[0]
        self.visits = int(min(self.codes**2, 1 + max(np.quantile(ranks[0], recall), np.quantile(real, recall))))

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many cells x visits before that of y; looked for ever deeper, among all cells in the end."""
        out, todo, depth = np.zeros(len(x), dtype=np.int64), np.arange(len(x)), min(self.codes**2, 4096)
        while len(todo):
            missed = []
            for at in np.split(todo, range(step := max(1, (1 << 20) // depth), len(todo), step)):
                hit = self.traverse(x[at], depth) == self.traverse(y[at], 1)
                found = hit.any(axis=1)
                out[at[found]] = hit[found].argmax(axis=1)
                missed.append(at[~found])
            todo = np.concatenate(missed)
            depth = min(self.codes**2, 2 * depth)
        return out


def block_links(table: pa.Table, threshold: float) -> pa.Table:
    """Links between one block of the residents of a row of cells and one of its comers, who may be residents too.

    Rows are id, links found (weighted by copies) and the smallest id that it reaches inside the block.
    """
    role = table["role"].to_numpy()
    ids, n, own, dim = (table[c].to_numpy() for c in ("id", "n", "own", "dim"))
    r, c = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    none = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
    if not len(r) or not len(c):
        return none
    x = unit_rows(table["vec"].to_pylist(), int(dim[0]))
    lists = table["cells"].combine_chunks()
    cuts, cells = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)
    holder = np.repeat(np.arange(len(ids)), np.diff(cuts))
    # of residents the cells that they visit, of comers those of this row
    wide = int(max(cells.max(), own.max())) + 1
    seen = np.unique(holder * wide + cells)
    visits = role[holder] == 1
    order = np.argsort(cells[visits], kind="stable")
    guest, guest_cell = holder[visits][order], cells[visits][order]
    first, second = [], []
    for cell in np.unique(own[r]):
        home = r[own[r] == cell]
        come = guest[np.searchsorted(guest_cell, cell) : np.searchsorted(guest_cell, cell, "right")]
        if not len(come):
            continue
        a, b = np.nonzero(x[come] @ x[home].T >= threshold)
        a, b = come[a], home[b]
        key = b * wide + own[a]
        back = seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] == key
        keep = np.where(own[a] == cell, ids[a] < ids[b], ~back | (cell < own[a]))
        first.append(a[keep])
        second.append(b[keep])
    a, b = (np.concatenate(p) if p else np.empty(0, dtype=np.int64) for p in (first, second))
    if not len(a):
        return none
    every, place = np.unique(ids, return_inverse=True)
    a, b, weight = place[a], place[b], (n[a], n[b])
    links = np.bincount(a, weight[1], len(every)) + np.bincount(b, weight[0], len(every))
    least = every.copy()
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == least).all():
            break
        least = new
    linked = links > 0
    return pa.table({"id": pa.array(every[linked], pa.int64()), "links": pa.array(links[linked].astype(np.int64)), "least": pa.array(least[linked], pa.int64())})


def near_groups(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.999, sample_rows: int = SAMPLE_ROWS, per_cell: int = PER_CELL, block: int = BLOCK, name: str = "embeddings") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Links join vectors of one label and dimension with a cosine of ``threshold`` or more. n_links counts the other
    vectors so linked, component_id is the smallest id reachable, kept marks the row with that id. Vectors that are
    null, empty or zero, or hold a null or non-finite component, and those with a null label or id, link with nothing: n_links 0 and
    their own component. Repeated rows are vectors of their own. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, name)
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, labels, ids = unit_vectors(batch.column(2)), batch.column(1).to_pylist(), batch.column(0).to_pylist()
            units = [u if label is not None and i is not None else None for u, label, i in zip(units, labels, ids, strict=True)]
            col = batch.column(2)
            flat, cuts = np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False)), col.offsets.to_numpy()
            raw = [None if u is None else flat[cuts[i] : cuts[i + 1]].tobytes() for i, u in enumerate(units)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None if u is None else len(u) for u in units], pa.int32()), pa.array([None if u is None else xxhash.xxh3_128_digest(u.tobytes()) for u in units], pa.binary()), pa.array(raw, pa.binary())], ["id", "label", "dim", "digest", "vec"])

    prepared = ws.save(rows.transform(arrow_map, prepare, "id long, label string, dim int, digest binary, vec binary"), "vectors")
    classes = ws.save(prepared.where("digest is not null").groupBy("label", "dim", "digest").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vec").alias("vec")), "classes")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    indexes = {}
    for dim, total in sizes.items():
        share = int(min(1.0, sample_rows / total) * (1 << 20))
        sample = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share)).select(F.xxhash64("label").alias("label"), "vec").limit(2 * sample_rows).toPandas()
        if len(sample):
            points = unit_rows(sample["vec"].tolist(), dim)
            indexes[dim] = index = MultiIndex(points, max(LEAST_CODES, round((total / per_cell) ** 0.5)))
            index.calibrate(points, sample["label"].tolist(), threshold, recall)
    shared = spark.sparkContext.broadcast(indexes)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                dims, raw = part.column(2).to_pylist(), part.column(4).to_pylist()
                cells, codes = [np.zeros(1, dtype=np.int64)] * len(dims), np.ones(len(dims), dtype=np.int64)
                for dim in {*dims} & {*shared.value}:
                    at, index = [i for i, d in enumerate(dims) if d == dim], shared.value[dim]
                    codes[at] = index.codes
                    for i, seen in zip(at, index.traverse(unit_rows([raw[i] for i in at], dim), index.visits), strict=True):
                        cells[i] = seen
                rows = [[{"row": int(k), "cells": c[c // w == k].tolist()} for k in np.unique(c // w)] for c, w in zip(cells, codes, strict=True)]
                made = [pa.array([int(c[0]) for c in cells], pa.int32()), pa.array([int(c[0] // w) for c, w in zip(cells, codes, strict=True)], pa.int32()), pa.array([c.tolist() for c in cells], pa.list_(pa.int32())), pa.array(rows, pa.list_(pa.struct([("row", pa.int32()), ("cells", pa.list_(pa.int32()))])))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "own", "home", "seen", "rows"])

    placed = ws.save(classes.select("id", "label", "dim", "n", "vec").transform(arrow_map, visit, "id long, label string, dim int, n long, vec binary, own int, home int, seen array<int>, rows array<struct<row:int,cells:array<int>>>"), "placed")
    key = ["label", "dim", "row"]
    comers = placed.select("id", "label", "dim", "n", "vec", "own", "home", F.explode("rows").alias("r")).select("id", "label", "dim", "n", "vec", "own", "home", "r.row", "r.cells")
    blocks = comers.groupBy(*key).agg(F.ceil(F.sum(F.expr("int(home = row)")) / block).cast("int").alias("homes"), F.ceil(F.count("*") / block).cast("int").alias("guests")).where("homes > 0")
    part = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["id", "n", "vec", "own", "cells"]
    home = placed.withColumn("row", F.col("home")).withColumn("cells", F.col("seen")).join(blocks, key).select(*key, *cols, F.lit(0).alias("role"), part("homes", 1).alias("hb"), every("guests").alias("gb"))
    guest = comers.join(blocks, key).select(*key, *cols, F.lit(1).alias("role"), part("guests", 2).alias("gb"), every("homes").alias("hb"))
    both = home.unionByName(guest)
    found = ws.save(both.groupBy(*key, "hb", "gb").applyInArrow(lambda t: block_links(t, threshold), "id long, links long, least long"), "links")
    groups = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")), ws)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = classes.join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left").select("label", "dim", "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    per_class = ws.save(per_class, "groups")
    ws.clear(prepared, per_class)
    out = prepared.select("id", "label", "dim", "digest").join(per_class, ["label", "dim", "digest"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
