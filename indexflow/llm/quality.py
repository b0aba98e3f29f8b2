"""Quality scores by ordinal cumulative-link regression on graded ratings.

A text is a set of hashed features: its words and their beginnings of four to six letters, and how large a share of its words is upper case, repeats
the word before, carries symbols or stands between bars. One weight vector serves all grades; ordered thresholds
cut its score, P(grade > j) = sigmoid(w x - t[j]). The tails give the expected grade and select texts.
The model is fitted on the driver, on the features of a bounded sample of rated texts. Every word may get a weight; the
penalty decides which do. Without rated texts there is nothing to go by: every tail is 0, so nothing is selected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexflow.llm.common import Workspace, arrow_map, text_slices

BITS = 18
#: Rated texts that a model is fitted on, at most about, and bytes of their features.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 128 << 20
#: Words whose features a Python worker remembers before it starts afresh, and bytes of such a word at most.
MEMO_WORDS, MEMO_BYTES = 300_000, 64
SYMBOLS = re.compile(rb"[!#$%&*=+<>^~@\\]{2,}|\|")
EDGES = bytes(b if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Letters of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6)
SHARES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)


class Features:
    """Hashed features of texts."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int, tuple[int, ...]]] = {}

    def word(self, token: bytes) -> tuple[int, int, tuple[int, ...]]:
        """The feature of a token (-1: none), what is odd about it (1 upper case, 2 symbols, 4 long), and the features of its beginnings."""
        found = self.known.get(token)
        if found is None:
            core = token.translate(EDGES).strip()
            text = core.decode("utf-8", "replace")
            odd = (len(text) > 1 and text.isupper()) | 2 * bool(SYMBOLS.search(token)) | 4 * (len(text) > 24)
            low = text.lower()
            code = lambda x, seed=0: xxhash.xxh32_intdigest(x.encode(), seed) & (1 << BITS) - 1
            found = (code(low) if core else -1, odd, tuple(code(low[:n], n) for n in BEGINNINGS if len(low) > n))
            if len(token) <= MEMO_BYTES:
                if len(self.known) >= MEMO_WORDS:
                    self.known.clear()
                self.known[token] = found
        return found

    def of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct features of a whole text."""
        words = text.split() if text else []
        if not words:
            return np.array([xxhash.xxh32_intdigest(b"empty", 9) & (1 << BITS) - 1], dtype=np.int32)
        distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
        kinds = [self.word(w) for w in distinct]
        at = np.fromiter(map(distinct.__getitem__, words), dtype=np.int64, count=len(words))
        own = np.array([k[0] for k in kinds], dtype=np.int32)
        odd = np.array([k[1] for k in kinds], dtype=np.int32)[at]
        codes, n = own[at], len(words)
        shares = {"upper": (odd & 1).astype(bool).sum() / n, "symbols": (odd & 2).astype(bool).sum() / n, "long": (odd & 4).astype(bool).sum() / n, "again": (codes[1:] == codes[:-1]).sum() / n, "same": 1 - len(distinct) / n if n > 20 else 0.0}
        extra = [xxhash.xxh32_intdigest(f"{name}>{edge}".encode(), 9) & (1 << BITS) - 1 for name, share in shares.items() for edge in SHARES if share > edge]
        begun = [c for k in kinds for c in k[2]]
        return np.unique(np.concatenate((own[own >= 0], np.array(begun + extra, dtype=np.int32))))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Ordinal:
    """Shared weights and ordered thresholds for grades 0 .. len(cuts)."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def tails(self, x: list[np.ndarray]) -> np.ndarray:
        """P(grade > j) of each text, a column for each threshold."""
        sizes = np.array([len(f) for f in x], dtype=np.int64)
        score = np.zeros(len(x))
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.concatenate([x[i] for i in full])
            score[full] = np.add.reduceat(self.weights[flat], np.cumsum(sizes[full]) - sizes[full])
        return sigmoid(score[:, None] - self.cuts[None, :])


def slopes(w: np.ndarray, first: float, steps: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean log-likelihood of some grades, the features that stand in the texts with its slope in their weights, and its slopes in the first cut and the logarithms of the steps to the others."""
    cuts = first + np.concatenate(([0], np.cumsum(np.exp(steps))))
    up = Ordinal(w, cuts).tails(rows)  # P(y > j)
    full = np.hstack([np.ones((len(y), 1)), up, np.zeros((len(y), 1))])
    own = np.arange(len(y))
    p = np.maximum(full[own, y] - full[own, y + 1], 1e-9)
    slope = full * (1 - full)
    ds = (slope[own, y] - slope[own, y + 1]) / p  # d log p / d score
    dc = np.zeros(len(cuts) + 2)
    np.add.at(dc, y, -slope[own, y] / p)
    np.add.at(dc, y + 1, slope[own, y + 1] / p)
    dc = dc[1:-1] / len(y)
    flat = np.concatenate(rows)
    g = np.bincount(flat, np.repeat(ds, [len(r) for r in rows]), len(w)) / len(y)
    present = np.zeros(len(w), dtype=bool)
    present[flat] = True
    at = np.flatnonzero(present)
    return float(np.log(p).mean()), at, g[at], np.concatenate(([dc.sum()], np.cumsum(dc[::-1])[::-1][1:] * np.exp(steps)))


def fit(x: list[np.ndarray], y: np.ndarray, grades: int = 3, *, epochs: int = 60, rate: float = 0.3, sparsity: float = 1e-3, start: float = 1e-2, batch: int = 128, seed: int = 3) -> Ordinal:
    """Maximum likelihood with an absolute penalty on weights, by proximal AdaGrad. Thresholds are a first one and positive steps, so they stay ordered."""
    size = 1 << BITS
    if not len(x):
        return Ordinal(np.zeros(size), np.full(grades - 1, np.inf))
    share = np.array([(y > j).mean() for j in range(grades - 1)])
    cuts = -np.log((share + 1e-3) / (1 - share + 1e-3))
    cuts = np.maximum.accumulate(cuts + 1e-3 * np.arange(len(cuts)))
    first, steps = cuts[0], np.log(np.maximum(np.diff(cuts), 1e-3))
    w, gw, gt = np.zeros(size), np.full(size, start * start), np.full(len(cuts), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs if len(np.unique(y)) > 1 else 0):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            _, at, g, gc = slopes(w, first, steps, [x[i] for i in pick], y[pick])
            gw[at] += g * g
            pace = rate / np.sqrt(gw[at])
            moved = w[at] + pace * g
            w[at] = np.sign(moved) * np.maximum(np.abs(moved) - pace * sparsity, 0)
            gt += gc * gc
            move = rate * gc / np.sqrt(gt)
            first, steps = first + move[0], steps + move[1:]
    return Ordinal(w, first + np.concatenate(([0], np.cumsum(np.exp(steps)))))


def train(docs: DataFrame, ratings: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", grade_col: str = "grade", grades: int = 3, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Ordinal:
    """A model of grades 0 .. ``grades`` - 1 from the texts of ``docs`` and the ids and grades of ``ratings``.

    About ``sample_rows`` rated ids and never twice as many are picked by a hash; only their texts are fetched, and fewer where their
    features come to more than ``sample_bytes``. Null or other grades, null ids and null texts are left out; of several
    grades of an id the lowest counts, of several texts the smallest. No rows give a model that selects nothing, rows of
    one grade only a model without weights.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "quality")
    rated = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).where(F.col("id").isNotNull() & F.col("grade").between(0, grades - 1)).groupBy("id").agg(F.min("grade").alias("grade"))
    rated = ws.save(rated, "ratings")
    share = min(1.0, sample_rows / max(1, rated.count()))
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    picked = rated.where(spot < int(share * (1 << 20))).limit(2 * sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for lo, hi in text_slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                found = [features.of(t.encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f.astype("<i4").tobytes() for f in found], pa.binary()), part.column(2)], ["id", "x", "y"])

    kind = texts.schema["id"].dataType.simpleString()
    made = ws.save(texts.transform(arrow_map, run, f"id {kind}, x binary, y int"), "features")
    size = made.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()[0]
    fits = min(1.0, sample_bytes / max(1, size))
    data = made.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 20)) < int(fits * (1 << 20))).select("x", "y").toPandas().sort_values(["x", "y"])
    ws.clear()
    return fit([np.frombuffer(b, dtype="<i4") for b in data["x"]], data["y"].to_numpy(dtype=np.int64), grades)


def score(docs: DataFrame, model: Ordinal, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with expected_grade and tails, P(grade > j) for every j, of every whole text.

    Null and empty texts have the one feature of an empty text. Repeated rows are kept; columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weights).astype(np.int32), model.weights[model.weights != 0], model.cuts))
    kept = [c for c in (keep or docs.columns) if c.lower() not in ("expected_grade", "tails")]
    out = T.StructType([docs.schema[c] for c in kept] + [T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias("__text")).transform(arrow_map, partial(_score, shared, len(kept), out.names), out)


def _score(shared, w: int, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, values, cuts = shared.value
    weights = np.zeros(1 << BITS)
    weights[at] = values
    model, features = Ordinal(weights, cuts), Features()
    for batch in batches:
        for lo, hi in text_slices(batch.column(w)):
            part = batch.slice(lo, hi - lo)
            tails = model.tails([features.of(t.encode() if t else None) for t in part.column(w).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns[:w], pa.array(tails.sum(axis=1), pa.float64()), pa.array(tails.tolist(), pa.list_(pa.float64()))], names)
