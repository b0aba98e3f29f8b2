"""Language identification as inference of a multilingual mixture.

Each language is a model of letter trigrams, estimated on labelled texts. A document's words
are drawn from languages in unknown proportions: expectation-maximisation finds those from
the words' trigram likelihoods. Sets of languages nested by proportion are refitted, and the one with
the best likelihood, less a penalty for every further language, is the document's set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexflow.llm.common import arrow_map, text_slices

BITS = 16
#: Labelled rows per language that a model is fitted on.
SAMPLE_ROWS = 3000
#: Languages that a model may hold.
MAX_LANGS = 500
#: Words whose likelihoods a Python worker remembers before it starts afresh, and their bytes.
MEMO_WORDS, MEMO_BYTES = 100_000, 8 << 20
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are not letters part words; the text is lower-cased before.
FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(FOLD).split() if text else []


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the trigrams of words with their ends marked, and where each word's begin."""
    flat = np.frombuffer(b"".join([b"\x01" + w + b"\x02" for w in words]), dtype=np.uint8).astype(np.uint32)
    size = np.array([len(w) for w in words], dtype=np.int64)
    start = np.cumsum(size) - size
    at = np.repeat(2 * np.arange(len(words)), size) + np.arange(size.sum())
    code = flat[at] << np.uint32(16) | flat[at + 1] << np.uint32(8) | flat[at + 2]
    with np.errstate(over="ignore"):
        return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS), start


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str | None = None, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Languages and their log-probabilities per trigram bucket, from rows with a label and a text.

    About ``sample_rows`` rows of each language are used, picked by a hash of the text and, if given, the id, which keeps
    apart the copies of a frequent text. Counting is distributed, and what reaches the driver is bounded by
    languages times buckets. No labelled rows give a model without languages.
    """
    rows = labelled.select((F.xxhash64(text_col, id_col) if id_col else F.xxhash64(text_col)).alias("hash"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "logp": np.zeros((1 << BITS, 0), dtype=np.float32)}
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_rows / sizes[k])))))
    picked = rows.where(F.pmod("hash", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 1 << BITS), dtype=np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := words_of(text):
                    total[langs.index(lang)] += np.bincount(trigrams(words)[0], minlength=1 << BITS)
        for i, row in enumerate(total):
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], ["lang", "bucket", "n"])

    counts = picked.transform(arrow_map, count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((1 << BITS, len(langs)), 0.1)
    table[counts["bucket"], counts["lang"]] += counts["n"]
    return {"langs": langs, "logp": np.log(table / table.sum(axis=0)).astype(np.float32)}


class Mixture:
    """Language proportions of batches of texts."""

    def __init__(self, model: dict, rounds: int = 10, penalty: float = 2.0):
        self.model, self.rounds, self.penalty = model, rounds, penalty
        self.names: dict[bytes, int] = {}
        self.rows = np.empty((0, len(model["langs"])), dtype=np.float32)
        self.used = self.size = 0

    def likelihoods(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood of each word under each language."""
        fresh = list(set(words).difference(self.names))
        if self.used + len(fresh) > MEMO_WORDS or self.size > MEMO_BYTES:
            self.names, self.used, self.size = {}, 0, 0
            fresh = list(set(words))
        if fresh:
            code, start = trigrams(fresh)
            if self.used + len(fresh) > len(self.rows):
                grown = np.empty((max(MEMO_WORDS, self.used + len(fresh)), self.rows.shape[1]), dtype=np.float32)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : self.used + len(fresh)] = np.add.reduceat(self.model["logp"][code], start, axis=0)
            self.names.update(zip(fresh, range(self.used, self.used + len(fresh)), strict=True))
            self.used += len(fresh)
            self.size += sum(map(len, fresh))
        return self.rows[np.fromiter(map(self.names.__getitem__, words), dtype=np.int64, count=len(words))]

    def fit(self, like: np.ndarray, start: np.ndarray, size: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood (without the words' own scale) of each document with the languages in its mask."""
        pi = mask / mask.sum(axis=1, keepdims=True)
        for step in range(self.rounds + 1):
            joint = like * np.repeat(pi, size, axis=0).astype(np.float32)
            total = joint.sum(axis=1) + np.float32(1e-30)
            if step == self.rounds:
                break
            pi = np.add.reduceat(joint / total[:, None], start, axis=0) / size[:, None]
        return pi, np.add.reduceat(np.log(total), start)

    def infer(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proportions of each text's chosen languages, its best language (-1: none), and the number of its words."""
        langs = len(self.model["langs"])
        out, best = np.zeros((len(texts), langs)), np.full(len(texts), -1)
        split = [words_of(t) if t and LETTER.search(t) else [] for t in texts]
        n_words = np.array([len(w) for w in split], dtype=np.int64)
        live = np.flatnonzero(n_words)
        if not langs or not len(live):
            return out, best, n_words
        size = n_words[live]
        start = np.cumsum(size) - size
        logs = self.likelihoods([w for i in live for w in split[i]])
        like = np.exp(logs - logs.max(axis=1, keepdims=True))
        pi, score = self.fit(like, start, size, np.ones((len(live), langs)))
        order = np.argsort(-pi, axis=1, kind="stable")
        alone = np.zeros_like(pi)
        alone[np.arange(len(live)), order[:, 0]] = 1
        chosen = alone.copy()
        _, top = self.fit_alone(like, start, size, order[:, 0])
        for more in range(2, langs + 1):
            at = np.flatnonzero(np.take_along_axis(pi, order[:, more - 1 : more], 1)[:, 0] > np.minimum(0.01, 1 / size))
            if not len(at):
                break
            mask = np.zeros((len(at), langs))
            np.put_along_axis(mask, order[at, :more], 1, 1)
            rows = np.repeat(start[at], size[at]) + np.arange(size[at].sum()) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
            part, gain = self.fit(like[rows], np.cumsum(size[at]) - size[at], size[at], mask)
            gain = gain - (more - 1) * self.penalty * np.log(np.maximum(2, size[at]))
            better = gain > top[at]
            top[at[better]], chosen[at[better]] = gain[better], part[better]
        out[live], best[live] = chosen, chosen.argmax(axis=1)
        return out, best, n_words

    @staticmethod
    def fit_alone(like: np.ndarray, start: np.ndarray, size: np.ndarray, lang: np.ndarray) -> tuple[None, np.ndarray]:
        return None, np.add.reduceat(np.log(like[np.arange(len(like)), np.repeat(lang, size)] + np.float32(1e-30)), start)


def identify(docs: DataFrame, model: dict, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred, score and langs for every whole text.

    langs are the chosen languages with their proportions, the largest first; lang_pred is the first of them and score its
    proportion. Texts that are null or have no letter, and all texts under a model without languages, have lang_pred
    ``und``, score 0 and no langs. Ties go to the first language in order; columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = ("lang_pred", "score", "langs")
    kept = [c for c in (keep or docs.columns) if c.lower() not in made]
    pair = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    out = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.ArrayType(pair))])
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias("__text")).transform(arrow_map, partial(_identify, shared, len(kept), out.names), out)


def _identify(shared, w: int, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mixture, langs = Mixture(shared.value), shared.value["langs"]
    for batch in batches:
        for lo, hi in text_slices(batch.column(w), 1 << 20):
            part = batch.slice(lo, hi - lo)
            pi, best, _ = mixture.infer(part.column(w).to_pylist())
            sets = [[{"lang": langs[j], "share": float(row[j])} for j in np.argsort(-row, kind="stable") if row[j] > 0] for row in pi]
            score = np.clip(pi.max(axis=1, initial=0), 0, 1)
            yield pa.RecordBatch.from_arrays([*part.columns[:w], pa.array([langs[b] if b >= 0 else "und" for b in best], pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], names)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
