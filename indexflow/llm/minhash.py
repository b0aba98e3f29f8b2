"""Near-duplicate documents by HyperMinHash.

A document is the set of hashes of its distinct word shingles. One hash of each
shingle picks one of ``m`` buckets and a 64-bit fraction; a bucket keeps the
smallest fraction, compressed to a register of its leading-zero count and ten
mantissa bits. Empty buckets borrow the register of another bucket in an order
that depends on the bucket alone, so two sets still agree on a register with
a probability of their Jaccard similarity. Bands of registers give
candidates. Candidates go when an odd sketch of both sets proves that too much differs, or when
the similarity estimated from all registers, less the share that agrees by chance, is far
too low; every remaining candidate is decided on both full sets.

Copies collapse first: sets are equal when their 128-bit digests are, and only
the smallest id of each set goes on. Inside a bucket of a band, every
member is first held against one hub; only members that are then still in different
components are held against one another. So a group of mutual near-copies costs as
many comparisons as it has members, and no link between components is missed. Members of a large bucket are dealt into blocks, whose
pairs are compared in tasks of their own; the members compared with a much used hub are dealt out with a copy of its text each.

Sets are of 64-bit hashes of shingles: one false common shingle is to be expected in about 2**64 / (n_a * n_b) compared pairs, and a wrong decision
needs it to fall on the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexflow.llm.common import WordHashes, Workspace, arrow_map, as_bytes, gram_hashes, mix, text_slices
from indexflow.llm.components import components

MANTISSA = 10
#: Words of 64 bits in an odd sketch.
ODD = 32
#: Bits of the filter by which texts are fetched, at most; it is broadcast, at 16 bytes for 64 bits.
FILTER_BITS = 1 << 25
#: Members of a bucket in a block, and texts that are held against one copy of another.
BLOCK, PER_COPY = 4096, 512
#: Tasks over which the members of a large bucket are spread at least.
SALTS = 16
EMPTY = 0xFFFF
TOP = 62


def shingle_sets(texts: list[bytes | None], k: int, memo: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z count as a-z, words end at ASCII white space.

    Fewer than k words make one shingle; a null text or one without words has none.
    """
    split = [t.lower().split() if t else [] for t in texts]
    flat = memo.of([w for words in split for w in words])
    grams, at, out = gram_hashes(flat, k), 0, []
    for words in split:
        n = len(words)
        h = grams[at : at + n - k + 1] if n >= k else gram_hashes(flat[at : at + n], n) if n else grams[:0]
        out.append(np.unique(h))
        at += n
    return out


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Bits that say whether an odd number of a set's hashes fall on them, as ODD words a set.

    Two sets differ in at least as many elements as their sketches differ in bits.
    """
    bits = np.empty((len(sets), 64 * ODD), dtype=np.uint8)
    for row, s in zip(bits, sets, strict=True):
        row[:] = np.bincount((s >> np.uint64(7)).view(np.int64) & (64 * ODD - 1), minlength=64 * ODD) & 1
    return np.packbits(bits, axis=1).view(np.int64)


def may_link(percent: int) -> str:
    """SQL for whether the sets of a row's sides a and b may be similar enough, by size and by what differs at least."""
    differ = " + ".join(f"bit_count(odd_a.o{i} ^ odd_b.o{i})" for i in range(ODD))
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {100 + percent} * ({differ}) <= {100 - percent} * (n_a + n_b)"


@lru_cache
def borrow_order(m: int) -> np.ndarray:
    """For each bucket the order in which it looks at others when it is empty."""
    keys = mix(np.arange(m * m, dtype=np.uint64) + np.uint64(0x51ED2701)).reshape(m, m)
    return np.argsort(keys, axis=1)


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Compressed registers, one row a set; a row of an empty set is all EMPTY."""
    out = np.full((len(sets), m), EMPTY, dtype=np.uint16)
    if not any(map(len, sets)):
        return out
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    with np.errstate(over="ignore"):
        bucket = (((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        rest = h * np.uint64(m)
    cell = doc * m + bucket  # rising, as are the fractions inside a bucket
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    rest, cell = rest[first], cell[first]
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], TOP).astype(np.uint64)
    with np.errstate(over="ignore"):
        mantissa = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out.reshape(-1)[cell] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    own = out.copy()
    rows, cols = np.nonzero((own == EMPTY) & (own != EMPTY).any(axis=1)[:, None])
    order = borrow_order(m)
    for t in range(m):
        if not len(rows):
            break
        lent = own[rows, order[cols, t]]
        got = lent != EMPTY
        out[rows[got], cols[got]] = lent[got]
        rows, cols = rows[~got], cols[~got]
    return out


@lru_cache(4096)
def chance(log_a: int, log_b: int, m: int) -> float:
    """The share of registers on which disjoint sets of about 2**(log/4) shingles agree by chance."""
    a, b = (max(1.0, 2 ** (x / 4) / m) for x in (log_a, log_b))
    total = 0.0
    for z in range(TOP):
        edges = (1 + np.arange((1 << MANTISSA) + 1) / (1 << MANTISSA)) * 2.0 ** -(z + 1)
        below = [-np.expm1(n * np.log1p(-np.minimum(edges, 1 - 1e-16))) for n in (a, b)]
        total += float((np.diff(below[0]) * np.diff(below[1])).sum())
        if below[0][0] < 1e-6 and below[1][0] < 1e-6:
            break
    return total


def estimate(a: bytes, b: bytes, n_a: int, n_b: int) -> float:
    """Jaccard similarity from registers, corrected for collisions."""
    x, y = np.frombuffer(a, dtype=np.uint16), np.frombuffer(b, dtype=np.uint16)
    c = chance(round(4 * np.log2(max(1, n_a))), round(4 * np.log2(max(1, n_b))), len(x))
    return max(0.0, (float((x == y).mean()) - c) / (1 - c))


def band_keys(regs: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each row of registers."""
    n, m = regs.shape
    rows = m // bands
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    cut = regs[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    for i in range(rows):
        keys = mix(keys ^ cut[:, :, i] + np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 6, name: str = "minhash") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Links are pairs with 100 * shared shingles >= ``percent`` * all shingles. component_id is the smallest id
    reachable by links; kept marks the row whose id that is. ``bands`` of ``rows`` registers miss a pair
    at similarity s with a probability of (1 - s**rows)**bands: 2e-7 at 0.85 and 6e-5 at 0.8 for the defaults.

    Null, empty and wordless texts have n_shingles 0 and are their own component. Repeated rows are kept
    as rows of one group. A null id is carried along and has a null component only if all copies of its text have null ids.
    Other columns of ``docs``, whatever their names, are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, name)
    m = bands * rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    fields = [f"o{i}" for i in range(ODD)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            for lo, hi in text_slices(col):
                sets = shingle_sets(as_bytes(col.slice(lo, hi - lo)), k, memo)
                regs = registers(sets, m)
                odd = odd_sketches(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)], pa.binary()), pa.StructArray.from_arrays([pa.array(odd[:, i]) for i in range(ODD)], fields)],
                    ["id", "n", "digest", "regs", "odd"],
                )

    sigs = ws.save(texts.transform(arrow_map, sketch, f"id long, n long, digest binary, regs binary, odd struct<{', '.join(f'{o}: long' for o in fields)}>"), "sketches")
    classes = sigs.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.first("regs").alias("regs"), F.first("odd").alias("odd"))
    reps = ws.save(classes.where("rep is not null").select("rep", "digest", "n", "regs", "odd"), "classes")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, m), bands)
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys.reshape(-1), pa.int64())], ["rep", "band"])

    keys = reps.select("rep", "regs").transform(arrow_map, banded, "rep long, band long")
    hubs = keys.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("band", "hub")
    shared = ws.save(keys.join(hubs, "band"), "buckets")
    cands = ws.save(shared.select(F.col("rep").alias("id")).distinct(), "candidates")
    wanted = IdFilter(cands, "id", ws)
    sketches = ws.save(wanted.among(reps.select(F.col("rep").alias("id"), "n", "regs", "odd")), "candidate-sketches")
    bodies = ws.save(wanted.among(texts), "texts")

    stars = shared.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = ws.save(confirm(likely(stars, sketches, percent, m), bodies, k, percent, ws), "links")
    found = components(links, ws)
    placed = shared.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("band", "rep", "hub", F.coalesce("component", "rep").alias("component"))
    split = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    # every member was held against the hub already
    open_ = ws.save(placed.join(split, "band", "left_semi").where("rep != hub").select("band", "rep", "component"), "open")
    large = ws.save(open_.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "large")
    if large.isEmpty():
        members = open_.withColumn("blocks", F.lit(1))
    else:  # a bucket's members are spread over salts to learn its number of blocks
        salts = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = open_.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
        members = salted.join(salts, ["band", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "rep"), "blocks").cast("int"))
    members = members.join(sketches.select(F.col("id").alias("rep"), "n", "odd"), "rep")
    side = lambda c: [F.col(x).alias(f"{y}_{c}") for x, y in (("rep", "rep"), ("component", "c"), ("n", "n"), ("odd", "odd"))]
    x = members.select("band", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), *side("a"))
    y = members.select("band", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), *side("b"))
    across = x.join(y, ["band", "i", "j"]).where(f"(i < j or rep_a < rep_b) and c_a != c_b and {may_link(percent)}").select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    across = across.distinct().join(stars, ["a", "b"], "left_anti")
    more = ws.save(confirm(likely(across, sketches, percent, m), bodies, k, percent, ws), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more), ws)

    group = ws.save(reps.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "groups")
    ws.clear(sigs, group)
    out = sigs.join(group, "digest", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


class IdFilter:
    """Tells most rows whose id isn't among ``ids`` before a join, so that the join needn't shuffle them.

    A bit for each hash of an id, in words of 64, goes to all tasks. Their number follows the ids up to FILTER_BITS
    and no further, which bounds the broadcast; with very many ids the filter tells fewer rows apart.
    """

    def __init__(self, ids: DataFrame, id_col: str, ws: Workspace):
        self.ids, self.id_col = ids, id_col
        self.bits = min(FILTER_BITS, 1 << (16 * max(64, ids.count())).bit_length())
        self.words = ws.save(ids.groupBy(F.floor(self._at / 64).alias("__word")).agg(F.bit_or(self._bit).alias("__mask")), "filter")

    @property
    def _at(self) -> Column:
        return F.pmod(F.xxhash64(self.id_col), F.lit(self.bits))

    @property
    def _bit(self) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (self._at % 64).cast("int"))

    def mark(self, rows: DataFrame) -> DataFrame:
        """``rows`` with __maybe: false where the id surely isn't among the ids."""
        met = rows.withColumn("__word", F.floor(self._at / 64)).join(F.broadcast(self.words), "__word", "left")
        return met.withColumn("__maybe", F.coalesce(F.col("__mask").bitwiseAND(self._bit) != 0, F.lit(False)))

    def among(self, rows: DataFrame) -> DataFrame:
        """The rows whose id is among the ids."""
        return self.mark(rows).where("__maybe").select(rows.columns).join(self.ids.select(self.id_col).hint("merge"), self.id_col, "left_semi").select(rows.columns)

    def without(self, rows: DataFrame) -> DataFrame:
        """The rows whose id isn't among the ids, those with a null id too."""
        marked = self.mark(rows)
        rest = marked.where("__maybe").select(rows.columns).join(self.ids.select(self.id_col).hint("merge"), self.id_col, "left_anti")
        return marked.where("not __maybe").select(rows.columns).unionByName(rest.select(rows.columns))


def likely(pairs: DataFrame, sketches: DataFrame, percent: int, m: int) -> DataFrame:
    """The pairs whose estimated similarity is within six standard deviations of the threshold or above."""
    s = percent / 100
    least = s - 6 * (s * (1 - s) / m) ** 0.5

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, r_a, r_b = (batch.column(i).to_pylist() for i in range(6))
            mask = [estimate(p, q, x, y) >= least for x, y, p, q in zip(n_a, n_b, r_a, r_b, strict=True)]
            kept = [i for i, ok in enumerate(mask) if ok]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], ["a", "b"])

    side = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"r_{c}"), F.col("odd").alias(f"odd_{c}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").where(may_link(percent))
    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").transform(arrow_map, keep, "a long, b long")


def confirm(pairs: DataFrame, bodies: DataFrame, k: int, percent: int, ws: Workspace) -> DataFrame:
    """The pairs that are links, decided on the full sets of both texts.

    Texts b of a much used text a are dealt out by salts, each with a copy of a's; inside a task that copy comes first.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, kept = WordHashes(), None, []
        for batch in batches:
            a, salt, b, col = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            out: tuple[list[int], list[int]] = ([], [])
            for lo, hi in text_slices(col):
                for i, own in zip(range(lo, hi), shingle_sets(as_bytes(col.slice(lo, hi - lo)), k, memo), strict=True):
                    if (a[i], salt[i]) != last:
                        last, kept = (a[i], salt[i]), []
                    if b[i] is None:
                        kept.append(own)
                        continue
                    for x in kept:
                        every = len(np.unique(np.concatenate((x, own))))
                        if 100 * (len(x) + len(own) - every) >= percent * every > 0:
                            out[0].append(a[i])
                            out[1].append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    pairs = ws.save(pairs, "pairs")
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_COPY).cast("int").alias("copies"))
    text = lambda c: bodies.select(F.col("id").alias(c), "text").hint("merge")
    firsts = copies.join(text("a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1))).cast("int")
    others = pairs.join(copies.where("copies > 1"), "a", "left").select("a", salt.alias("salt"), "b").join(text("b"), "b").select("a", "salt", "b", "text")
    dealt = firsts.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.transform(arrow_map, check, "a long, b long")
