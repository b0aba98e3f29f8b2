"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of all words of a batch that are not known yet lie in one flat array.
A round looks adjacent pairs up by binary search over the sorted pair keys of the
vocabulary, finds each word's lowest rank, and merges that pair wherever it stands in the word, and with it every
pair that no later merge of lower rank can reach; words without a pair leave. So long words take few rounds
too. Short units are remembered up to a fixed number. Vocabulary files are read on the driver
from a path that is a parameter, and reach the executors as arrays whose size is that of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexflow.llm.common import arrow_map, text_slices

#: White space as Unicode's White_Space property has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A space that can't be taken as the end of a unit: white space on both sides, or before it at the end.
TIED = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)")
#: Units of text whose ids a Python worker remembers before it starts afresh, and characters of one at most.
MEMO_UNITS, MEMO_CHARS = 250_000, 100
#: Pairs over which a round looks from one that merges to others that could be merged after it.
SPREADS = 64
NONE = np.iinfo(np.int64).max


@lru_cache
def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Arrays of a byte-level BPE vocabulary file in the tokenizers library's JSON format.

    Only what this operator can reproduce is taken: no normaliser, no prefix space, added tokens that match anywhere.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens with conditions")
    chars, vocab = byte_chars(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for token, i in vocab.items():
        tokens[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
    for token, i in added.items():
        tokens[i] = token.encode()
    left, right = (np.array([vocab[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
    made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    return {"bytes": np.array([vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])], dtype=np.int64), "made": made, "tokens": tokens, "added": added} | pair_table(left, right, made, len(tokens))


def pair_table(left: np.ndarray, right: np.ndarray, made: np.ndarray, size: int) -> dict:
    """Sorted keys of pairs of symbols (x, y), the rank of merging x with y (NONE: they don't merge), and the lowest rank
    of a merge whose left symbol may end in x and whose right one may begin with y, which is the first that can take x and y together.

    ``ordered`` says that every merge has a higher rank than those that make its parts, as trained ones have. The lowest
    ranks need that and one merge only for each symbol; otherwise they are 0, that is, unknown.
    """
    rank = np.arange(len(made), dtype=np.int64)
    by = np.full(size + 1, -1, dtype=np.int64)
    by[made] = rank
    ordered = bool((np.maximum(by[left], by[right]) < rank).all())
    whole = ordered and len(np.unique(made)) == len(made)
    keys, ranks = [left << 32 | right], [rank]
    if whole:
        for x, i in spine(left, rank, by, right):
            for y, j in spine(right[i], i, by, left):
                keys.append(x[np.searchsorted(i, j)] << 32 | y)
                ranks.append(j)
    every = np.concatenate(keys)
    order = np.lexsort((np.concatenate(ranks), every))
    every, lows = every[order], np.concatenate(ranks)[order]
    first = np.flatnonzero(np.diff(every, prepend=-1))
    every, lows = every[first], lows[first] if whole else np.zeros(len(first), dtype=np.int64)
    own = np.full(len(every), NONE)
    back = rank[::-1]
    own[np.searchsorted(every, (left << 32 | right)[back])] = back
    return {"keys": every, "ranks": own, "least": lows, "ordered": ordered}


def spine(symbol: np.ndarray, merge: np.ndarray, by: np.ndarray, part: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Symbols and what they are made of at one end, ever smaller, each with the (rising) merges that it belongs to."""
    out = []
    while len(symbol):
        out.append((symbol, merge))
        deeper = by[symbol] >= 0
        symbol, merge = part[by[symbol[deeper]]], merge[deeper]
    return out


class Codec:
    """Encodes and decodes batches of whole texts."""

    def __init__(self, v: dict):
        self.v, self.known, self.words = v, {}, {}
        self.bounded = bool(len(v["least"]) and v["least"].any())
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in v["added"].items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.sizes = np.array([len(t) for t in v["tokens"]], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(v["tokens"]), dtype=np.uint8)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of merging each pair, and the lowest rank of a merge that can ever join its two sides."""
        v, key = self.v, left << 32 | right
        at = np.minimum(np.searchsorted(v["keys"], key), len(v["keys"]) - 1)
        hit = v["keys"][at] == key
        return np.where(hit, v["ranks"][at], NONE), np.where(hit, v["least"][at], NONE if self.bounded else 0)

    @staticmethod
    def earliest(rank: np.ndarray, low: np.ndarray) -> np.ndarray:
        """A lower bound on the rank at which each pair's sides are joined: by the pair itself, or after a merge beside it.

        It is spread from the pairs that merge now until nothing changes; where that takes too long ``low`` stands.
        """
        soon = rank
        for _ in range(SPREADS):
            beside = np.minimum(np.append(soon[1:], NONE), np.insert(soon[:-1], 0, NONE))
            new = np.minimum(rank, np.maximum(low, beside + (beside < NONE)))
            if (new == soon).all():
                return soon
            soon = new
        return low

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word; words are not empty.

        Besides the pairs of a word's lowest rank, a round merges those whose neighbours on both sides are joined by
        no merge of a lower or the same rank, now or later: nothing can take a side of such a pair before its turn.
        """
        v, out = self.v, [b""] * len(words)
        sym = v["bytes"][np.frombuffer(b"".join(words), dtype=np.uint8)]
        size = np.array([len(w) for w in words], dtype=np.int64)
        name = np.arange(len(words))
        rank, low = (np.append(x, NONE) for x in self.pairs(sym[:-1], sym[1:]))
        last = np.cumsum(size) - 1
        rank[last], low[last] = NONE, NONE
        while len(name):
            start = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, start)
            over = best == NONE
            if over.any():
                done = np.repeat(over, size)
                ids, ends = sym[done].astype("<u4").tobytes(), 4 * np.cumsum(size[over])
                for i, lo, hi in zip(name[over].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[i] = ids[lo:hi]
                left = ~over
                sym, rank, low, best, size, name = sym[~done], rank[~done], low[~done], best[left], size[left], name[left]
                if not len(name):
                    break
            word = np.repeat(np.arange(len(name)), size)
            soon = self.earliest(rank, low) if self.bounded else low
            safe = rank < np.append(soon[1:], NONE)
            safe[1:] &= rank[1:] < soon[:-1]
            pick = np.flatnonzero((rank == best[word]) | safe & (rank != NONE))
            if not v["ordered"]:  # a merge may make a pair that comes before the next one
                pick = pick[np.diff(word[pick], prepend=-1) > 0]
            run = np.flatnonzero(np.diff(pick, prepend=-2) != 1)  # of equal symbols the first, third ... pair merges
            pick = pick[(np.arange(len(pick)) - np.repeat(run, np.diff(run, append=len(pick)))) % 2 == 0]
            sym[pick] = v["made"][rank[pick]]
            rank[pick], low[pick] = rank[pick + 1], low[pick + 1]  # right for the last symbols of words; others follow below
            keep = np.ones(len(sym), dtype=bool)
            keep[pick + 1] = False
            at = pick - np.arange(len(pick))
            sym, rank, low = sym[keep], rank[keep], low[keep]
            size = size - np.bincount(word[pick], minlength=len(size))
            final = np.zeros(len(sym), dtype=bool)
            final[np.cumsum(size) - 1] = True
            fresh = np.unique(np.concatenate((at, at[at > 0] - 1)))
            fresh = fresh[~final[fresh]]
            rank[fresh], low[fresh] = self.pairs(sym[fresh], sym[fresh + 1])
        return out

    def units(self, text: str) -> list[str]:
        """Pieces of a text that encode on their own: cut before single spaces where no white space is tied to them."""
        if TIED.search(text):
            return WORD.findall(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]

    def learn(self, units: set[str]) -> None:
        """Remember the ids of new units."""
        pieces = {u: [u] if u.isalpha() and u.isascii() else WORD.findall(u) for u in units}
        fresh = list({p for ps in pieces.values() for p in ps if p not in self.words})
        if len(self.words) + len(fresh) > MEMO_UNITS:
            self.words.clear()
            fresh = list({p for ps in pieces.values() for p in ps})
        if fresh:
            self.words.update(zip(fresh, self.merge([p.encode() for p in fresh]), strict=True))
        known = self.words
        for u, ps in pieces.items():
            self.known[u] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; a null text has none. Strings of added tokens become their ids."""
        cut = []
        for t in texts:
            parts = [t or ""] if not self.split_added else self.split_added.split(t or "")
            units: list[str] = []
            for i, part in enumerate(parts):
                if i % 2:
                    units.append(part)
                elif part:
                    units += self.units(part)
            cut.append(units)
        need = set().union(*cut)
        need.difference_update(self.added)
        new = need.difference(self.known)
        if len(self.known) + len(new) > MEMO_UNITS:
            self.known.clear()
            new = need
        self.learn(new)
        self.known.update(self.added)
        get = self.known.__getitem__
        out = [b"".join(map(get, units)) for units in cut]
        for memo in (self.known, self.words) if any(len(u) > MEMO_CHARS for u in new) else ():
            for u in [u for u in memo if len(u) > MEMO_CHARS]:
                del memo[u]
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of ids; bytes that are not UTF-8 become U+FFFD. Ids outside the vocabulary stand for nothing."""
        flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
        flat = np.where(flat < len(self.sizes), flat, len(self.sizes))
        sizes, starts = np.append(self.sizes, 0)[flat], np.append(self.starts, 0)[flat]
        ends = np.cumsum(sizes)
        body = self.flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)].tobytes()
        cuts = np.concatenate(([0], ends))[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [body[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


def encode(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the token ids of every whole text in ``ids_col``, an array of ints.

    ``check_col`` names a further column that says whether decoding the ids gives the text again, found by decoding them
    in the same task, so that a text is held by one Python worker only.

    Null and empty texts have no ids; strings of added tokens in a text become those tokens. A column
    of that name is replaced. Rows and repeated rows are kept, and texts of any length are encoded whole.
    """
    v = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    made_cols = [ids_col] + ([check_col] if check_col else [])
    kept = [c for c in (keep or docs.columns) if c.lower() not in {m.lower() for m in made_cols}]
    out = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()), False)] + ([T.StructField(check_col, T.BooleanType(), False)] if check_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(v.value)
        for batch in batches:
            col = batch.column(len(kept))
            for lo, hi in text_slices(col):
                texts = col.slice(lo, hi - lo).to_pylist()
                ids = codec.encode(texts)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))]
                if check_col:
                    made.append(pa.array([a == (b or "") for a, b in zip(codec.decode(ids), texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(kept))), *made], [*kept, *made_cols])

    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias("__text")).transform(arrow_map, run, out)


def decode(tokens: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of every row's ids in ``text_col``; null ids give an empty text. A column of that name is replaced."""
    v = tokens.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    kept = [c for c in tokens.columns if c.lower() != text_col.lower()]
    out = T.StructType([tokens.schema[c] for c in kept] + [T.StructField(text_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(v.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                lists = part.column(len(kept)).cast(pa.list_(pa.int32()))
                flat, cuts = pc.fill_null(lists.values, -1).to_numpy().astype("<u4"), lists.offsets.to_numpy()
                ids = [b"" if null else flat[a:b].tobytes() for a, b, null in zip(cuts, cuts[1:], lists.is_null().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(codec.decode(ids), pa.string())], [*kept, text_col])

    return tokens.select(*(F.col(f"`{c}`") for c in kept), F.col(ids_col).alias("__ids")).transform(arrow_map, run, out)


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256 of the text's ids and of the text that they decode to.

    It is ``encode`` then ``decode``, with the digests taken where the ids are, so that only they travel.
    """
    v = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(v.value)
        for batch in batches:
            col = batch.column(1)
            for lo, hi in text_slices(col):
                ids = codec.encode(col.slice(lo, hi - lo).to_pylist())
                hexes = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (ids, (t.encode() for t in codec.decode(ids)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array(x, pa.string()) for x in hexes)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).transform(arrow_map, run, out)
