import random

import numpy as np
import pytest

from indexflow.llm import minhash
from indexflow.llm.common import Workspace, WordHashes
from indexflow.llm.components import components

SCHEMA = "doc_id long, text string, id string, n string"


def brute(rows, k, percent):
    """Groups by comparing all sets, as sets of words."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    ids = [r[0] for r in rows]
    group = {i: i for i in ids}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = find(ids[i]), find(ids[j])
                group[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in zip(ids, sets, strict=True))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=4)) for _ in range(300)]
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 7, 30, 120]))
        for _ in range(rng.choice([1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy).title() if g % 3 == 0 else " \t".join(copy))
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, k, percent):
    rows = corpus(k) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "ONE"), (1005, "x y " * 5000), (1006, "x y " * 5000)]
    df = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], SCHEMA)
    assert sorted(tuple(r) for r in minhash.near_groups(df, k=k, percent=percent).collect()) == brute(rows, k, percent)


def test_large_buckets_and_much_used_texts(spark, monkeypatch):
    """Blocks of buckets and copies of texts change nothing: few bands make buckets of texts that are no copies."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "PER_COPY", 2)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 9, 14])):
            own[rng.randrange(60)] = f"v{rng.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)
    assert sorted(tuple(r) for r in minhash.near_groups(df, k=3, percent=85, bands=64, rows=1).collect()) == brute(rows, 3, 85)


def test_empty_tables_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert minhash.near_groups(df).count() == 0
    df = spark.createDataFrame([(5, "a b c d e f", "", ""), (5, "a b c d e f", "", ""), (None, "a b c d e f", "", ""), (None, "lonely words of a text here", "", ""), (2, None, "", "")], SCHEMA)
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_groups(df).collect())
    assert got == [("2", "2", True), ("5", "5", True), ("5", "5", True), ("None", "5", True), ("None", "None", True)]


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64)) for _ in range(2))
    r = minhash.registers([a, b, np.unique(np.concatenate((a, b[:500]))), a[:0]], 512)
    assert minhash.estimate(r[0].tobytes(), r[1].tobytes(), 2000, 2000) < 0.02
    assert abs(minhash.estimate(r[0].tobytes(), r[2].tobytes(), 2000, 2500) - 0.8) < 0.08
    assert minhash.estimate(r[0].tobytes(), r[0].tobytes(), 2000, 2000) == 1
    assert (r[3] == minhash.EMPTY).all()


def test_odd_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 100, 5000):
        a = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: 400 - n // 50], rng.integers(0, 2**64, n, dtype=np.uint64))))
        x, y = minhash.odd_sketches([a, b])
        assert sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y) <= len(np.setxor1d(a, b))


def test_short_sets_borrow_registers():
    s = minhash.shingle_sets([b"a b c", b"A  b\tc", b"", None, b"a"], 3, WordHashes())
    assert (s[0] == s[1]).all() and [len(x) for x in s] == [1, 1, 0, 0, 1]
    r = minhash.registers(s, 64)
    assert (r[0] == r[1]).all() and (r[0] != minhash.EMPTY).all()


def test_components_of_paths_loops_and_nothing(spark):
    ws = Workspace(spark, "test")
    links = [(i, i + 1) for i in range(50, 0, -1)] + [(100, 90), (90, 100), (7, 7), (None, 3), (200, 300)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long"), ws).collect())
    assert got == {i: 1 for i in range(1, 52)} | {90: 90, 100: 90, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long"), ws).count() == 0


def test_id_filter_splits_rows_exactly(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(2000)] + [(None, "n"), (7, "again")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 2000, 7)], "doc_id long")
    for most in (1 << 25, 64):  # a filter with room, and one in which every bit is set
        monkeypatch.setattr(minhash, "FILTER_BITS", most)
        f = minhash.IdFilter(ids, "doc_id", Workspace(spark, "filter"))
        among, without = ([r["doc_id"] for r in part.collect()] for part in (f.among(rows), f.without(rows)))
        assert sorted(among) == sorted([*range(0, 2000, 7), 7]) and None in without and len(among) + len(without) == 2002
    assert minhash.IdFilter(ids.limit(0), "doc_id", Workspace(spark, "filter")).without(rows).count() == 2002
