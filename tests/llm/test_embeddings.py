import numpy as np
import pytest

from indexflow.llm import embeddings


def brute(rows, threshold):
    import collections

    units = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v) / np.max(np.abs(v))
            units[i] = u / np.sqrt(u @ u)
    group = {r[0]: r[0] for r in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    n = collections.Counter()
    for i in units:
        for j in units:
            if i < j and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = find(rows[i][0]), find(rows[j][0])
                group[max(a, b)] = min(a, b)
    return sorted((r[0], n[i], find(r[0]), find(r[0]) == r[0]) for i, r in enumerate(rows))


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(25):
        base = rng.standard_normal(16)
        for _ in range(int(rng.choice([1, 4, 12]))):
            rows.append((base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2, 0.5])).tolist())
    rows = [(i * 2, v, int(rng.integers(0, 2))) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [1e300] * 16, [1.0] * 16, [2.0] * 3, [2.0] * 3]
    return rows + [(1001 + i, v, 0) for i, v in enumerate(odd)] + [(2000, [1.0] * 16, None)]


@pytest.mark.parametrize(("per_cell", "block"), [(2048, 2048), (6, 5)])
def test_links_equal_brute_force(spark, per_cell, block):
    rows = vectors()
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<double>, label int, seen string")
    got = embeddings.near_groups(df, per_cell=per_cell, block=block, recall=1.0).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 0.93)


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8))
    index = embeddings.MultiIndex(x, 6)
    d1, d2 = (embeddings.distances(h, b) for h, b in zip(index.halves(x), index.books, strict=True))
    sums = (d1[:, :, None] + d2[:, None, :]).reshape(len(x), -1)
    for t in (1, 5, 36):
        seen = index.traverse(x, t)
        assert np.allclose(np.take_along_axis(sums, seen, 1), np.sort(sums, axis=1)[:, :t])


def test_recall_of_the_calibrated_index(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((150, 24))
    rows = [(i, (base[i % 150] + 0.08 * rng.standard_normal(24)).tolist(), 1) for i in range(900)]
    got = embeddings.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), per_cell=20, sample_rows=300)
    want = brute([(i, np.float32(v).astype(float).tolist(), label) for i, v, label in rows], 0.93)
    assert got.selectExpr("sum(n_links)").first()[0] >= 0.98 * sum(w[1] for w in want)


def test_empty_table(spark):
    assert embeddings.near_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_ranks_are_found_among_all_cells():
    x = np.random.default_rng(5).standard_normal((2000, 8))
    x /= np.sqrt((x * x).sum(1))[:, None]
    index = embeddings.MultiIndex(x, 80)
    some = x[:40]
    every, own = index.traverse(some, 80**2), index.traverse(-some, 1)
    want = (every == own).argmax(axis=1)
    assert want.max() > 4096 and index.ranks(some, -some).tolist() == want.tolist()
