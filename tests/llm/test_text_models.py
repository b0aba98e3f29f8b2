import random

import numpy as np
import pytest

from indexflow.llm import langid, quality

WORDS = {"en": "the and of to in is that with thing house water".split(), "de": "der die das und nicht mit zu haus wasser größe".split(), "fr": "le la les et que dans avec maison été garçon".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    rows = [(text(rng, lang, 40), lang) for lang in WORDS for _ in range(20)] + [(None, "en"), ("words without a label", None), ("", "de")]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_languages_are_told_apart(spark, model):
    rng = random.Random(1)
    assert model["langs"] == ["de", "en", "fr"]
    rows = [(i, lang, text(rng, lang, rng.choice([3, 30, 300]))) for i, lang in enumerate(list(WORDS) * 20)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, lang string, text string"), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got) and all(0 <= r["score"] <= 1 for r in got)


def test_mixtures_have_several_languages(spark, model):
    rng = random.Random(2)
    mixed = text(rng, "en", 150) + "\n" + text(rng, "fr", 50)
    (r,) = langid.identify(spark.createDataFrame([(mixed,)], "text string"), model).collect()
    assert [x["lang"] for x in r["langs"]] == ["en", "fr"] and abs(r["score"] - 0.75) < 0.08
    pi, best, n = langid.Mixture(model).infer([text(rng, "de", 400)])
    assert (pi[0] > 0).sum() == 1 and best[0] == 0 and n[0] == 400


def test_a_small_part_of_a_long_text_is_a_language(model):
    rng = random.Random(6)
    pi, best, n = langid.Mixture(model).infer([text(rng, "en", 19900) + " " + text(rng, "fr", 100)])
    assert best[0] == 1 and (pi[0] > 0).tolist() == [False, True, True] and abs(pi[0, 2] * n[0] - 100) < 40


def test_a_single_language_em_is_the_likelihood(model):
    """EM over one document's words finds the proportions that a grid search finds."""
    rng = random.Random(3)
    m = langid.Mixture(model, rounds=200)
    words = langid.words_of(text(rng, "en", 30) + " " + text(rng, "de", 10))
    logs = m.likelihoods(words)[:, :2].astype(np.float64)
    like = np.exp(logs - logs.max(axis=1, keepdims=True))
    grid = np.linspace(0, 1, 2001)
    best = grid[np.argmax([np.log(like @ np.array([p, 1 - p]) + 1e-300).sum() for p in grid])]
    full = np.exp(m.likelihoods(words) - m.likelihoods(words).max(axis=1, keepdims=True))
    pi, _ = m.fit(full, np.array([0]), np.array([len(words)]), np.array([[1.0, 1.0, 0.0]]))
    assert abs(pi[0, 0] - best) < 2e-3


def test_odd_texts_and_empty_models(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "δοκιμή"), (5, "THE WATER"), (6, "the " * 30000), (6, "the " * 30000)]
    df = spark.createDataFrame([(i, t, "en", 0.5) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.identify(df, model).collect())
    assert [x for x in got if x[0] != 4] == [(1, "und"), (2, "und"), (3, "und"), (5, "en"), (6, "en"), (6, "en")] and dict(got)[4] in model["langs"]
    none = langid.train(df.limit(0).withColumnRenamed("lang_pred", "lang"))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_held_out_rows(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    for r in df.select("doc_id", langid.held_out().alias("h")).collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def graded(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(WORDS["en"] + WORDS["de"]) for _ in range(rng.choice([20, 200]))]
        kind = rng.choice(["clean", "clean", "rude", "junk"])
        if kind == "rude":
            words[:4] = rng.sample(["idiot", "moron", "scum", "trash", "loser"], 4)
        if kind == "junk":
            words = [w.upper() + "!!" for w in words]
        out.append((" ".join(words), {"clean": 2, "rude": 1, "junk": 0}[kind]))
    return out


def rated(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)], "doc_id long, text string, grade string")
    return docs, spark.createDataFrame([(i, g) for i, (_, g) in enumerate(rows)], "doc_id long, grade int")


def test_grades_of_held_out_texts(spark):
    model = quality.train(*rated(spark, graded(600, 1)))
    assert model.cuts[0] < model.cuts[1]
    test = graded(200, 2)
    rows = quality.score(spark.createDataFrame([(t, g) for t, g in test], "text string, grade int"), model).collect()
    guess = [int(np.sum(np.array(r["tails"]) >= 0.5)) for r in rows]
    assert np.mean([g == r["grade"] for g, r in zip(guess, rows, strict=True)]) > 0.95
    assert all(r["tails"][0] >= r["tails"][1] and abs(sum(r["tails"]) - r["expected_grade"]) < 1e-9 for r in rows)


def test_beginnings_of_words_carry_over():
    """A rude word not seen before is known by its beginning."""
    rng, f = random.Random(8), quality.Features()
    end = lambda: "".join(rng.choices("abcdefghij", k=4))
    rows = [(" ".join(rng.choices(WORDS["de"], k=40)) + (f" vequ{end()} lowei{end()}" if i % 4 == 0 else f" stud{end()} plane{end()}"), 0 if i % 4 == 0 else 1) for i in range(1200)]
    model = quality.fit([f.of(t.encode()) for t, _ in rows[:800]], np.array([g for _, g in rows[:800]]), 2)
    tails = model.tails([f.of(t.encode()) for t, _ in rows[800:]])[:, 0]
    assert np.mean((tails >= 0.5) == np.array([g == 1 for _, g in rows[800:]])) > 0.99


def test_slopes_equal_finite_differences():
    rng = np.random.default_rng(2)
    x = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(40)]
    y, w = rng.integers(0, 4, 40), rng.normal(0, 0.5, 1 << quality.BITS)
    first, steps = -0.7, np.array([-0.2, 0.4])

    def brute(w, first, steps):
        cuts = first + np.concatenate(([0], np.cumsum(np.exp(steps))))
        total = 0.0
        for f, g in zip(x, y, strict=True):
            up = [1.0, *(1 / (1 + np.exp(c - sum(w[i] for i in f))) for c in cuts), 0.0]
            total += np.log(up[g] - up[g + 1])
        return total / len(y)

    value, at, g, gc = quality.slopes(w, first, steps, x, y)
    assert abs(value - brute(w, first, steps)) < 1e-9
    e = 1e-6
    for i, s in list(zip(at, g, strict=True))[:8]:
        up, down = w.copy(), w.copy()
        up[i], down[i] = w[i] + e, w[i] - e
        assert abs((brute(up, first, steps) - brute(down, first, steps)) / (2 * e) - s) < 1e-6
    moves = [(brute(w, first + e, steps) - brute(w, first - e, steps)) / (2 * e), *((brute(w, first, steps + e * u) - brute(w, first, steps - e * u)) / (2 * e) for u in np.eye(2))]
    assert np.allclose(moves, gc, atol=1e-6)


def test_fits_of_few_grades():
    f = quality.Features()
    x, y = zip(*((f.of(t.encode()), g) for t, g in graded(300, 3)), strict=True)
    def logp(m):
        p = np.hstack([np.ones((len(x), 1)), m.tails(list(x)), np.zeros((len(x), 1))])
        return np.log(np.maximum(p[np.arange(len(x)), y] - p[np.arange(len(x)), np.array(y) + 1], 1e-12)).sum()
    early, late = (quality.fit(list(x), np.array(y), epochs=n) for n in (0, 20))
    assert logp(late) > logp(early) + 50
    one = quality.fit(list(x), np.zeros(len(x), dtype=int))
    assert not one.weights.any() and (one.tails(list(x)) < 0.01).all()
    two = quality.fit(list(x), np.minimum(np.array(y), 1))  # the top grade never occurs
    assert len(two.cuts) == 2 and (two.tails(list(x))[:, -1] < 0.5).all()


def test_odd_texts_and_ratings(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a " * 50000, 0), (3, "a " * 50000, 0), (None, "b", 0)], "doc_id long, text string, tails int")
    for ratings in ([], [(9, 1)], [(1, 2)], [(None, 1), (3, None), (3, 7), (3, -1)]):
        model = quality.train(df, spark.createDataFrame(ratings, "doc_id long, grade int"))
        rows = quality.score(df, model).collect()
        assert len(rows) == 5 and all(list(r["tails"]) == [0.0, 0.0] and r["expected_grade"] == 0 for r in rows)
    assert quality.score(df.limit(0), model).count() == 0
    model = quality.train(df, spark.createDataFrame([(3, 2), (3, 0)], "doc_id long, grade int"))  # the lowest counts
    assert quality.score(df, model).where("tails[0] > 0.5").count() == 0
    assert max(map(len, quality.Features().known), default=0) <= quality.MEMO_BYTES
    wide = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(60)]
    small = quality.train(spark.createDataFrame(wide, "doc_id long, text string"), spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, grade int"), sample_bytes=2000)
    assert 0 < np.count_nonzero(small.weights) < 1000
