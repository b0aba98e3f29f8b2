import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from indexflow.llm import bpe, decontaminate, shard

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "hello world", "it's   the\n\n end ", "x" * 3000, " " * 300, "日本語 テスト 😀", "<|endoftext|> a<|endoftext|>", "a\x1cb\x85c\u200bd\u3000e", "é̂ Ǆ ²Ⅷ٣", "\r\n\t x", "don't WE'LL '''s", "\x00\ufeff"]


def library(texts):
    t = Tokenizer.from_file(PATH)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def test_ids_and_texts_equal_the_library():
    rng = random.Random(0)
    alphabet = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "\x1c", "\x85", "\u3000", "<|endoftext|>", "<|endof", "'s", "'ll", "!!", "日", "😀", "\u0301"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    codec = bpe.Codec(bpe.load_vocabulary(PATH))
    ids, decoded = library(texts)
    own = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in own] == ids
    assert codec.decode(own) == decoded
    broken = np.array([ids[8][0] if ids[8] else 0, 50256, 447, 9_999_999], dtype="<u4").tobytes()
    assert codec.decode([broken])[0].encode("utf-8")


def test_long_unbroken_words_equal_the_library():
    rng = random.Random(5)
    texts = ["".join(rng.choices(letters, k=60_000)) for letters in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "etaoin", "ab", "a", "éüaen", "0123456789+/", "日本語")]
    codec = bpe.Codec(bpe.load_vocabulary(PATH))
    assert codec.bounded
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == library(texts)[0]
    assert max(map(len, codec.known)) <= bpe.MEMO_CHARS >= max(map(len, codec.words))


def greedy(word, ranks):
    word = list(word)
    while found := [(ranks[p], -i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in ranks]:
        r, i = min(found, key=lambda x: (x[0], -x[1]))
        word[-i : -i + 2] = [ranks["made"][r]]
    return word


@pytest.mark.parametrize("order", ["trained", "shuffled", "ambiguous"])
def test_merge_rounds_equal_greedy_merging(order):
    rng = random.Random(order)
    for _ in range(60):
        letters = rng.randint(2, 4)
        pairs, n = [], letters
        while len(pairs) < 25:
            p = rng.randrange(n), rng.randrange(n)
            if p not in pairs:
                pairs.append(p)
                n += 1
        made = list(range(letters, n))
        if order == "ambiguous":
            made = [m if rng.random() < 0.8 else letters for m in made]
        joined = list(zip(pairs, made, strict=True))
        if order == "shuffled":
            rng.shuffle(joined)
        left, right, out = (np.array(x, dtype=np.int64) for x in zip(*((a, b, m) for (a, b), m in joined), strict=True))
        codec = bpe.Codec({"bytes": np.arange(256), "made": out, "tokens": [b"x"] * n, "added": {}} | bpe.pair_table(left, right, out, n))
        assert codec.bounded or order != "trained"
        words = [bytes(rng.choices(range(letters), k=rng.randint(1, 60))) for _ in range(30)]
        table = {p: i for i, (p, _) in enumerate(joined)} | {"made": out.tolist()}
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.merge(words)] == [greedy(w, table) for w in words]


def test_memory_starts_afresh(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_UNITS", 5)
    codec = bpe.Codec(bpe.load_vocabulary(PATH))
    for texts in (TEXTS[:7], TEXTS[7:], TEXTS):
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == library(texts)[0]


def test_tables(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS + TEXTS[:4])], "doc_id long, text string, ids int")
    want = library(TEXTS + TEXTS[:4])
    coded = bpe.encode(df, PATH, check_col="ok")
    got = sorted(bpe.decode(coded, PATH).collect(), key=lambda r: r["doc_id"])
    assert [list(r["ids"]) for r in got] == want[0] and [r["decoded"] for r in got] == want[1] and all(r["ok"] for r in got)
    digests = sorted(bpe.round_trip(df, PATH).collect())
    assert [r["n_tokens"] for r in digests] == [len(x) for x in want[0]]
    assert bpe.encode(df.limit(0), PATH).count() == 0 and bpe.round_trip(df.limit(0), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [464])], "i int, ids array<int>"), PATH).collect()[0]["decoded"] == ""


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) >= 0x80 else " " for c in text or "").split(" ")


def brute(docs, items, n=8):
    out = {}
    cut = lambda t: [w for w in words(t) if w]
    for i, text in docs:
        w, hit, found = cut(text), set(), set()
        for item, body in items:
            b = cut(body)
            m = min(n, len(b))
            windows = {tuple(b[p : p + m]) for p in range(len(b) - m + 1)} if m else set()
            for p in range(len(w) - m + 1 if m else 0):
                if tuple(w[p : p + m]) in windows:
                    hit |= set(range(p, p + m))
                    found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found, key=str.encode))
    return out


def leak_tables(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ü", "É9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 7, 8, 9, 30])))) for i in range(12)] + [(12, None), (13, ""), (14, "-"), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.choice([0, 5, 40, 120]))
        if i % 3 == 0 and w:
            b = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(b) + 1)
            w[5:5] = b[a : a + rng.choice([4, 7, 8, 20])]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper() if i % 5 == 0 else " ".join(w)))
    return docs + [(100, None), (101, ""), (102, "w1 " * 30000)], items


@pytest.mark.parametrize("filter_bits", [1 << 27, 64])
def test_overlaps_equal_brute_force(spark, filter_bits):
    docs, items = leak_tables(1)
    d = spark.createDataFrame([(i, t, 0, "c") for i, t in docs], "doc_id long, text string, n_words int, item string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(d, b, filter_bits=filter_bits).withColumn("n_hit", decontaminate.hit_words()).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["hit_items"])) for r in got} == brute(docs, items)
    for r in got:
        ends = [(s["start"], s["end"]) for s in r["hit_spans"]]
        assert ends == sorted(ends) and all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_overlaps_of_empty_tables_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a b c")] * 2, "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [list(r["hit_items"]) for r in decontaminate.overlaps(d, b).collect()] == [[], []]
    assert decontaminate.overlaps(d.limit(0), b).count() == 0


def test_winnowing_keeps_a_fingerprint_of_every_window():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 6, 500).astype(np.uint64)  # many ties
    kept = decontaminate.winnow(g, 4)
    for p in range(len(g) - 3):
        window = g[p : p + 4]
        assert p + 3 - int(window[::-1].argmin()) in kept
    assert len(decontaminate.winnow(g[:3], 4)) == 0


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_definition():
    rng = random.Random(0)
    keys = [rng.getrandbits(64) for _ in range(300)] + [0, (1 << 64) - 1]
    for n in (1, 2, 40, 41, 1000):
        assert shard.jump(np.array(keys, dtype=np.uint64), n).tolist() == [plain_jump(k, n) for k in keys]
    with pytest.raises(ValueError):
        shard.jump(np.array([1], dtype=np.uint64), 0)


def test_places_are_gapless_and_stable(spark, tmp_path):
    rows = [(i, "t" * (i % 7)) for i in range(3000)] + [(5, "same"), (5, "same"), (None, None), (None, None), (9, None), (8, "é" * 40000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, size string").repartition(7)
    got = shard.place(df, 40).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 9} == {(16, 0), (16 + 2, __import__("zlib").crc32(b"tt"))}
    assert {r["doc_id"]: r["shard"] for r in shard.place(df.repartition(3), 40).collect()} == {r["doc_id"]: r["shard"] for r in got}
    assert shard.place(df.limit(0), 40).count() == 0
    shard.write_shards(df, 40, f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == len(rows) and {(r["doc_id"], r["shard"]) for r in back.select("doc_id", "shard").collect()} == {(r["doc_id"], r["shard"]) for r in got}
