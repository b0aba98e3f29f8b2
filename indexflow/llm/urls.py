"""URL filtering by listed rules: a blocked Bloom filter before an exact hash join.

A rule is a host and the beginning of a path. A URL is asked about through every pair of a
suffix of its host and a beginning of its path, of numbers of labels and lengths that some rules have. Each such
key hashes to one block of 256 bits of the filter and to eight bits inside it. URLs without a key whose bits are all set
are judged where they are read; only the others go to the exact join with the rules, which removes false positives. The filter is part of
the plan, of a bounded size: with very many rules it tells fewer URLs apart, and the join decides all the same.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter per rule, of which eight are set.
BITS_PER_RULE = 24
WORDS = 4
#: Blocks of the filter at most: 2 MB.
MOST_BLOCKS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def _bits(key: Column, blocks: int) -> list[Column]:
    """The block of a key and the words of 64 bits, with two bits each, that its row must have."""
    h, g = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)
    one = F.lit(1).cast("long")
    shift = lambda i: (F.shiftrightunsigned(g, 6 * i).cast("long").bitwiseAND(F.lit(63))).cast("int")
    word = lambda i: F.call_function("shiftleft", one, shift(2 * i)).bitwiseOR(F.call_function("shiftleft", one, shift(2 * i + 1)))
    return [F.pmod(h, F.lit(blocks)).cast("int").alias("block"), *(word(i).alias(f"w{i}") for i in range(WORDS))]


def judge(urls: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row of ``urls``: id, host, path, rule and verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains when the URL's path starts with the rule's;
    the longest, host and path together, wins, then the one with the longer host, then the smaller verdict. Where none
    fits, rule is null and the verdict ``default``: the list says nothing about that URL. Null URLs and those without
    :// have an empty host and path. Repeated rows are judged one by one, repeated rules count once, rules with a null part
    not at all; other columns are not read. Empty tables give no rows, or the default throughout.
    Hosts and paths of any length are looked at whole.
    """
    listed = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host is not null and r_path is not null and r_verdict is not null").groupBy("r_host", "r_path").agg(F.min("r_verdict").alias("r_verdict"))
    labels = lambda host: F.size(F.split(host, r"\."))
    count, lengths, depths = listed.agg(F.count("*"), F.collect_set(F.length("r_path")), F.collect_set(labels("r_host"))).first()
    blocks = min(MOST_BLOCKS, max(1, -(-count * BITS_PER_RULE // (64 * WORDS))))
    key = lambda h, p: F.concat(h, F.lit("\n"), p)
    words = [f"w{i}" for i in range(WORDS)]
    made = listed.select(*_bits(key(F.col("r_host"), F.col("r_path")), blocks)).groupBy("block").agg(*(F.bit_or(w).alias(w) for w in words)).collect()
    filled = [0] * (WORDS * blocks)
    for r in made:
        filled[WORDS * r["block"] : WORDS * (r["block"] + 1)] = [r[w] for w in words]
    filter_ = F.from_json(F.lit(json.dumps(filled)), "array<bigint>")

    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    number = lambda xs: F.array(*(F.lit(x) for x in sorted(xs))) if xs else F.array().cast("array<int>")
    # a suffix of a host by its number of labels, so that a host of very many makes few keys
    suffixes = F.transform(F.filter(number(depths), lambda n: n <= labels("host")), lambda n: F.call_function("substring_index", "host", F.lit("."), -n))
    begins = F.transform(F.filter(number(lengths), lambda n: n <= F.length("path")), lambda n: F.left("path", n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(begins, lambda p: F.struct(s.alias("s"), p.alias("p"), *_bits(key(s, p), blocks)))))
    hit = lambda k: F.forall(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.get(filter_, k["block"] * WORDS + i).bitwiseAND(F.get(F.array(*(k[w] for w in words)), i)) == F.get(F.array(*(k[w] for w in words)), i))
    rows = rows.withColumn("keys", F.when(F.col("host") == "", None).otherwise(F.filter(keys, hit)))
    clear = rows.where("coalesce(size(keys), 0) = 0").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    maybe = rows.where("size(keys) > 0")
    asked = maybe.select("host", "path", F.explode("keys").alias("k")).select("host", "path", "k.s", "k.p").distinct()
    fits = asked.join(listed, (F.col("s") == F.col("r_host")) & (F.col("p") == F.col("r_path")))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))).alias("best"))
    judged = maybe.join(best, ["host", "path"], "left").select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return clear.unionByName(judged).withColumnRenamed("id", id_col)
