"""A corpus pipeline of five stages over ``documents``, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Null, empty, very long and repeated texts follow the rules of the operators that the stages call.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexflow.llm import bpe, decontaminate, langid, minhash, quality
from indexflow.llm.common import Workspace
from indexflow.llm.queries import graded

#: Share of a document's words that its best language must have: spliced texts in two or three languages stay.
LEAST_SHARE = 0.3
#: Probability of the top grade that a document must reach.
LEAST_TOP = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one learned language has 0.3 of the words or more; those without a letter go."""
    model = langid.train(docs, id_col="doc_id")
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(docs.columns)


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the top grade with a probability of half or more; none where no document is rated."""
    model = quality.train(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    found = quality.score(docs, model)
    return found.where(F.element_at("tails", -1) >= LEAST_TOP).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates, on five-word shingles at 0.8.

    Of rows that repeat an id one stays; documents without an id stay.
    """
    ws = Workspace(spark, "pipeline-kept")
    groups = minhash.near_groups(docs, k=5, percent=80, name="pipeline-dedup").where("doc_id is not null")
    ids = ws.save(groups.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count_if("kept").alias("n")))
    left = minhash.IdFilter(ids.where("not kept").select("doc_id"), "doc_id", ws).without(docs)
    more = ids.where("n > 1").select("doc_id")
    if more.isEmpty():
        return left
    again = minhash.IdFilter(more, "doc_id", ws)
    return again.without(left).unionByName(again.among(left).dropDuplicates(["doc_id"])).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no eight words in a row with a benchmark item, nor hold a shorter item whole."""
    found = decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hit_items") == 0).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, whose decoding is compared with the text."""
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), check_col="restored", keep=["doc_id", "lang", "source"])
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "restored")


STAGES = [("language", language), ("quality", select_quality), ("near_dedup", near_dedup), ("decontaminate", drop_leaks), ("tokens", tokens)]
#: Models and sketches are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
