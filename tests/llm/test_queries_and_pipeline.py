import random

import duckdb
import pytest

import corpus_pipeline
from indexflow.llm import queries
from indexflow.llm.common import Workspace
from indexflow.llm.minhash import shingle_sets
from indexflow.llm.common import WordHashes

TABLES = "documents embeddings pages benchmark labels".split()
COLUMNS = {
    "op1_minhash": "doc_id n_shingles component_id kept", "op2_language": "doc_id held_out lang_pred score", "op3_embeddings": "vec_id n_links component_id kept", "op4_url_filter": "page_id host path rule verdict",
    "op5_quality": "doc_id expected_grade p_top selected", "op6_html": "page_id url text n_chars", "op7_warc": "page_id payload_bytes payload_digest record_type refers_to", "op8_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9_shard": "doc_id size text_crc32 law shard slot grown_shard", "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_queries(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    source = "embeddings" if "vec_id" in got.columns else "pages" if "page_id" in got.columns else "documents"
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    assert len(rows) == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
    if name in queries.oracle_sql():
        c = duckdb.connect()
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = c.sql(queries.oracle_sql()[name])
        at = [want.columns.index(x) for x in sorted(got.columns)]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_stages_in_order(spark, sf_dir):
    """Every stage returns the columns of documents and takes rows away only as its operator says."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_dedup", "decontaminate", "tokens"]
    ws = Workspace(spark, "stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(0)
    extra = [(10_000, None), (10_001, "123 456"), (10_002, "")]
    base = docs.where("lang = 'en'").orderBy("doc_id").first()["text"]
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    clean = docs.where("lang = 'en' and n_chars > 800").orderBy("doc_id").collect()[3]["text"]
    extra += [(10_003, base), (10_004, base + " more"), (10_005, clean[:400] + " " + leak + " " + clean[400:])]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in extra], docs.schema))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = ws.save(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns and ids(out) <= ids(docs)
        kept[name] = (docs, out)
        docs = out
    assert not ids(kept["language"][1]) & {10_000, 10_001, 10_002}
    before, after = kept["near_dedup"]
    rows = before.collect()
    sets = {r["doc_id"]: {*s.tolist()} for r, s in zip(rows, shingle_sets([r["text"].encode() for r in rows], 5, WordHashes()), strict=True)}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    gone, stay = ids(before) - ids(after), ids(after)
    assert all(any(link(g, s) for s in sets if s != g) for g in gone)
    assert not any(link(a, b) for a in stay for b in stay if a < b)
    assert 10_003 in gone and 10_005 not in ids(kept["decontaminate"][1])
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert tokens.where("restored").count() == docs.count() and rng


def test_pipeline_runs(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and got.where("not restored or n_tokens <> size(ids)").count() == 0


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
