"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexflow.llm import bpe, decontaminate, embeddings, html, langid, minhash, quality, shard, urls, warc
from indexflow.llm.common import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Groups of linked rows: ``l`` holds links (x, y) in both directions, ``d`` every id.
GROUPS_SQL = """r(id, root) AS (SELECT id, id FROM d UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id AND r.root < l.y),
g AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)"""
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS shingle FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
h AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
l AS (SELECT x, y FROM h UNION ALL SELECT y, x FROM h),
d AS (SELECT doc_id AS id FROM documents),
""" + GROUPS_SQL + """
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN g ON g.id = w.doc_id
"""
OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT x, y FROM (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)) WHERE s >= 0.93 AND NOT isnan(s)),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x),
d AS (SELECT vec_id AS id FROM embeddings),
""" + GROUPS_SQL + """
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN k ON x = vec_id JOIN g ON g.id = vec_id
"""


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"), k=3, percent=85, name="op1")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()), id_col="doc_id")
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", F.size("langs").cast("long").alias("n_langs"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_groups(_table(spark, sf_dir, "embeddings"), name="op3")


#: Fixed rules: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
OP4_SQL = r"""
WITH r(r_host, r_path, r_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS n, page_id,
        translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*(/[^?#]*)?', 1) AS path FROM pages),
f AS (SELECT n, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
      FROM u JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n)
SELECT page_id, host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f ON u.n = f.n
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def graded(labels: DataFrame) -> DataFrame:
    """Ids with a grade: 2 good and not toxic, 1 one of both, 0 neither."""
    grade = F.when(F.col("quality") > 0, 1).otherwise(0) + F.when(F.col("toxic") > 0, 0).otherwise(1)
    return labels.where("quality is not null and toxic is not null").select("doc_id", grade.alias("grade"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, graded(_table(spark, sf_dir, "labels")))
    found = quality.score(docs, model, keep=["doc_id"])
    top = F.element_at("tails", -1)
    return found.select("doc_id", "expected_grade", F.element_at("tails", 1).alias("p_above_0"), top.alias("p_top"), (top >= 0.5).alias("selected"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html.main_text(pages, html.train(pages), keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
f AS (SELECT page_id, octet_length(body) AS payload_bytes, unhex(sha1(body)) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST(('0b' || substr(bits, 5 * i + 1, 5)) AS INTEGER), 1)), '') AS payload_digest
      FROM (SELECT *, array_to_string(list_transform(generate_series(0, 19), lambda i: bin(CAST('0x' || substr(hex(h), 2 * i + 1, 2) AS INTEGER) + 256)[2:]), '') AS bits FROM f))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op7")
    archives = warc.write(_table(spark, sf_dir, "pages"), f"{ws.path}/warc", ws=ws)
    found = warc.read(archives, payloads=False)
    # what was just written must be whole: a gap is an error
    whole = F.when(F.col("gap").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "gap"))).otherwise(F.col("page_id"))
    return found.select(whole.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[p:p + least(8, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(8, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"], name="op8")
    n_items = F.size("hit_items").cast("long")
    return found.select("doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.place(_table(spark, sf_dir, "documents"), 40, name="op9")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_language, op3_embeddings, op4_url_filter, op5_quality, op6_html, op7_warc, op8_decontaminate, op9_shard, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op3_embeddings": OP3_SQL, "op4_url_filter": OP4_SQL, "op7_warc": OP7_SQL, "op8_decontaminate": OP8_SQL}
