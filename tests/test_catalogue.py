"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

from indexflow.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    if name not in ORACLE:
        assert rows
        return
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


ODD_TEXTS = ["", " ", "\n", "\t", None, "  lead\nx", "a\n\tb", "a\r\nb\r\n\r\nc", "a\n \nb", "\xa0x \n　y", "a\x0b b\x0c\nc", "\x1c\nq\x1d", "\x85a\n ", "w" * 1500 + "\n" + " " * 900 + "ab cd\nend", "x\n" + "\t" * 1200 + "one two\nrest", "é" * 700 + " " + "é" * 400]


@pytest.mark.parametrize("name", ["split_invariants", "split_positions"])
def test_split_queries_equal_sql_on_odd_texts(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(ORACLE[name])
    assert sorted(map(repr, map(tuple, got.select(*(f"`{n}`" for n in want.columns)).collect()))) == sorted(map(repr, want.fetchall()))
