"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from quillmesh.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or abs(a - b) <= 1e-6 + 1e-9)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cursor.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(_same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_derived_key_join_keeps_every_conversation(spark, con):
    got = {(r.id, r.text) for r in QUERIES["derived_key_join"](spark, SF).collect()}
    want = con.execute("SELECT conv_id * 100 + turn, trim(text) FROM conversations WHERE turn <> 1 AND regexp_matches(text, '[^ \\t\\n\\r\\f\\v]')").fetchall()
    assert got == set(want) and any(i // 100 % 2 for i, _ in got)


def test_unknown_keys_are_dropped(spark):
    from quillmesh.operators import records

    contexts = spark.createDataFrame([("known", "u:/paper/a", 1, 1), ("unknown", "u:/paper/b", 1, 2)], "context string, citing_uri string, citing_idx int, pos int")
    citations = spark.createDataFrame([("u:/citation/a/1", 7)], "uri string, id long")
    assert [(r.id, r.text) for r in records.citation_texts(contexts, citations, "pos").collect()] == [(7, "known")]


def test_padded_batches_keep_256_tokens(spark, con):
    got = {r.doc_id: r.n for r in QUERIES["padded_batches"](spark, SF).where("mask = 1").groupBy("doc_id").agg({"*": "count"}).toDF("doc_id", "n").collect()}
    want = con.execute("SELECT doc_id, n FROM (SELECT doc_id, least(256, len(list_filter(string_split(text, ' '), lambda w: w <> ''))) AS n FROM documents) WHERE n > 0").fetchall()
    assert got == dict(want) and max(got.values()) == 256


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
