"""Mixing to target weights, and the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import mixing, queries


def _rows(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "", "é", None])
        out.append((i, " ".join(["w"] * min(400, int(rng.expovariate(1 / 40)))), source))
    return out


def _by_source(rows):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(brute.words(text))
    return sizes


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_totals(spark, seed):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(5)).collect()
    sizes = _by_source(rows)
    want = brute.targets(sizes)
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        assert r.size == len(brute.words(rows[r.doc_id][1])) and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]]) and 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(rows) and sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 20), (s, taken[s], t)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(2)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_copies_are_unbiased(spark):
    """Over many seeds of ids a document is taken as often as its source's ratio says."""
    rows = [(k, "w " * (1 + k % 30), "a" if k % 3 else "b") for k in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    small = mixing.mix(df).where("key = 'sb'").groupBy((F.col("size") > 15).alias("large")).agg(F.avg("copies").alias("c"), F.avg(F.col("target") / F.col("source_size")).alias("ratio")).collect()
    assert all(r.c == pytest.approx(r.ratio, abs=0.05) for r in small)


def test_edges(edge, edge_rows, empty, spark):
    got = mixing.mix(edge).collect()
    sizes = _by_source([(r[0], r[1], r[3]) for r in edge_rows])
    want = brute.targets(sizes)
    assert len(got) == len(edge_rows) and {round(r.target, 6) for r in got} == {round(x, 6) for x in want.values()}
    assert {r.taken for r in got if r.size == 0} == {0}
    taken = mixing.mixed_rows(edge)
    assert taken.columns == edge.columns and taken.count() == sum(r.copies for r in got)
    assert Counter(r.doc_id for r in taken.collect()) == Counter({i: n for i, n in Counter({r.doc_id: 0 for r in got} | {}).items()} | _copies(got))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]


def _copies(rows):
    out = Counter()
    for r in rows:
        if r.copies:
            out[r.doc_id] += r.copies
    return out


def test_pipeline(spark):
    """Each stage against its contract, over the rows that the stage before it wrote."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in p.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        kept[name] = docs.count()
        if name == "toxicity":
            assert 0.8 * before.count() <= kept[name] <= before.count()  # a few labels teach little
        if name == "line_dedup":
            assert kept[name] == before.count()
        if name == "minhash_near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            found = brute.near_duplicates(rows)
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, root) in found.items() if root == i}
        if name == "mixing":
            most = Counter(r.doc_id for r in docs.collect())
            assert max(most.values()) == 2
            want = brute.targets(_by_source([(r.doc_id, r.text, r.source) for r in before.collect()]))
            taken = _by_source([(r.doc_id, r.text, r.source) for r in docs.collect()])
            half = {s: max(len(brute.words(r.text)) for r in before.collect() if r.source == s) / 2 for s in want}  # ten documents a source
            assert all(abs(taken[s] - t) <= half[s] + 1 for s, t in want.items())
        if name != "bpe":
            assert docs.columns == columns
        else:
            assert kept[name] == before.count() and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert p.run(spark, sf).count() == kept["bpe"]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_query_returns_one_row_per_row(spark, name):
    sf = "/root/testdata/sf0.001"
    table = {"op1_site_style_tree": "pages", "op4_rp_forest": "embeddings"}.get(name, "documents")
    rows = spark.read.parquet(f"{sf}/{table}.parquet")
    if name == "mixing_targets":  # a report by source
        rows = rows.select("source").distinct()
    assert queries.QUERIES[name](spark, sf).count() == rows.count()
