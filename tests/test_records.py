"""Context records, splits, batches, towers and streaming."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions import towers, vectors
from quillmesh.functions.encode import bag, encode, from_texts, hashed_bag, precomputed
from quillmesh.operators import metrics, records, retrieval
from quillmesh.plans import lifecycle
from quillmesh.streaming.score import score_stream

SCHEMA = "context string, cited_uri string, citing_uri string, citing_idx int, citation_type string, context_group_id bigint"


def test_validity(spark):
    papers = spark.createDataFrame([("p", 5)], "uri string, id long")
    rows = [
        ("x", "p", "", 1, "single", 0), ("x", "p", "c", 1, "", 1), ("\t  ", "p", "c", 1, "single", 1), ("x", "q", "c", 1, "single", 1),
        ("x", "p", "c", 1, "single", None), (None, None, None, None, None, None), (" y ", "p", None, None, "multiple", 2),
    ]
    contexts = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.context_text, r.cited_paper_id, r.citing_uri) for r in records.citation_records(contexts, papers).collect())
    assert got == [("x", 5, ""), ("y", 5, "")]
    assert tuple(records.record_counts(contexts, papers).first()) == (7, 2, 5)


def test_the_later_text_of_a_key_wins(spark):
    citations = spark.createDataFrame([("b/citation/h/3", 9)], "uri string, id long")
    contexts = spark.createDataFrame([("old", "b/paper/h", 3, 1), ("new ", "b/paper/h", 3, 2), (" ", "b/paper/h", 3, 3), ("no", "", 3, 4), ("no", "b/paper/h", None, 5)], "context string, citing_uri string, citing_idx int, pos int")
    assert [tuple(r) for r in records.citation_texts(contexts, citations, "pos").collect()] == [(9, "new")]


def test_split_is_disjoint_and_stable(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 50)
    one = {r.g: r.split for r in records.group_split(df, "g").collect()}
    two = {r.g: r.split for r in records.group_split(df.repartition(7), "g").collect()}
    assert one == two and sorted(one.values()).count("train") == 40 and sorted(one.values()).count("val") == 5


@pytest.mark.parametrize("fewest", [False, True])
def test_no_batch_repeats_a_group(spark, fewest):
    rows = [(0, 1), (1, 1), (2, 1), (3, 2), (4, 3), (5, 3)]
    df = spark.createDataFrame(rows, "m long, g long")
    got = (records.fewest_batches if fewest else records.anti_affinity_batches)(df, "g", "m", 2).collect()
    held = defaultdict(list)
    for r in got:
        held[(r.batch, 0 if fewest else r.round)].append(r.g)
    assert sorted(r.m for r in got) == list(range(6))
    assert len(held) >= 3 and all(len(set(g)) == len(g) <= 2 for g in held.values())
    assert not fewest or len(held) == 3


def test_epochs_are_dealt_anew(spark):
    df = spark.range(300).select(F.col("id").alias("m"), (F.col("id") % 90).alias("g"))
    for deal in (records.fewest_batches, records.anti_affinity_batches):
        kept = [sorted(map(tuple, deal(df.repartition(n), "g", "m", 16, epoch=e).collect())) for n, e in ((3, 0), (5, 0), (3, 1))]
        assert kept[0] == kept[1] != kept[2]
    sizes = [r["count"] for r in records.fewest_batches(df, "g", "m", 16).groupBy("batch").count().collect()]
    assert len(sizes) == 19 and max(sizes) <= 16
    assert records.fewest_batches(df.limit(0), "g", "m", 16).count() == 0


def test_padding(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [])], "b int, ids array<int>")
    got = {(r.b, tuple(r.ids)): (r.input_ids, r.attention_mask) for r in records.pad(df, "b", "ids").collect()}
    assert got == {(0, (1, 2, 3)): ([1, 2, 3], [1, 1, 1]), (0, (4,)): ([4, 0, 0], [1, 0, 0]), (1, ()): ([], [])}


def _vectors(spark, x, names=("query_id", "emb")):
    return spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], f"{names[0]} long, {names[1]} array<double>")


@pytest.mark.parametrize("grid", [False, True])
def test_ranks_and_top_k_against_numpy(spark, monkeypatch, grid):
    if grid:
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(retrieval, "BLOCK", 16)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x[10] = x[11]
    candidates = _vectors(spark, x, ("paper_id", "emb"))
    queries = _vectors(spark, x).withColumn("cited_paper_id", F.col("query_id") + 1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 10)
    ranks = {r.query_id: r["rank"] for r in retrieval.rank_targets(queries, candidates).collect()}
    assert ranks == {q: 1 + int((s[q] > s[q, q + 1]).sum()) for q in range(59)}
    assert [r.query_id for r in retrieval.skipped(queries, candidates).collect()] == [59]
    top = defaultdict(list)
    for r in retrieval.top_k(queries, candidates, 5).orderBy("query_id", "rank").collect():
        top[r.query_id].append(r.paper_id)
    assert top == {q: np.lexsort((np.arange(60), -s[q]))[:5].tolist() for q in range(60)}


def test_metadata_fallback(spark):
    results = spark.createDataFrame([(0, 1, 1, 0.123456), (0, 2, 2, 0.1), (0, 3, 3, 0.1), (0, 4, 4, 0.1)], "query_id long, rank int, paper_id long, score double")
    titles = spark.createDataFrame([(1, "T"), (2, "")], "id long, title string")
    abstracts = spark.createDataFrame([(1, "a"), (2, "first\nsecond"), (3, "")], "id long, text string")
    got = {r.paper_id: (r.score, r.title) for r in retrieval.with_metadata(results, titles, abstracts).collect()}
    assert got == {1: (0.1235, "T"), 2: (0.1, "first"), 3: (0.1, "(no title)"), 4: (0.1, "(no title)")}


def test_infonce_against_numpy(spark):
    rng = np.random.default_rng(1)
    c, p = (towers.unit(rng.normal(size=(6, 4))) for _ in range(2))
    df = spark.createDataFrame([(0, k, c[k].tolist(), p[k].tolist()) for k in range(6)], "batch_id long, row long, context array<double>, paper array<double>")
    logits = c @ p.T / 0.07
    lse = lambda a, axis: np.log(np.exp(a).sum(axis=axis))
    want = 0.5 * ((lse(logits, 1) - np.diag(logits)).mean() + (lse(logits, 0) - np.diag(logits)).mean())
    assert metrics.infonce(df).first().loss == pytest.approx(want)


def test_tower_sizes_and_identity():
    assert towers.PaperTower(["PP", "P"], 768, 768, 768).parameter_count() == 4_132_609
    t = towers.PaperTower(["P", "PP"], 8, 6, 4, num_heads=2, act="relu").initialise()
    x = np.random.default_rng(2).normal(size=(3, 2, 8))
    assert np.allclose(t._attend(x, None), x)  # the gate of the attention starts at zero
    out = t.forward(x)
    assert out.shape == (3, 4) and np.allclose(np.linalg.norm(out, axis=1), 1)
    t.weights["gamma"] = np.array([0.5])
    assert np.allclose(t._attend(x, np.array([[1.0, 1.0]] * 3)), t._attend(x, None))
    deep = towers.PaperTower(["P"], 8, 6, 4, n_fp_layers=2, use_mlp=True).initialise()
    assert np.allclose(np.linalg.norm(deep.forward(x[:, :1]), axis=1), 1)
    with pytest.raises(ValueError):
        towers.PaperTower(["P"], 8, 6, 4, act="tanh")
    with pytest.raises(ValueError):
        towers.PaperTower(["P"], 8, 6, 4, num_heads=3)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(1, 30_000), max_size=40), max_size=8))
def test_bag_is_total(rows):
    made = bag(np.array([i for r in rows for i in r], dtype=np.int64), np.array([len(r) for r in rows], dtype=np.int64), 64)
    assert made.shape == (len(rows), 64) and np.isfinite(made).all()
    for row, x in zip(rows, made, strict=True):
        plain = np.zeros(64)
        for i in row:
            plain[i % 64] += 1 if (i // 64) % 2 else -1
        assert np.allclose(x, plain / max(np.linalg.norm(plain), 1e-12))


def test_whole_texts_are_encoded(spark):
    """A word behind a thousand others counts; a limit leaves it out."""
    df = spark.createDataFrame([(1, "a " * 1000), (2, "a " * 1000 + "river " * 500)], "id long, t string")
    whole, cut = ({r.id: r.vec for r in encode(df, "id", "t", e).collect()} for e in (None, hashed_bag(64, 512)))
    assert whole[1] != whole[2] and cut[1] == cut[2]


def test_other_encoders(spark):
    df = spark.createDataFrame([(1, "x"), (2, "yy"), (3, None)], "id long, t string")
    lengths = from_texts(lambda texts: np.array([[float(len(t or "")), 1.0] for t in texts]), block=2)
    assert {r.id: r.vec for r in encode(df, "id", "t", lengths).collect()} == {1: [1, 1], 2: [2, 1], 3: [0, 1]}
    table = spark.createDataFrame([("x", [1.0, 2.0]), ("z", [3.0, 4.0])], "text string, vec array<double>")
    assert [tuple(r) for r in encode(df, "id", "t", precomputed(table)).collect()] == [(1, [1, 2])]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    r = df.select(vectors.l2_normalise(F.col("v")).alias("u"), vectors.softmax(F.col("v")).alias("s"), vectors.mean_of(F.col("v"), F.col("v")).alias("m"), vectors.is_nonzero(F.col("v")).alias("z")).collect()
    assert r[0].u == pytest.approx([0.6, 0.8]) and r[1].u == [0, 0] and sum(r[0].s) == pytest.approx(1) and r[0].m == [3, 4] and [x.z for x in r] == [True, False]


def test_evaluate_and_recommend(spark):
    texts = spark.createDataFrame([(0, "graphs of citations"), (1, "cooking rice"), (2, "deep sea fish")], "id long, text string")
    tower = towers.ContextTower(64, 64).initialise()
    index = lifecycle.embed_contexts(tower, texts, "id", "text").withColumnRenamed("query_id", "paper_id")
    empty = spark.createDataFrame([], "id long, title string")
    got = lifecycle.recommend(spark, " cooking rice ", tower, index, empty, texts, topk=2).collect()
    assert got[0].paper_id == 1 and got[0].title == "cooking rice" and len(got) == 2
    nodes = spark.createDataFrame([(1, "b/paper/rice")], "id long, uri string")
    named = lifecycle.recommend(spark, "cooking rice", tower, index, empty, texts, topk=3, nodes=nodes).collect()
    assert named[0].uri == "b/paper/rice" and {r.uri for r in named[1:]} == {"id:0", "id:2"}
    queries = index.select(F.col("paper_id").alias("query_id"), F.col("paper_id").alias("cited_paper_id"), "emb")
    r = lifecycle.evaluate(queries, index).first()
    assert r.mrr == 1 and r.n_skipped == 0 and r.total_candidates == 3


def test_prompt_loop_ends():
    asked = iter(["a", "b ", ":quit", "c"])
    seen = []
    assert lifecycle.interactive(lambda _: next(asked), seen.append) == 2 and seen == ["a", "b"]


def test_stream(spark, tmp_path):
    candidates = _vectors(spark, np.eye(4), ("paper_id", "emb"))
    _vectors(spark, np.eye(4)[:2]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, emb array<double>").parquet(str(tmp_path / "in"))
    score_stream(stream, candidates, str(tmp_path / "out"), str(tmp_path / "ck"), 1).awaitTermination(60)
    assert {(r.query_id, r.paper_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, 0), (1, 1)}


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string")
    assert {r.id: any(r.vec) for r in encode(df, "id", "t").collect()} == {1: True, 2: False}


def test_missing_texts_and_reports(spark):
    from quillmesh.operators.propagate import missing_texts
    from quillmesh.plans import report

    nodes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, uri string")
    texts = spark.createDataFrame([("a", "x"), ("b", " \t")], "uri string, text string")
    assert sorted(r.uri for r in missing_texts(nodes, texts).collect()) == ["b", "c"]
    ranks = spark.createDataFrame([(1,), (200,)], "rank long")
    told = report.metrics_report(metrics.ranking_metrics(ranks), metrics.rank_distribution(ranks))
    assert "mrr                0.5025" in told and "rank >100          1 (50.0 %)" in told
    rows = spark.createDataFrame([(1, 0.5, "T" * 100)], "rank int, score double, title string")
    assert report.results_report(rows) == f"  1  0.5000  {'T' * 80}"


def test_features_end_to_end(spark):
    from quillmesh.operators.graph import Vocabulary

    v = Vocabulary("b/paper/", "b/citation/", "o#")
    rows = [
        ("b/paper/a", v.cites, "b/paper/d"), ("b/paper/a", v.cites, "b/paper/e"), ("b/citation/a/0", v.has_citing, "b/paper/a"), ("b/citation/a/0", v.has_cited, "b/paper/d"),
        ("b/citation/a/0", v.has_cited, "b/paper/e"), ("b/paper/d", v.has_citation_context, "n"), ("n", v.has_context, "cites the river"),
    ]
    triples = spark.createDataFrame(rows, "s string, p string, o string")
    contexts = spark.createDataFrame([("a passage", "b/paper/d", "b/paper/a", 0, "single", 1, 0)], SCHEMA + ", line int")
    abstracts = spark.createDataFrame([("b/paper/a", "an abstract")], "uri string, text string")
    made = {k: {r.id: any(r.vec) for r in df.collect()} for k, df in lifecycle.build_features(triples, contexts, abstracts, v, "line").items()}
    assert made == {"P": {0: True, 1: True, 2: False}, "C": {0: True}, "PP": {0: True, 1: False, 2: False}, "PCP": {0: False, 1: False, 2: True}, "PCCon": {0: False, 1: True, 2: True}}
    split = lifecycle.build_datasets(contexts, spark.createDataFrame([("b/paper/d", 1)], "uri string, id long")).collect()
    assert [(r.cited_paper_id, r.split) for r in split] == [(1, "test")]
