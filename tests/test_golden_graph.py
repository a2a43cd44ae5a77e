"""A hand-computed graph of six papers and five citation nodes with two-component vectors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import graph, metrics, propagate

P = {0: (1, 0), 1: (0, 1), 2: (0, 0), 3: (2, 2), 4: (4, 0), 5: (0, 0)}
C = {0: (1, 1), 1: (0, 0), 2: (2, 0), 3: (0, 2), 4: (3, 3)}
CITES = [(0, 3), (0, 4), (1, 0), (1, 3), (2, 2)]
CITED = [(0, 3), (0, 4), (1, 4), (2, 0), (2, 3), (3, 3), (3, 4), (4, 2)]


def _features(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows.items()], "id long, vec array<double>")


def _edges(spark, rows):
    return spark.createDataFrame([(a, b, 1.0) for a, b in rows], "src long, dst long, w double")


def _rows(df):
    return {r.id: tuple(r.vec) for r in df.collect()}


def test_pp_keeps_self_citation_and_zero_neighbours(spark):
    got = _rows(propagate.metapath_pp(_edges(spark, CITES), _features(spark, P), 2))
    assert got == {0: pytest.approx((3, 1)), 1: pytest.approx((1.5, 1)), 2: pytest.approx((0, 0))}


def test_cocitation_is_symmetric_without_diagonal(spark):
    got = {(r.src, r.dst): r.w for r in graph.cocitation(_edges(spark, CITED)).collect()}
    assert got == {(0, 3): 1, (3, 0): 1, (3, 4): 2, (4, 3): 2}


def test_pcp(spark):
    got = _rows(propagate.metapath_pcp(_edges(spark, CITED), _features(spark, P), 2))
    assert got == {0: pytest.approx((2, 2)), 3: pytest.approx((3, 0)), 4: pytest.approx((2, 2))}


def test_pccon_counts_a_zero_passage(spark):
    got = _rows(propagate.metapath_pccon(_edges(spark, CITED), _features(spark, C), 2))
    assert got == {0: pytest.approx((2, 0)), 2: pytest.approx((3, 3)), 3: pytest.approx((1, 1)), 4: pytest.approx((1 / 3, 1))}


def test_missing_vector_counts_as_zero(spark):
    got = _rows(propagate.propagate(_edges(spark, [(0, 1), (0, 9)]), _features(spark, {1: (2, 4)}), 2))
    assert got == {0: pytest.approx((1, 2))}


def test_assemble_fills_zeros(spark):
    nodes = spark.createDataFrame([(0,), (7,)], "id long")
    assert _rows(propagate.assemble(nodes, _features(spark, P), 2)) == {0: (1, 0), 7: (0, 0)}


def test_rows_of_a_normalised_matrix_sum_to_one(spark):
    sums = graph.row_normalise(_edges(spark, CITED)).groupBy("src").agg(F.sum("w").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)


def test_ranking_metrics(spark):
    ranks = spark.createDataFrame([(1,), (2,), (12,)], "rank long")
    r = metrics.ranking_metrics(ranks).first()
    assert (r.recall_at_1, r.recall_at_5, r.recall_at_10, r.recall_at_20) == pytest.approx((1 / 3, 2 / 3, 2 / 3, 1))
    assert (r.mrr, r.ndcg_uncut, r.ndcg_at_10) == pytest.approx((0.5277777778, 0.6337226360, 0.5436432512))


def test_median_is_the_upper_one(spark):
    assert metrics.median_rank(spark.createDataFrame([(1,), (2,), (10,), (20,)], "rank long")).first().median_rank == 10


def test_metrics_of_no_query_are_null(spark):
    r = metrics.ranking_metrics(spark.createDataFrame([], "rank long")).first()
    assert r.mrr is None and r.n_queries == 0
    assert metrics.median_rank(spark.createDataFrame([], "rank long")).first().median_rank is None


def test_early_stopping_needs_a_strict_gain(spark):
    rows = [(0, 0.1), (1, 0.3), (2, 0.3), (3, 0.2), (4, 0.1), (5, 0.9)]
    got = {r.epoch: r for r in metrics.early_stopping(spark.createDataFrame(rows, "epoch int, mrr double"), "epoch", "mrr", 3).collect()}
    assert [got[k].best_at for k in range(6)] == [0, 1, 1, 1, 1, 5]
    assert [got[k].stopped for k in range(6)] == [False, False, False, False, True, True]


def test_mean_loss_counts_skipped_batches(spark):
    df = spark.createDataFrame([(2.0,), (float("nan"),), (float("inf"),), (4.0,)], "loss double")
    assert metrics.mean_loss(df).first().mean_loss == pytest.approx(1.5)
