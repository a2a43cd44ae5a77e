"""Ranking metrics over (query, rank) rows, training history and the contrastive loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.vectors import dot

CUTS = (1, 5, 10, 20)


def ranking_metrics(ranks: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """One row: recall at each cut, MRR, nDCG without a cut and cut at 10, number of queries; null without queries."""
    gain = F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0))
    recall = [F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_at_{k}") for k in cuts]
    return ranks.agg(
        *recall, F.avg(F.lit(1.0) / F.col("rank")).alias("mrr"), F.avg(gain).alias("ndcg_uncut"),
        F.avg(F.when(F.col("rank") <= 10, gain).otherwise(F.lit(0.0))).alias("ndcg_at_10"), F.count("*").alias("n_queries"),
    )


def rank_distribution(ranks: DataFrame) -> DataFrame:
    """(bucket, n, share) of the ranks 1, up to 5, up to 10 and beyond 100."""
    counts = ranks.agg(F.count_if(F.col("rank") == 1).alias("a"), F.count_if(F.col("rank") <= 5).alias("b"), F.count_if(F.col("rank") <= 10).alias("c"), F.count_if(F.col("rank") > 100).alias("d"), F.count("*").alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("bucket"), F.col(c).alias("n")) for name, c in (("=1", "a"), ("<=5", "b"), ("<=10", "c"), (">100", "d"))]))
    return counts.select(rows.alias("x"), F.col("n").alias("total")).select("x.bucket", "x.n", F.round(F.try_divide(F.col("x.n").cast("double"), F.col("total")), 6).alias("share"))


def median_rank(ranks: DataFrame) -> DataFrame:
    """One row: the upper median (the element at n div 2 of the sorted ranks) and the mean.

    Ranks are few distinct numbers: they are counted first, and the median is where the running
    count passes the middle.
    """
    counted = ranks.groupBy("rank").agg(F.count("*").alias("n"))
    run = counted.withColumns({"upto": F.sum("n").over(Window.orderBy("rank")), "total": F.sum("n").over(Window.partitionBy())})
    return run.agg(F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("rank"))).alias("median_rank"), (F.sum(F.col("rank") * F.col("n")) / F.sum("n")).alias("mean_rank"))


def early_stopping(history: DataFrame, order: str, metric: str, patience: int) -> DataFrame:
    """History with the running best (strictly better counts), the epochs since, and where to stop.

    A history is one short sequence of epochs; it is ordered as a whole.
    """
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = history.withColumn("improved", F.col(metric) > F.coalesce(F.max(metric).over(before), F.lit(float("-inf"))))
    marked = marked.withColumns({"best": F.max(metric).over(upto), "best_at": F.max(F.when(F.col("improved"), F.col(order))).over(upto)})
    marked = marked.withColumn("waited", F.col(order) - F.col("best_at"))
    return marked.withColumn("stopped", F.coalesce(F.max((F.col("waited") >= patience).cast("int")).over(upto) == 1, F.lit(False)))


def mean_loss(batches: DataFrame, loss: str = "loss") -> DataFrame:
    """Mean over all batches; one whose loss isn't finite was skipped and counts as 0."""
    return batches.agg((F.sum(F.when(finite(loss), F.col(loss)).otherwise(F.lit(0.0))) / F.greatest(F.count("*"), F.lit(1))).alias("mean_loss"))


def finite(column: str):
    """True for numbers that are neither null, NaN nor infinite."""
    x = F.col(column)
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def infonce(batch: DataFrame, temperature: float = 0.07) -> DataFrame:
    """(batch_id, loss): symmetric contrastive loss of (batch_id, row, context, paper) unit vectors.

    All pairs within a batch are the method's own logits; a batch has a fixed size.
    """
    left = batch.select("batch_id", F.col("row").alias("i"), F.col("context").alias("c"))
    right = batch.select("batch_id", F.col("row").alias("j"), F.col("paper").alias("p"))
    logits = left.join(right, "batch_id").select("batch_id", "i", "j", (dot(F.col("c"), F.col("p")) / temperature).alias("l"))
    diagonal = F.max(F.when(F.col("i") == F.col("j"), F.col("l"))).alias("d")

    def side(own: str) -> DataFrame:
        # Cosines over a temperature of 0.07 stay below 14.3: exp is safe in double precision.
        lse = logits.groupBy("batch_id", own).agg(F.ln(F.sum(F.exp("l"))).alias("lse"), diagonal)
        return lse.groupBy("batch_id").agg(F.avg(F.col("lse") - F.col("d")).alias(f"ce_{own}"))

    return side("i").join(side("j"), "batch_id").select("batch_id", ((F.col("ce_i") + F.col("ce_j")) / 2).alias("loss"))
