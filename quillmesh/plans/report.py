"""Plain-text reports of metrics and results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def metrics_report(metrics: DataFrame, distribution: DataFrame) -> str:
    """One line per figure, then the rank buckets with their shares."""
    row = metrics.first()
    lines = [f"{name:<18} {value:.4f}" if isinstance(value, float) else f"{name:<18} {value}" for name, value in row.asDict().items()]
    lines += [f"rank {r.bucket:<13} {r.n} ({100 * (r.share or 0):.1f} %)" for r in distribution.collect()]
    return "\n".join(lines)


def results_report(results: DataFrame, width: int = 80) -> str:
    """Rank, score and title of a result list in order."""
    uri = "uri" in results.columns
    return "\n".join(f"{r['rank']:>3}  {r.score:.4f}  {r.title[:width]}" + (f"  <{r.uri}>" if uri else "") for r in results.orderBy("rank").collect())
