"""Connected components of a link table; more links than a fixed number are never gathered anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import drop_materialized, materialize

#: Links up to which the driver solves them (4 MB); the plans of the rounds would take more of its memory.
DRIVER_LINKS = 250_000


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of the links (u, v), and the smallest node that each one reaches."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    left, right = places[: len(u)], places[len(u) :]
    root = np.arange(len(nodes))
    while len(left):
        # A root hangs on the smallest root that it is linked with, and then all nodes on their roots.
        np.minimum.at(root, np.maximum(left, right), np.minimum(left, right))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        left, right = root[left], root[right]
        left, right = left[left != right], right[left != right]
    return nodes, nodes[root]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); the root is the smallest node reached.

    Alternating large and small stars: each round hangs the neighbours of a node on the smallest of
    them.  Minima come from an aggregation with map-side combine and a join that Spark can split,
    so a hub with very many links is never one task's list.  Each round is a written table, and the
    rounds go on until one changes nothing: about as many as the logarithm of the longest path.
    Up to ``DRIVER_LINKS`` links with long ids are solved at once instead, with the same result.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links")
    if {t for _, t in links.dtypes} == {"bigint"} and links.count() <= DRIVER_LINKS:
        found = links.toArrow()
        nodes, roots = _roots(*(found.column(c).to_numpy() for c in ("u", "v")))
        drop_materialized(links)
        solved = pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(roots, pa.int64())})
        return materialize(links.sparkSession.createDataFrame(solved), "roots")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    before = mark(links)
    while before[0]:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        last, links = links, materialize(small.distinct(), "links")
        drop_materialized(last)
        now = mark(links)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
