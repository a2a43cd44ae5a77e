"""Embedding near-dedup with a forest of random-projection trees.

Every tree splits the vectors again and again along random directions; a vector within ``SPILL``
of a split goes to both sides, so close vectors rarely part in all trees.  Vectors are compared
within the leaves in double precision, exact links are counted and unioned.  A pair that meets in
several leaves counts in the first of them only, which either side can tell from the routes of the
two vectors, so no pair is ever written out: a leaf yields one row per vector.

The directions come from a seed; the split points are medians of a bounded sample (``SAMPLE``
vectors in the order of a hash), per node while the sample resolves it and per level below that.
The depth follows the number of vectors.  Vectors of each length have a forest of their own, as a
cosine needs equal lengths.  A leaf of more than ``CHUNK`` vectors is dealt out as
pairs of chunks, so no task ever holds more than two chunks of it.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different lengths never link; equal vectors are one node, with their
number; rows of one id are separate vectors, told apart by content; a null id never becomes the
component of a vector that has an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import materialize, ship
from quillmesh.llm.components import connected_components

COSINE = 0.95
TREES = 6
SPILL = 0.02
LEAF = 400
CHUNK = 2_000
SAMPLE = 16_384
#: Sample vectors that a node needs for a median of its own.
RESOLVED = 32
MAX_DEPTH = 40


class Forest(NamedTuple):
    directions: np.ndarray  # [TREES, depth, width]
    level: np.ndarray  # [TREES, depth] medians of whole levels
    node: list[dict[int, float]]  # per tree: medians of resolved nodes, by heap number


def grow(sample: np.ndarray, rows: int, width: int, seed: int = 11) -> Forest:
    """Directions and split points for ``rows`` unit vectors of ``width`` from a sample of them."""
    depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(rows, 1) / LEAF)))))
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(TREES, depth, width))
    directions /= np.maximum(np.linalg.norm(directions, axis=2, keepdims=True), 1e-12)
    level = np.zeros((TREES, depth))
    nodes: list[dict[int, float]] = []
    for t in range(TREES):
        own: dict[int, float] = {}
        at = np.ones(len(sample), dtype=np.int64)
        for d in range(depth):
            p = sample @ directions[t, d] if len(sample) else np.empty(0)
            level[t, d] = np.median(p) if len(p) else 0.0
            if len(p):
                order = np.argsort(at, kind="stable")
                heads, starts = np.unique(at[order], return_index=True)
                cuts = np.full(len(p), level[t, d])
                for h, members in zip(heads.tolist(), np.split(order, starts[1:]), strict=True):
                    if len(members) >= RESOLVED:
                        own[h] = cuts[members[0]] = float(np.median(p[members]))
                        cuts[members] = own[h]
                at = 2 * at + (p > cuts)
        nodes.append(own)
    return Forest(directions, level, nodes)


def routes(forest: Forest, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that each unit vector reaches; leaves are numbered across trees."""
    rows, leaves = [], []
    depth = forest.directions.shape[1]
    for t in range(TREES):
        row, at = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        for d in range(depth):
            p = (x @ forest.directions[t, d])[row]
            heads, back = np.unique(at, return_inverse=True)
            cut = np.array([forest.node[t].get(h, forest.level[t, d]) for h in heads.tolist()])[back]
            right, left = p > cut - SPILL, p <= cut + SPILL
            row, at = np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left], 2 * at[right] + 1])
        rows.append(row)
        leaves.append(at + (np.int64(t) << 50))
    return np.concatenate(rows), np.concatenate(leaves)


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _compare(forest: Forest, x: np.ndarray, weight: np.ndarray, leaf: int, cross: int) -> tuple[np.ndarray, np.ndarray]:
    """New links of each vector in a leaf (weighted by copies) and the least position it is tied to.

    ``cross`` > 0: only pairs of the first ``cross`` vectors with the others.
    """
    n = len(x)
    links = np.zeros(n, dtype=np.int64)
    tied = np.arange(n)
    found = []
    for lo in range(0, n, 1024):
        close = (x[lo : lo + 1024] @ x.T) >= COSINE
        i, j = np.nonzero(close)
        i += lo
        keep = i < j
        if cross:
            keep &= (i < cross) & (j >= cross)
        found.append((i[keep], j[keep]))
    i, j = (np.concatenate(a) for a in zip(*found, strict=True))
    if not len(i):
        return links, tied
    # Pairs that share an earlier leaf have been counted there.
    members = np.unique(np.concatenate([i, j]))
    row, leaves = routes(forest, x[members])
    early = leaves < leaf
    row, leaves = row[early], leaves[early]
    fresh = np.ones(len(i), dtype=bool)
    if len(row):
        number = np.unique(leaves, return_inverse=True)[1]
        place = np.full(n, -1)
        place[members] = np.arange(len(members))
        held = np.zeros((len(members), number.max() + 1), dtype=bool)
        held[row, number] = True
        packed = np.packbits(held, axis=1)
        for lo in range(0, len(i), 200_000):
            a, b = place[i[lo : lo + 200_000]], place[j[lo : lo + 200_000]]
            fresh[lo : lo + 200_000] = ~(packed[a] & packed[b]).any(axis=1)
    np.add.at(links, i[fresh], weight[j[fresh]])
    np.add.at(links, j[fresh], weight[i[fresh]])
    while True:
        least = tied.copy()
        np.minimum.at(least, i, tied[j])
        np.minimum.at(least, j, tied[i])
        least = least[least]
        if (least == tied).all():
            return links, tied
        tied = least


def _leaves(nodes: DataFrame, sent) -> DataFrame:
    """One row per vector and leaf that it reaches; ``sent`` has the broadcast forests by length of vector."""
    kind = nodes.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                widths = batch.column(3).slice(lo, 2000)
                for width in widths.unique().to_pylist():
                    part = batch.slice(lo, 2000).filter(pc.equal(widths, width))
                    row, leaf = routes(sent.value[width], _unit(_matrix(part.column(2))))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), *[part.column(k).take(take) for k in range(4)]], ["leaf", "node", "copies", "v", "width"])

    return nodes.select("node", "copies", "v", "width").mapInArrow(run, f"leaf long, node long, copies long, v {kind}, width int")


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links (other vectors linked directly), component_id and kept."""
    ship(df.sparkSession)
    # Components stay as they come (single or double precision); anything else is read as double.
    vector = F.col(vector_col)
    if df.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        vector = vector.cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vector.alias("v"))
    finite = "v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)"
    keyed = materialize(rows.withColumn("node", F.when(F.expr(finite), F.xxhash64("v", F.size("v")))).withColumn("width", F.size("v")), "vectors")
    classes = keyed.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.first("v").alias("v"), F.first("width").alias("width"))
    classes = materialize(classes, "vector-classes")
    forests = {}
    for r in classes.groupBy("width").count().collect():
        # Few vectors of a length are one leaf, and need no sample.
        sample = classes.where(F.col("width") == r["width"]).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").collect() if r["count"] > LEAF else []
        forests[r["width"]] = grow(_unit(np.array([x.v for x in sample])) if sample else np.empty((0, r["width"])), r["count"], r["width"])
    sent = df.sparkSession.sparkContext.broadcast(forests)

    leaves = _leaves(classes, sent)
    # Leaves above CHUNK are dealt out as pairs of chunks; the counts are few and known exactly.
    sizes = leaves.groupBy("width", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    crowded = leaves.join(sizes, ["width", "leaf"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)))
    part = F.pmod(F.xxhash64("node", "leaf"), F.col("parts"))
    crowded = crowded.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tasks = crowded.select("width", "leaf", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") <= F.col("other")).alias("left"), "node", "copies", "v")

    def run(table: pa.Table) -> pa.Table:
        width, leaf, lo, hi = (table.column(k)[0].as_py() for k in ("width", "leaf", "lo", "hi"))
        table = table.sort_by([("left", "descending"), ("node", "ascending")])
        node = table.column("node").to_numpy()
        weight = table.column("copies").to_numpy()
        x = _unit(_matrix(table.column("v").combine_chunks()))
        cross = int(np.count_nonzero(table.column("left").to_numpy())) if lo != hi else 0
        links, tied = _compare(sent.value[width], x, weight, leaf, cross)
        told = (links > 0) | (tied != np.arange(len(tied)))
        return pa.table({"node": node[told], "links": links[told], "tied": node[tied[told]]})

    met = tasks.groupBy("width", "leaf", "lo", "hi").applyInArrow(run, "node long, links long, tied long")
    met = materialize(met, "vector-links")
    counted = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(met.select(F.col("node").alias("a"), F.col("tied").alias("b")).distinct())
    nodes = classes.select("node", "copies", "first").join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    known = nodes.join(smallest, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed.select("id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def oracle_sql() -> str:
    """All pairs by cosine in double precision and their components in DuckDB SQL over ``embeddings``."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), u AS (
  SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) WHERE list_dot_product(a.u, b.u) >= {COSINE}
), reach(node, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT b, root FROM reach JOIN links ON a = node
), roots AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, root AS component_id, vec_id = root AS kept
FROM v JOIN roots ON node = vec_id LEFT JOIN counted ON a = vec_id
"""
