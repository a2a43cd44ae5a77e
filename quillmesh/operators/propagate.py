"""Feature assembly and propagation along metapaths by weighted neighbour means."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.vectors import double, is_nonzero, let, weighted_mean, zeros
from quillmesh.operators.graph import cocitation, transpose


def assemble(nodes: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """(id, vec) of every node; a node without a feature has the zero vector."""
    known = features.select(F.col("id").alias("id"), double(F.col("vec")).alias("vec"))
    return nodes.select("id").join(known, "id", "left").select("id", F.coalesce("vec", zeros(width)).alias("vec"))


def mean_pool(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Mean vector of all rows of a key, repeats included."""
    return weighted_mean(rows, [key], vec)


def nonzero_rows(features: DataFrame) -> DataFrame:
    return features.where(is_nonzero(F.col("vec")))


def propagate(edges: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """Weighted mean of the neighbours' vectors per source node of ``edges``.

    A neighbour without a vector counts as a zero vector in the mean; a row whose weights sum to
    less than 1e-9 is divided by that instead.
    """
    known = features.select(F.col("id").alias("dst"), array_to_vector(double(F.col("vec"))).alias("v"))
    filled = F.coalesce("v", array_to_vector(zeros(width)))
    weight = F.greatest("w", F.lit(1e-300))  # the summarizer wants some weight
    summed = edges.join(known, "dst", "left").groupBy("src").agg(Summarizer.mean(filled, weight).alias("m"), F.sum("w").alias("degree"))
    scale = F.col("degree") / F.greatest("degree", F.lit(1e-9))
    return summed.select(F.col("src").alias("id"), let(scale, lambda k: F.transform(vector_to_array("m"), lambda x: x * k)).alias("vec"))


def metapath_pp(cites: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """Mean of the cited papers' vectors; self-citations count."""
    return propagate(cites, features, width)


def metapath_pcp(cited: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """Mean of the co-cited papers' vectors, weighted by how often; ``cited`` is citation -> paper."""
    return propagate(cocitation(cited), features, width)


def metapath_pccon(cited: DataFrame, passages: DataFrame, width: int) -> DataFrame:
    """Mean vector of the passages that cite a paper."""
    return propagate(transpose(cited), passages, width)


def metapath(steps: list[DataFrame], features: DataFrame, width: int) -> DataFrame:
    """Chain of propagation steps, the last one first (two steps of ``cites`` give PPP)."""
    out = features
    for edges in reversed(steps):
        out = propagate(edges, out, width)
    return out


def missing_texts(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, uri) of the nodes without a text, or with a blank one only."""
    from quillmesh.functions.text import has_text

    return nodes.select("id", "uri").join(texts.where(has_text(F.col("text"))).select("uri"), "uri", "left_anti").select("id", "uri")
