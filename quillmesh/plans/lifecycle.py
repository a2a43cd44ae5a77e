"""End-to-end plans: building the feature tables, evaluating a model, recommending papers."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.encode import encode, hashed_bag
from quillmesh.functions.text import strip
from quillmesh.functions.towers import ContextTower, PaperTower, embed
from quillmesh.operators import graph, metrics, propagate, records, retrieval

Encoder = Callable[[DataFrame, str, str, str], DataFrame]


def load_config(path: str) -> dict[str, Any]:
    """An experiment's settings; a key that is asked for and missing is an error."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def build_graph(triples: DataFrame, v: graph.Vocabulary) -> dict[str, DataFrame]:
    """nodes, cites, citing and cited edges."""
    nodes = graph.node_index(triples, v).cache()
    papers, citations = nodes.where("kind = 'paper'"), nodes.where("kind = 'citation'")
    return {
        "nodes": nodes,
        "cites": graph.edges(triples, v.cites, papers, papers),
        "citing": graph.edges(triples, v.has_citing, citations, papers),
        "cited": graph.edges(triples, v.has_cited, citations, papers),
    }


def build_features(triples: DataFrame, contexts: DataFrame, abstracts: DataFrame, v: graph.Vocabulary, position: str, width: int = 64, encoder: Encoder | None = None) -> dict[str, DataFrame]:
    """(id, vec) tables per metapath key.  Citing-passage vectors are kept as ``C``."""
    encoder = encoder or hashed_bag(width)
    built = build_graph(triples, v)
    papers = built["nodes"].where("kind = 'paper'")
    citations = built["nodes"].where("kind = 'citation'")
    corpus = papers.where("is_corpus").join(abstracts, "uri").select("id", strip(F.col("text")).alias("text"))
    external = papers.where("NOT is_corpus").join(graph.passages(triples, v), "uri").select("id", "text")
    own = encode(corpus, "id", "text", encoder).unionAll(propagate.mean_pool(encode(external, "id", "text", encoder), "id"))
    features = {"P": propagate.assemble(papers, own, width)}
    cited = records.citation_texts(contexts, citations, position)
    features["C"] = propagate.assemble(citations, encode(cited, "id", "text", encoder), width)
    features["PP"] = propagate.assemble(papers, propagate.metapath_pp(built["cites"], features["P"], width), width)
    features["PCP"] = propagate.assemble(papers, propagate.metapath_pcp(built["cited"], features["P"], width), width)
    features["PCCon"] = propagate.assemble(papers, propagate.metapath_pccon(built["cited"], features["C"], width), width)
    return features


def build_datasets(contexts: DataFrame, papers: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Valid records with their split; all records of a citing paper are on one side."""
    valid = records.citation_records(contexts, papers)
    return valid.join(records.group_split(valid, "citing_uri", seed, train, val), "citing_uri")


def build_index(tower: PaperTower, features: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """(paper_id, emb) of the candidate papers."""
    joined = ids.select("id").distinct()
    for key in tower.feat_keys:
        joined = joined.join(features[key].select("id", F.col("vec").alias(key)), "id")
    return embed(joined, tower, "id", tower.feat_keys).withColumnRenamed("id", "paper_id")


def embed_contexts(tower: ContextTower, texts: DataFrame, id_col: str, text_col: str, encoder: Encoder | None = None) -> DataFrame:
    """(query_id, emb) of passages."""
    return embed(encode(texts, id_col, text_col, encoder or hashed_bag(tower.nfeat)), tower, id_col, ["vec"]).withColumnRenamed(id_col, "query_id")


def evaluate(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of metrics of (query_id, cited_paper_id, emb) against (paper_id, emb)."""
    ranks = retrieval.rank_targets(queries, candidates).cache()
    left_out = retrieval.skipped(queries, candidates).agg(F.count("*").alias("n_skipped"))
    total = candidates.agg(F.count("*").alias("total_candidates"))
    return metrics.ranking_metrics(ranks).join(metrics.median_rank(ranks)).join(left_out).join(total)


def recommend(spark: SparkSession, text: str, tower: ContextTower, index: DataFrame, titles: DataFrame, abstracts: DataFrame, topk: int = 10, encoder: Encoder | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(rank, score, paper_id, title) of the papers to cite for one passage, and their uri where ``nodes`` tells it."""
    query = embed_contexts(tower, spark.createDataFrame([(0, text.strip())], "query_id long, text string"), "query_id", "text", encoder)
    found = retrieval.with_metadata(retrieval.top_k(query, index, topk), titles, abstracts)
    if nodes is None:
        return found.select("rank", "score", "paper_id", "title").orderBy("rank")
    return retrieval.with_uri(found, nodes).select("rank", "score", "paper_id", "uri", "title").orderBy("rank")


def interactive(ask: Callable[[str], str], answer: Callable[[str], None]) -> int:
    """Prompt until an empty line, ``:quit`` or the end of input; returns the number of answers."""
    n = 0
    while True:
        try:
            text = ask("Query> ").strip()
        except EOFError:
            return n
        if text in ("", ":quit"):
            return n
        answer(text)
        n += 1
