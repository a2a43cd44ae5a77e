"""Command line: ``build`` feature tables, ``train`` towers, ``evaluate`` ranked queries, ``recommend`` for a passage.

``build`` writes a data folder; ``train`` reads it as an experiment's file says and saves the best
checkpoint; ``evaluate`` and ``recommend`` read a checkpoint and its data folder.  Ready embeddings
can be evaluated too: candidates (paper_id, emb) and queries (query_id, cited_paper_id, emb).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import graph, metrics, retrieval
from quillmesh.operators.graph import Vocabulary
from quillmesh.plans import experiment, lifecycle, report, training
from quillmesh.plans.session import ship
from quillmesh.sources import json_maps, turtle


def _arguments(words: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="quillmesh", description=__doc__.splitlines()[0])
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build")
    for name in ("graph", "contexts", "abstracts", "paper-prefix", "citation-prefix", "out"):
        build.add_argument(f"--{name}", required=True)
    build.add_argument("--ontology", default="")
    build.add_argument("--width", type=int, default=64)
    build.add_argument("--vectors", help="Parquet (text, vec) of vectors made elsewhere, in place of the hashed bag")
    train = sub.add_parser("train")
    train.add_argument("--config", required=True)
    train.add_argument("--vectors")
    evaluate = sub.add_parser("evaluate")
    for name in ("queries", "candidates", "checkpoint", "data", "vectors", "out"):
        evaluate.add_argument(f"--{name}")
    evaluate.add_argument("--split", default="test")
    recommend = sub.add_parser("recommend")
    for name in ("checkpoint", "data"):
        recommend.add_argument(f"--{name}", required=True)
    for name in ("vectors", "query"):
        recommend.add_argument(f"--{name}")
    recommend.add_argument("--topk", type=int, default=50)
    return top.parse_args(words)


def main(words: list[str] | None = None) -> None:
    args = _arguments(words)
    spark = SparkSession.builder.appName(f"quillmesh {args.command}").getOrCreate()
    ship(spark)
    if args.command == "build":
        vocabulary = Vocabulary(args.paper_prefix, args.citation_prefix, args.ontology)
        contexts = json_maps.read_contexts(spark, args.contexts)
        # The order of a JSON array is its file order; ids grow with it within one file.
        contexts = contexts.withColumn("line", F.monotonically_increasing_id())
        triples, abstracts = turtle.read_turtle(spark, args.graph).cache(), json_maps.read_text_map(spark, args.abstracts)
        encoder = experiment.encoder(spark, args.width, None, args.vectors)
        features = lifecycle.build_features(triples, contexts, abstracts, vocabulary, "line", args.width, encoder)
        for name, table in features.items():
            json_maps.write_table(table, f"{args.out}/feat_{name}")
        nodes = graph.node_index(triples, vocabulary)
        json_maps.write_table(nodes, f"{args.out}/nodes")
        json_maps.write_node_index(nodes, f"{args.out}/node_index.json")
        json_maps.write_table(contexts.drop("line"), f"{args.out}/contexts")
        titles = triples.where(F.col("p") == vocabulary.title).select(F.col("s").alias("uri"), F.col("o").alias("title"), "lang")
        json_maps.write_table(retrieval.pick_titles(titles).join(nodes.select("uri", "id"), "uri").select("id", "title"), f"{args.out}/titles")
        json_maps.write_table(abstracts.join(nodes.select("uri", "id"), "uri").select("id", "text"), f"{args.out}/abstracts")
    elif args.command == "train":
        told = experiment.run(spark, lifecycle.load_config(args.config), args.vectors)
        print(f"best MRR {told['best_mrr']:.4f} at epoch {told['best_epoch']} of {told['epochs_run']}")
    elif args.command == "evaluate":
        if args.checkpoint:
            context, paper, about = training.load(args.checkpoint)
            cfg = about["config"]
            data = experiment.Data(spark, args.data, paper.feat_keys, cfg["max_length"], cfg["seed"], args.vectors)
            rows = data.split(args.split)
            queries = lifecycle.embed(rows.select("record_id", "vec"), context, "record_id", ["vec"]).withColumnRenamed("record_id", "query_id")
            queries, candidates = queries.join(rows.select(F.col("record_id").alias("query_id"), "cited_paper_id"), "query_id"), data.index(paper)
        else:
            queries, candidates = spark.read.parquet(args.queries), spark.read.parquet(args.candidates)
        found = lifecycle.evaluate(queries, candidates).cache()
        print(report.metrics_report(found, metrics.rank_distribution(retrieval.rank_targets(queries, candidates))))
        if args.out:
            json_maps.write_records(found, args.out)
    else:
        context, paper, about = training.load(args.checkpoint)
        data = experiment.Data(spark, args.data, paper.feat_keys, about["config"]["max_length"], about["config"]["seed"], args.vectors)
        index = data.index(paper).cache()
        titles, abstracts = spark.read.parquet(f"{args.data}/titles"), spark.read.parquet(f"{args.data}/abstracts")
        show = lambda text: print(report.results_report(lifecycle.recommend(spark, text, context, index, titles, abstracts, args.topk, data.encoder, data.nodes)))
        if args.query is not None:
            show(args.query)
        else:
            lifecycle.interactive(input, show)


if __name__ == "__main__":
    main()
