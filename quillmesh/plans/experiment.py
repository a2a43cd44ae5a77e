"""A training run from an experiment's file: datasets, towers, best checkpoint, test curve and history.

``data_root`` holds what the ``build`` command writes: ``nodes`` (kind, uri, is_corpus, id), a table
``feat_<key>`` (id, vec) per metapath, and ``contexts`` (the citation records).  Tables go through Spark; a run's
few result files are written by the driver.
"""

from __future__ import annotations

import json
import os
import time
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.encode import encode, hashed_bag, precomputed, read_vectors
from quillmesh.functions.towers import ContextTower, PaperTower
from quillmesh.operators.graph import dense_ids
from quillmesh.plans import lifecycle, training

BEST, CURVE, HISTORY, CONFIG = "best_model.npz", "test_curve.json", "history.json", "config.json"


def settings(cfg: dict[str, Any]) -> training.Settings:
    """The settings of a run; a key that is missing is an error."""
    return training.Settings(
        epochs=cfg["epochs"], batch_size=cfg["batch_size"], temperature=cfg["temperature"], lr_head=cfg["lr_head"], lr_paper=cfg["lr_paper"], patience=cfg["patience"],
        lr_encoder=cfg["lr_scibert"], input_drop=cfg["input_drop"], dropout=cfg["dropout"], att_drop=cfg["att_drop"], seed=cfg["seed"],
    )


def towers(cfg: dict[str, Any], nfeat: int) -> tuple[ContextTower, PaperTower]:
    """Both towers with fresh weights."""
    paper = PaperTower(cfg["feat_keys"], nfeat, cfg["hidden"], cfg["embed_dim"], cfg["n_fp_layers"], cfg["num_heads"], cfg["act"], cfg["residual"], cfg["use_mlp"])
    return ContextTower(nfeat, cfg["embed_dim"], tuned=True).initialise(cfg["seed"]), paper.initialise(cfg["seed"])


def encoder(spark: SparkSession, width: int, max_length: int | None, vectors: str | None) -> lifecycle.Encoder:
    """The encoder of passages: a table of vectors made elsewhere, or the hashed bag of the first words."""
    return precomputed(read_vectors(spark, vectors)) if vectors else hashed_bag(width, max_length)


class Data:
    """Nodes, features, candidates and encoded records of a data folder."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], max_length: int | None, seed: int, vectors: str | None = None) -> None:
        self.spark = spark
        self.nodes = spark.read.parquet(f"{root}/nodes").where("kind = 'paper'").select("uri", "id", "is_corpus")
        self.features = {k: spark.read.parquet(f"{root}/feat_{k}") for k in sorted(keys)}
        first = next(iter(self.features.values()))
        self.width = len(first.first()["vec"])
        self.encoder = encoder(spark, self.width, max_length, vectors)
        self.joined = self.nodes.select("id")
        for k, table in self.features.items():
            self.joined = self.joined.join(table.select("id", F.col("vec").alias(k)), "id")
        split = lifecycle.build_datasets(spark.read.parquet(f"{root}/contexts"), self.nodes, seed=seed)
        numbered = dense_ids(split, ["citing_uri", "cited_uri", "context_text", "context_group_id", "citation_type"], "record_id")
        passages = encode(numbered.select("record_id", "context_text"), "record_id", "context_text", self.encoder)
        self.records = numbered.join(passages, "record_id").cache()

    def split(self, name: str) -> DataFrame:
        return self.records.where(F.col("split") == name)

    def index(self, paper: PaperTower) -> DataFrame:
        """Embeddings of all candidates, corpus and external alike."""
        return lifecycle.build_index(paper, self.features, self.nodes)

    def metrics(self, context: ContextTower, paper: PaperTower, name: str) -> dict[str, Any]:
        """Ranking metrics of one split's records; without answerable queries the rates are null."""
        rows = self.split(name)
        embedded = lifecycle.embed(rows.select("record_id", "vec"), context, "record_id", ["vec"]).withColumnRenamed("record_id", "query_id")
        asked = embedded.join(rows.select(F.col("record_id").alias("query_id"), "cited_paper_id"), "query_id")
        return lifecycle.evaluate(asked, self.index(paper)).first().asDict()


def run(spark: SparkSession, cfg: dict[str, Any], vectors: str | None = None) -> dict[str, Any]:
    """Train as the experiment says; writes config, best checkpoint, test curve and history, and returns the history."""
    folder = os.path.join(os.path.expanduser(cfg["output_dir"]), cfg["experiment_name"])
    os.makedirs(folder, exist_ok=True)

    def write(name: str, content: Any) -> None:
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            json.dump(content, f, indent=2)

    write(CONFIG, cfg)
    data = Data(spark, os.path.expanduser(cfg["data_root"]), cfg["feat_keys"], cfg["max_length"], cfg["seed"], vectors)
    context, paper = towers(cfg, data.width)
    own = settings(cfg)
    curve: list[dict] = []

    def validate(tower: ContextTower, frozen: dict[str, np.ndarray]) -> dict:
        before = PaperTower(cfg["feat_keys"], paper.nfeat, paper.hidden, paper.embed_dim, paper.n_fp_layers, paper.num_heads, paper.act, paper.residual, paper.use_mlp, frozen)
        return data.metrics(tower, before, "val")

    def improved(epoch: int, entry: dict) -> None:
        training.save(os.path.join(folder, BEST), context, paper, {"epoch": epoch, "val_mrr": entry["mrr"], "metrics": entry, "config": cfg})

    def tested(epoch: int) -> None:
        curve.append({"epoch": epoch} | data.metrics(context, paper, "test"))
        write(CURVE, {"experiment_name": cfg["experiment_name"], "test_eval_every": cfg["test_eval_every"], "history": curve})

    began = time.time()
    epochs = lambda epoch: training.batches(data.split("train"), data.joined, sorted(cfg["feat_keys"]), own, epoch)
    history = training.train(context, paper, epochs, validate, own, training.Watch(improved, tested, cfg["test_eval_every"]))
    best = max((h for h in history if h["improved"]), key=lambda h: h["mrr"], default=None)
    told = {
        "best_mrr": best["mrr"] if best else 0.0, "best_epoch": best["epoch"] if best else 0, "total_training_time_h": round((time.time() - began) / 3600, 4),
        "epochs_run": len(history), "history": history, "test_history": curve,
    }
    write(HISTORY, told)
    return told
