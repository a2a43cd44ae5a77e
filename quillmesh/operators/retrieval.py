"""Exact cosine ranking of every candidate for every query, top-k and result metadata.

The comparison runs in blocks: candidates and queries are dealt into a grid of blocks, and each
cell is one matrix product whose similarities are reduced at once (to counts above the target's,
or to the k best), so the full matrix never exists.  Where the candidates fit ``BROADCAST_BYTES``
they go out once and the queries stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import first_line, or_else
from quillmesh.functions.towers import matrix, unit
from quillmesh.functions.vectors import dot, double, l2_normalise
from quillmesh.plans.session import ship

#: Candidates (8 bytes a component) that may be broadcast.
BROADCAST_BYTES = 64_000_000
#: Rows of a block of queries or candidates in the grid.
BLOCK = 16_384
#: Similarities are compared at this precision, so that ties don't hang on the order of a sum.
DIGITS = 10


def _candidate_blocks(candidates: DataFrame) -> tuple[str, object, int]:
    """('broadcast', (ids, unit vectors)) or ('grid', number of blocks), by a count and the width."""
    rows = candidates.count()
    first = candidates.select(F.size("emb").alias("n")).first()
    if rows * ((first["n"] if first else 0) + 1) * 8 <= BROADCAST_BYTES:
        table = candidates.select(F.col("paper_id").cast("long"), double(F.col("emb")).alias("emb")).toArrow().combine_chunks()
        if not rows:
            return "broadcast", (np.empty(0, dtype=np.int64), np.empty((0, 0))), 0
        return "broadcast", (table.column(0).to_numpy(), unit(matrix(table.column(1).combine_chunks()))), rows
    return "grid", -(-rows // BLOCK), rows


def _over_candidates(queries: DataFrame, candidates: DataFrame, reduce, schema: str) -> DataFrame:
    """``reduce(ids, vectors, batch)`` over every (query batch, candidate block)."""
    ship(queries.sparkSession)
    kind, held, _ = _candidate_blocks(candidates)
    if kind == "broadcast":
        sent = queries.sparkSession.sparkContext.broadcast(held)

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    yield from reduce(*sent.value, batch.slice(lo, 256))

        return queries.mapInArrow(flat, schema)
    # A cell of the grid holds one block of queries and one of candidates, whatever their numbers.
    across = max(1, -(-queries.count() // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    spread = queries.withColumn("row", own("query_id", across)).withColumn("col", every(held))
    dealt = candidates.select(F.col("paper_id").cast("long").alias("paper_id"), double(F.col("emb")).alias("emb"), own("paper_id", held).alias("col")).withColumn("row", every(across))
    empty = _empty(schema)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        vectors = unit(matrix(right.column("emb").combine_chunks()))
        out = []
        for batch in left.drop_columns(["row", "col"]).combine_chunks().to_batches(256):
            out += reduce(right.column("paper_id").to_numpy(), vectors, batch)
        return pa.Table.from_batches(out) if out else empty

    return spread.groupBy("row", "col").cogroup(dealt.groupBy("row", "col")).applyInArrow(cell, schema)


def _empty(schema: str) -> pa.Table:
    """A table without rows of a schema of long and double columns."""
    fields = [f.split() for f in schema.split(",")]
    return pa.table({name: pa.array([], {"long": pa.int64(), "double": pa.float64()}[kind]) for name, kind in fields})


def with_target(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, cited_paper_id, emb, target): the similarity of the true candidate; others drop out."""
    known = candidates.select(F.col("paper_id").alias("cited_paper_id"), l2_normalise(double(F.col("emb"))).alias("t"))
    joined = queries.join(known, "cited_paper_id")
    own = l2_normalise(double(F.col("emb")))
    return joined.select(F.col("query_id").cast("long").alias("query_id"), F.col("cited_paper_id").cast("long").alias("cited_paper_id"), double(F.col("emb")).alias("emb"), F.round(dot(own, F.col("t")), DIGITS).alias("target"))


def skipped(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Queries whose target is no candidate."""
    return queries.join(candidates.select(F.col("paper_id").alias("cited_paper_id")), "cited_paper_id", "left_anti")


def rank_targets(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, cited_paper_id, rank): one more than the candidates that are strictly closer.

    Ties don't push the target down; NaN similarities count as not closer.
    """

    def reduce(ids: np.ndarray, vectors: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows or not len(ids):
            return
        score = np.round(unit(matrix(batch.column(2))) @ vectors.T, DIGITS)
        above = score > batch.column(3).to_numpy()[:, None]
        above &= ids[None, :] != batch.column(1).to_numpy()[:, None]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(above.sum(axis=1).astype(np.int64))], ["query_id", "cited_paper_id", "above"])

    counted = _over_candidates(with_target(queries, candidates), candidates, reduce, "query_id long, cited_paper_id long, above long")
    return counted.groupBy("query_id", "cited_paper_id").agg((F.sum("above") + 1).alias("rank"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, paper_id, score) of the k most similar candidates; ties by id."""

    def reduce(ids: np.ndarray, vectors: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows or not len(ids):
            return
        score = np.round(unit(matrix(batch.column(1))) @ vectors.T, DIGITS)
        own = np.repeat(np.arange(len(score)), len(ids)).reshape(score.shape)
        if k < len(ids):
            # Everything from the k-th score up stays, so that ties at the edge are told by id below.
            edge = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            keep = score >= edge[:, None]
        else:
            keep = np.ones(score.shape, dtype=bool)
        row, place = own[keep], np.broadcast_to(np.arange(len(ids)), score.shape)[keep]
        order = np.lexsort((ids[place], -score[row, place], row))
        row, place = row[order], place[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, place = row[nth < k], place[nth < k]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(ids[place]), pa.array(score[row, place])], ["query_id", "paper_id", "score"])

    plain = queries.select(F.col("query_id").cast("long").alias("query_id"), double(F.col("emb")).alias("emb"))
    found = _over_candidates(plain, candidates, reduce, "query_id long, paper_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "paper_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "paper_id", "score")


def pick_titles(titles: DataFrame) -> DataFrame:
    """(uri, title): the longest title that is untagged or English; of equal lengths the first in order."""
    usable = titles.where(F.col("lang").isNull() | F.col("lang").isin("", "en"))
    best = usable.groupBy("uri").agg(F.min(F.struct((-F.length("title")).alias("n"), F.col("title"))).alias("x"))
    return best.select("uri", "x.title")


def with_uri(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """Results with the paper's URI; a paper that the index doesn't know is called by its id."""
    known = nodes.select(F.col("id").alias("paper_id"), "uri")
    return results.join(known, "paper_id", "left").withColumn("uri", F.coalesce("uri", F.concat(F.lit("id:"), F.col("paper_id").cast("string"))))


def with_metadata(results: DataFrame, titles: DataFrame, abstracts: DataFrame, digits: int = 4) -> DataFrame:
    """Results with a title: the paper's, else the first line of its abstract, else a placeholder."""
    named = results.join(titles.select(F.col("id").alias("paper_id"), "title"), "paper_id", "left").join(abstracts.select(F.col("id").alias("paper_id"), "text"), "paper_id", "left")
    fallback = or_else(first_line(F.col("text")), F.lit("(no title)"))
    return named.select("query_id", "rank", F.round("score", digits).alias("score"), "paper_id", or_else(F.col("title"), fallback).alias("title"))
