"""Text encoders: a deterministic hashed bag of words, and a table of precomputed vectors.

Words and their hashes are built-in expressions.  Pretrained weights are not part of this package:
any callable from texts to vectors can take the place of the hashed bag in :func:`encode`, and
:func:`precomputed` takes vectors that some other program has made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.plans.session import ship

WORD = r"[\p{L}\p{N}_]+"
#: Ids of words are 1 to this.
VOCABULARY = 30_000


def tokens(text: Column, limit: int | None = None) -> Column:
    """Stable ids of the words of a text, of the first ``limit`` where one is given; null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    found = found if limit is None else F.slice(found, 1, limit)
    return F.transform(found, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % VOCABULARY + 1).cast("int"))


def tokenise(df: DataFrame, id_col: str, text_col: str, limit: int = 256) -> DataFrame:
    """(id, tokens) without padding, cut at ``limit`` as the towers' input is."""
    return df.select(id_col, tokens(F.col(text_col), limit).alias("tokens"))


def bag(ids: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors of signed word counts for rows of ``sizes`` words each; a row without words is the zero vector."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    sign = np.where((ids // width) % 2, 1.0, -1.0)
    out = np.bincount(rows * width + ids % width, weights=sign, minlength=len(sizes) * width).reshape(len(sizes), width)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def hashed_bag(width: int = 64, limit: int | None = None) -> Callable[[DataFrame, str, str, str], DataFrame]:
    """An encoder of whole texts (or of their first ``limit`` words) into ``width`` components."""

    def apply(df: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
        ship(df.sparkSession)
        id_type = df.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(1)
                made = bag(column.flatten().to_numpy().astype(np.int64), np.diff(column.offsets.to_numpy()), width)
                offsets = pa.array(np.arange(0, made.size + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))], [id_col, out])

        return df.select(id_col, tokens(F.col(text_col), limit).alias("tokens")).mapInArrow(run, f"`{id_col}` {id_type}, `{out}` array<double>")

    return apply


def from_texts(encoder: Callable[[list[str | None]], np.ndarray], block: int = 512) -> Callable[[DataFrame, str, str, str], DataFrame]:
    """An encoder from any callable of texts to a matrix of vectors, a block of rows at a time."""

    def apply(df: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
        ship(df.sparkSession)
        id_type = df.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lo in range(0, len(batch), block):
                    part = batch.iloc[lo : lo + block]
                    yield pd.DataFrame({id_col: part[id_col], out: list(encoder(part[text_col].tolist()))})

        return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {id_type}, `{out}` array<double>")

    return apply


def encode(df: DataFrame, id_col: str, text_col: str, encoder: Callable[[DataFrame, str, str, str], DataFrame] | None = None, out: str = "vec") -> DataFrame:
    """(id, vector) of every row, by the hashed bag unless another encoder is given; blank text has the zero vector."""
    return (encoder or hashed_bag())(df, id_col, text_col, out)


def precomputed(vectors: DataFrame) -> Callable[[DataFrame, str, str, str], DataFrame]:
    """An encoder by lookup in a table (text, vec) of vectors made elsewhere; texts without one are left out."""

    def apply(df: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
        known = vectors.select(F.col("text").alias("__text"), F.col("vec").cast("array<double>").alias(out))
        return df.join(known, F.col(text_col) == F.col("__text")).select(id_col, out)

    return apply


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(text, vec) of a Parquet table of precomputed vectors."""
    return spark.read.parquet(path).select("text", F.col("vec").cast("array<double>").alias("vec"))
