"""Vector functions over ``array<double>`` columns; everything stays inside the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12


def double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, not once per element of a lambda around it."""
    return F.transform(F.array(value), use)[0]


def l2_normalise(vec: Column) -> Column:
    """Unit vector; the norm is never taken below 1e-12."""
    return let(F.greatest(norm(vec), F.lit(EPSILON)), lambda n: F.transform(vec, lambda x: x / n))


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def is_nonzero(vec: Column) -> Column:
    return F.exists(vec, lambda x: x != 0)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mean_of(*vecs: Column) -> Column:
    """Element-wise mean of several vectors of one row."""
    total = vecs[0]
    for v in vecs[1:]:
        total = add(total, v)
    return F.transform(total, lambda x: x / len(vecs))


def _sum(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x)


def softmax(vec: Column) -> Column:
    raised = let(F.array_max(vec), lambda m: F.transform(vec, lambda x: F.exp(x - m)))
    return let(raised, lambda e: let(_sum(e), lambda t: F.transform(e, lambda x: x / t)))


def layer_norm(vec: Column, epsilon: float = 1e-5) -> Column:
    """Zero mean and unit (population) variance over the elements."""
    centred = let(_sum(vec) / F.size(vec), lambda m: F.transform(vec, lambda x: x - m))
    spread = lambda c: F.sqrt(dot(c, c) / F.size(c) + epsilon)
    return let(centred, lambda c: let(spread(c), lambda d: F.transform(c, lambda x: x / d)))


def weighted_mean(df: DataFrame, keys: list[str], vec: str, weight: Column | None = None, out: str = "vec") -> DataFrame:
    """Mean vector per key.  One aggregate whatever the width, with partial sums before the shuffle."""
    packed = df.select(*keys, array_to_vector(double(F.col(vec))).alias("__v"), (F.lit(1.0) if weight is None else weight).alias("__w"))
    summed = packed.groupBy(*keys).agg(Summarizer.mean(F.col("__v"), F.col("__w")).alias("__m"))
    return summed.select(*keys, vector_to_array("__m").alias(out))


def explode_vector(df: DataFrame, keys: list[str], vec: str = "vec", digits: int = 6) -> DataFrame:
    """(keys, dim, value) rows of a vector column; -0.0 becomes 0.0."""
    return df.select(*keys, F.posexplode(vec).alias("dim", "value")).select(*keys, "dim", (F.round("value", digits) + F.lit(0.0)).alias("value"))
