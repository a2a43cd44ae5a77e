"""Mixing sources to target weights by pivotal dependent rounding (native, no user functions).

Every row of a source should be taken ``target / source size`` times.  The whole part is certain;
the fractions are rounded dependently: two rows meet, and a random transfer of words between them
makes one of the fractions 0 or 1 while the sum of (fraction x size) stays as it is and every
fraction keeps its expectation.  Blocks of about ``BLOCK`` rows fold in parallel and leave one
residual each; residuals of a source meet again in the next level of a reduction tree until one
is left, which is rounded to the nearer side.  Documents above a ``BIG``-th of the target go first
and the others' ratio makes up for their rounding, so that a source's taken words miss its target
by half of a ``BIG``-th at most (where the others have the words to make up for it).

Randomness is a hash of the row and the level, never of the partitioning, so reruns agree.  A hot
source is many blocks from the start.

Nulls and edges: null text has size 0 and is taken 0 times, as is blank text; the null source is a
source of its own, last in order; rows with the same id are separate rows; rows alike in id, text
and source are one row of the rounding with their number, so that they never fill a block; an empty
table gives an empty result; columns besides id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import BLANKS, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 48
#: A document of more than this fraction of its source's target is rounded ahead of the others.
BIG = 50
#: Sources whose figures (under 100 bytes each) may be broadcast; beyond, joins shuffle and Spark splits hot keys.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source key: its size and target.  ``sizes`` has key, source and size (of the source).

    A target is ``min(level x weight, most x size)`` with the one level at which the targets sum
    to ``share`` of all sizes: what capped sources leave over has been reshared by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_need = Window.orderBy("need", "key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("need", F.col("cap") / F.col("weight"))
    # In the order of need the first sources are capped; the level follows from what they leave.
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_need), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_need), F.lit(0.0))
    df = df.withColumn("level_here", left / heavy)
    # Past the first source that is not capped the quotient only falls, so the largest fit is the level.
    level = F.max(F.when(F.col("level_here") <= F.col("need"), F.col("level_here"))).over(every)
    level = F.coalesce(level, F.max("need").over(every))
    return df.select("key", "source_size", F.least(level * F.col("weight"), F.col("cap")).alias("target"))


#: One meeting: the accumulator holds the residual (its fraction in p) and the rows decided so far.
_FOLD = """
aggregate(
  items,
  named_struct('r', CAST(NULL AS {row}), 'done', CAST(array() AS array<{row}>)),
  (s, x) -> CASE
    WHEN s.r IS NULL THEN named_struct('r', x, 'done', s.done)
    ELSE transform(array(named_struct(
        'up', least(s.r.size * (1D - s.r.p), x.size * x.p),
        'down', least(s.r.size * s.r.p, x.size * (1D - x.p)),
        'u', (shiftrightunsigned(xxhash64({level}, s.r.id, s.r.t, x.id, x.t), 11)) / 9007199254740992D)),
      m -> CASE
        WHEN m.u * (m.up + m.down) < m.down THEN
          IF(s.r.size * (1D - s.r.p) <= x.size * x.p,
             named_struct('r', {x_less}, 'done', array_append(s.done, {r_one})),
             named_struct('r', {r_more}, 'done', array_append(s.done, {x_zero})))
        ELSE
          IF(s.r.size * s.r.p <= x.size * (1D - x.p),
             named_struct('r', {x_more}, 'done', array_append(s.done, {r_zero})),
             named_struct('r', {r_less}, 'done', array_append(s.done, {x_one})))
      END)[0]
  END)
"""


def _fold(id_type: str, level: int) -> str:
    row = f"struct<id:{id_type},t:bigint,size:bigint,p:double>"
    with_p = lambda who, p: f"named_struct('id', {who}.id, 't', {who}.t, 'size', {who}.size, 'p', {p})"
    inside = lambda p: f"least(1D, greatest(0D, {p}))"
    return _FOLD.format(
        row=row, level=f"{level}L",
        x_less=with_p("x", inside("x.p - s.r.size * (1D - s.r.p) / x.size")), r_one=with_p("s.r", "1D"),
        r_more=with_p("s.r", inside("s.r.p + x.size * x.p / s.r.size")), x_zero=with_p("x", "0D"),
        x_more=with_p("x", inside("x.p + s.r.size * s.r.p / x.size")), r_zero=with_p("s.r", "0D"),
        r_less=with_p("s.r", inside("s.r.p - x.size * (1D - x.p) / s.r.size")), x_one=with_p("x", "1D"),
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A table of one row a source, marked for broadcast while its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def _alike(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, id, t, size, p) alike, as one: what is left of their parts, and how many of them are certain.

    The words of one move to another of the same size unchanged, so all but one become whole.
    """
    once = materialize(rows.groupBy("key", "id", "t", "size", "p").agg(F.count("*").alias("m")), "mix-alike")
    share = F.col("m") * F.col("p")
    share = F.when(F.abs(share - F.round(share)) < 1e-9, F.round(share)).otherwise(share)
    sure = once.select("key", "id", "t", "size", F.floor(share).alias("n")).where("n > 0")
    return once.withColumn("p", share - F.floor(share)).where("p > 0").drop("m"), sure


def _pivot(rows: DataFrame, id_type: str) -> DataFrame:
    """Round the fractions ``p`` of (key, id, t, size, p); returns (key, id, t, size, n) of those that became 1, alike ones as one row."""
    rows, chosen = _alike(rows)
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    top, keys = counts.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    pending, level = rows.join(_small(counts, keys), "key"), 0
    while top > 0:
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1))
        block = F.pmod(F.xxhash64(F.lit(level), "id", "t", "size"), blocks)
        items = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(level), "id", "t").alias("o"), F.struct("id", "t", "size", "p").alias("x"))))
        folded = pending.groupBy("key", "n", block.alias("block")).agg(F.transform(items, lambda i: i["x"]).alias("items"))
        folded = materialize(folded.select("key", F.expr(_fold(id_type, level)).alias("f")), "mix-level")
        done = folded.select("key", F.explode("f.done").alias("x")).where("x.p = 1").select("key", "x.id", "x.t", "x.size")
        left = folded.select("key", "f.r.*")
        # The next level's block count comes from the residuals that are left of each source.
        counts = left.groupBy("key").agg(F.count("*").alias("n"))
        top, keys = counts.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
        if top <= 1:
            done = done.unionAll(left.where("p >= 0.5").select("key", "id", "t", "size"))
            top = 0
        else:
            pending = left.join(_small(counts, keys), "key")
        chosen = chosen.unionAll(done.withColumn("n", F.lit(1).cast("long")))
        level += 1
    return chosen


def _parts(goal: DataFrame, size: str) -> DataFrame:
    """``whole`` and ``p`` of the ratio of ``target`` to ``size``."""
    ratio = F.when(F.col(size) > 0, F.col("target") / F.col(size)).otherwise(F.lit(0.0))
    ratio = F.least(F.greatest(ratio, F.lit(0.0)), F.col("most"))
    ratio = F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio)
    return goal.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio")).withColumn("p", F.col("ratio") - F.col("whole"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per row: id, ``t`` (hash of the text), size, source_size, target, taken and ``copies``."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), source_key(F.col(source_col)).alias("key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = materialize(rows, "mix-sizes")
    goal = targets(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = materialize(goal.withColumn("most", F.lit(float(most))), "mix-targets")
    big = F.col("size") > F.col("target") / BIG
    keys = goal.count()
    sized = rows.where("size > 0").join(_small(goal, keys), "key")

    # Large documents first: what they miss of their part, the many small ones make up for.
    first = _parts(goal, "source_size").select("key", "source_size", "target", "whole", "p")
    large = rows.where("size > 0").join(_small(first, keys), "key").where(big)
    extra_large = _pivot(large.where("p > 0").select("key", "id", "t", "size", "p"), id_type)
    got = large.groupBy("key").agg(F.sum(F.col("size") * F.col("whole")).alias("sure"), F.sum("size").alias("large_size"))
    rest = goal.join(got, "key", "left")
    extra_large = materialize(extra_large, "mix-large")
    rest = rest.join(extra_large.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("drawn")), "key", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    rest = rest.select("key", "most", (F.col("target") - none("sure") - none("drawn")).alias("target"), (F.col("source_size") - none("large_size")).alias("rest_size"))
    rest = materialize(_parts(rest, "rest_size").select("key", F.col("whole").alias("rest_whole"), "p"), "mix-rest")
    small = sized.where(~big).select("key", "id", "t", "size").join(_small(rest.where("p > 0"), keys), "key").select("key", "id", "t", "size", "p")
    extra_small = _pivot(small, id_type)

    placed = rows.join(_small(first.drop("p"), keys), "key").join(_small(rest.drop("p"), keys), "key")
    placed = placed.withColumn("copies", F.when(big, F.col("whole")).otherwise(F.col("rest_whole")))
    # Rows alike in id, text and source share, in order, the extra copies drawn for them.
    chosen = extra_large.unionAll(extra_small)
    extra = chosen.groupBy(F.col("key").alias("k2"), F.col("id").alias("i2"), F.col("t").alias("t2")).agg(F.sum("n").alias("extra"))
    placed = placed.withColumn("twin", F.row_number().over(Window.partitionBy("key", "id", "t").orderBy("size")))
    on = (F.col("key") == F.col("k2")) & F.col("id").eqNullSafe(F.col("i2")) & (F.col("t") == F.col("t2"))
    placed = placed.join(extra, on, "left").withColumn("copies", F.col("copies") + (F.col("twin") <= F.coalesce("extra", F.lit(0))).cast("long"))
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)).cast("long")
    return placed.select(F.col("id").alias(id_col), "t", "key", "size", "source_size", F.col("target").cast("double").alias("target"), (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    plan = mix(df, id_col, text_col, source_col).where("copies > 0").groupBy(F.col(id_col).alias("__id"), F.col("t").alias("__t"), F.col("key").alias("__key")).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("__copies"))
    # Rows alike in these may differ elsewhere: their order is that of the whole row's hash.
    twin = Window.partitionBy("__i", "__h", "__s").orderBy(F.xxhash64(*df.columns))
    keyed = df.withColumns({"__i": F.col(id_col), "__h": F.xxhash64(text_col), "__s": source_key(F.col(source_col))}).withColumn("__twin", F.row_number().over(twin))
    on = F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__t")) & (F.col("__s") == F.col("__key"))
    times = F.coalesce(F.try_element_at("__copies", F.col("__twin")), F.lit(0)).cast("int")
    return keyed.join(plan, on).withColumn("__one", F.explode(F.array_repeat(F.lit(1), times))).select(*df.columns)


def targets_sql(weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> str:
    """Sizes and targets of the sources of ``documents`` in DuckDB SQL: the level is tried after every number of capped sources."""
    weight = f"list_extract([{', '.join(f'{w}::DOUBLE' for w in weights)}], CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(weights)} + 1 AS BIGINT))"
    return f"""
WITH d AS (
  SELECT source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS size FROM documents
), s AS (
  SELECT source, sum(size) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, {weight} AS weight FROM s
), n AS (
  SELECT *, {most} * source_size AS cap, {most} * source_size / weight AS need, row_number() OVER (ORDER BY {most} * source_size / weight, source) AS k FROM w
), tried AS (
  SELECT b.k, ({share} * (SELECT sum(source_size) FROM n) - coalesce(sum(a.cap), 0)) / ((SELECT sum(weight) FROM n) - coalesce(sum(a.weight), 0)) AS level, any_value(b.need) AS need
  FROM n b LEFT JOIN n a ON a.k < b.k GROUP BY b.k
), l AS (
  SELECT coalesce(max(level) FILTER (WHERE level <= need), (SELECT max(need) FROM n)) AS level FROM tried
)
SELECT source, CAST(source_size AS BIGINT) AS source_size, round(least(level * weight, cap), 6) AS target FROM n CROSS JOIN l
"""
