"""Cross-site line dedup by the spread of distinct sites (native, no user functions).

A line is known by the hash of its trimmed text.  HyperLogLog sketches of the sites merge by
aggregation, per line hash, so that a line of every page is one small row per task before the
shuffle.  Lines whose estimate lies clearly above the threshold are boilerplate; those near it
are counted exactly.  Boilerplate lines go from every document, whatever it loses.  A text whose
own copies stand on ``min_sites`` sites or more would lose every line to its copies alone, which
are the document dedup's business; from such a text go the lines that other texts carry as far.

Nulls and edges: null text stays null with no lines; a null site is one site of its own; blank
lines are never removed; repeated rows and ties are
treated alike; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import BLANKS, materialize

MIN_SITES = 6
#: log2 of the sketch's registers: a relative error of 1.6 %, far inside the band that is counted.
LOG_K = 12
BAND = 0.15
#: Boilerplate hashes that may be broadcast (8 MB); above, the lines are joined by a shuffle.
BROADCAST_LINES = 1_000_000


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _lines(df: DataFrame, *extra: str) -> DataFrame:
    """One row per line that isn't blank: the extra columns and the line's hash."""
    line = _trimmed(F.col("line"))
    return (
        df.select(*extra, F.explode(F.split("text", "\n", -1)).alias("line"))
        .where(line != "")
        .select(*extra, F.xxhash64(line).alias("h"))
    )


def boilerplate(df: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (``h``) of the lines of ``df`` (text, site) found on ``min_sites`` sites or more."""
    lines = _lines(df, "site")
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"))
    spread = spread.select("h", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - BAND))
    spread = materialize(spread, "line-spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + BAND)).select("h")
    near = spread.where(F.col("sites") <= min_sites * (1 + BAND)).select("h")
    near = F.broadcast(near) if near.count() <= BROADCAST_LINES else near
    counted = lines.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count("*").alias("sites"))
    return sure.unionAll(counted.where(F.col("sites") >= min_sites).select("h"))


def line_dedup(df: DataFrame, text_col: str = "text", site_col: str = "source", key_col: str = "doc_id", min_sites: int = MIN_SITES) -> DataFrame:
    """``df`` with its text cleaned, ``n_lines`` (of the input) and ``n_removed``."""
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("n"))
    sited = df.select(F.col(text_col).alias("text"), site.alias("site"), F.xxhash64(text_col).alias("t"))
    told = materialize(boilerplate(sited, min_sites), "boilerplate")
    known = F.broadcast(told) if told.count() <= BROADCAST_LINES else told
    copies = sited.where("text IS NOT NULL").select("t", "site").distinct().groupBy("t").agg(F.count("*").alias("sites"))
    copies = materialize(copies.where(F.col("sites") >= min_sites).select("t"), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_LINES else copies
    others = _lines(sited.join(copies, "t", "left_anti"), "site").join(known, "h", "left_semi").distinct()
    others = others.groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h", F.lit(True).alias("others"))
    told = materialize(told.join(others, "h", "left"), "told")
    known = F.broadcast(told) if told.count() <= BROADCAST_LINES else told
    # What a row loses depends on its text alone; the id in the key spreads copies of one text.
    key = F.xxhash64(F.col(key_col), F.col(text_col))
    rows = df.select(key.alias("k"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t")).join(copies.withColumn("copied", F.lit(True)), "t", "left")
    marked = _lines(rows, "k", "copied").join(known, "h").where("copied IS NULL OR others").groupBy("k").agg(F.collect_set("h").alias("gone"))
    taken = {"k": "__key", "gone": "__gone", "lines": "__lines", "left": "__left"}
    out = df.withColumn(taken["k"], key).join(marked.select(F.col("k").alias(taken["k"]), F.col("gone").alias(taken["gone"])), taken["k"], "left")
    out = out.withColumn(taken["lines"], F.split(text_col, "\n", -1))
    left = F.when(F.col(taken["gone"]).isNull(), F.col(taken["lines"])).otherwise(
        F.filter(taken["lines"], lambda x: (_trimmed(x) == "") | ~F.array_contains(F.col(taken["gone"]), F.xxhash64(_trimmed(x))))
    )
    out = out.withColumn(taken["left"], left)
    cleaned = F.array_join(F.col(taken["left"]), "\n")
    changed = F.col(taken["gone"]).isNotNull()
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(taken["lines"])).cast("long")
    n_removed = F.when(changed, F.size(taken["lines"]) - F.size(taken["left"])).otherwise(F.lit(0)).cast("long")
    text = F.when(changed, cleaned).otherwise(F.col(text_col))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in df.columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def oracle_sql(min_sites: int = MIN_SITES) -> str:
    """The same rule, with digests of the kept text, in DuckDB SQL over ``documents``."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, coalesce('s' || source, 'n') AS site,
         CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS lines FROM documents
), copied AS (
  SELECT text FROM d WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT site) >= {min_sites}
), l AS (
  SELECT r, site, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, text IN (FROM copied) AS whole
  FROM (SELECT r, site, text, unnest(lines) AS x FROM d)
), b AS (
  SELECT line, count(DISTINCT site) FILTER (WHERE NOT whole) >= {min_sites} AS others FROM l WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT site) >= {min_sites}
), g AS (
  SELECT r, list(DISTINCT line) AS gone FROM l JOIN b USING (line) WHERE others OR NOT whole GROUP BY r
), k AS (
  SELECT d.*, CASE WHEN gone IS NULL THEN lines ELSE
    list_filter(lines, lambda x: NOT list_contains(gone, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) END AS kept
  FROM d LEFT JOIN g USING (r)
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_removed,
       sha256(CASE WHEN text IS NULL THEN NULL WHEN len(lines) = len(kept) THEN text ELSE array_to_string(kept, chr(10)) END) AS kept_sha256
FROM k
"""
