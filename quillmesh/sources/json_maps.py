"""JSON documents of the data model: nested maps, ordered lists, record arrays; and their writers."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.graph import dense_ids

CONTEXTS = "context string, cited_uri string, citing_uri string, citing_idx int, citation_type string, context_group_id bigint"


def _document(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("j"))


def read_node_index(spark: SparkSession, path: str) -> DataFrame:
    """(kind, uri, id) of ``{kind: {uri: id}}``."""
    outer = _document(spark, path, "map<string,map<string,int>>").select(F.explode("j").alias("kind", "m"))
    return outer.select("kind", F.explode("m").alias("uri", "id"))


def read_uri_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, uri) of a list; the position is the id."""
    return _document(spark, path, "array<string>").select(F.posexplode("j").alias("id", "uri"))


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Citation context records of an array of objects; missing keys are null."""
    return spark.read.option("multiLine", True).schema(CONTEXTS).json(path)


def read_context_lines(spark: SparkSession, path: str) -> DataFrame:
    """Citation context records of JSON lines, which split; missing keys are null."""
    return spark.read.schema(CONTEXTS).json(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(uri, text) of lines that are each a ``{uri: text}``, which split."""
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("uri", "text"))


def read_text_map(spark: SparkSession, path: str, optional: bool = True) -> DataFrame:
    """(uri, text) of ``{uri: text}``; no rows where an optional file is missing."""
    try:
        return _document(spark, path, "map<string,string>").select(F.explode("j").alias("uri", "text"))
    except AnalysisException:
        if not optional:
            raise
        return spark.createDataFrame([], "uri string, text string")


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def _write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """The column ``value`` as one text file; the rows are sorted over ranges and pass through the writer one by one."""
    lines.orderBy(*order).select("value").coalesce(1).write.mode("overwrite").text(path)


def _framed(lines: DataFrame, first: str, last: str) -> DataFrame:
    """(place, value) with a first and a last line; places are from 0."""
    frame = lines.sparkSession.createDataFrame([(-1, first), ((1 << 62), last)], "place long, value string")
    return lines.select(F.col("place").cast("long").alias("place"), "value").unionAll(frame)


def write_node_index(nodes: DataFrame, path: str) -> None:
    """``{kind: {uri: id}}``, one entry per line in the order of ids, which are from 0 in each kind."""
    entry = F.concat(F.when(F.col("id") > 0, F.lit(",")).otherwise(F.lit("")), _quoted(F.col("uri")), F.lit(": "), F.col("id").cast("string"))
    lines = nodes.select("kind", F.col("id").cast("long").alias("place"), entry.alias("value"))
    kinds = [r.kind for r in nodes.select("kind").distinct().orderBy("kind").collect()]  # a handful
    opens = [(k, -1, f"{'{' if n == 0 else ','}{json.dumps(k)}: {{") for n, k in enumerate(kinds)]
    closes = [(k, 1 << 62, "}" if n + 1 < len(kinds) else "}}") for n, k in enumerate(kinds)]
    frame = nodes.sparkSession.createDataFrame(opens + closes if kinds else [("", 0, "{}")], "kind string, place long, value string")
    _write_lines(lines.unionAll(frame), ["kind", "place"], path)


def write_uri_list(nodes: DataFrame, path: str) -> None:
    """URIs as one JSON list in the order of ids, which are from 0."""
    value = F.concat(F.when(F.col("id") > 0, F.lit(",")).otherwise(F.lit("")), _quoted(F.col("uri")))
    _write_lines(_framed(nodes.select(F.col("id").alias("place"), value.alias("value")), "[", "]"), ["place"], path)


def write_counts(counts: DataFrame, path: str) -> None:
    """``{uri: n}`` of (uri, n), one entry per line."""
    value = F.concat(F.when(F.col("place") > 0, F.lit(",")).otherwise(F.lit("")), _quoted(F.col("uri")), F.lit(": "), F.col("n").cast("string"))
    _write_lines(_framed(dense_ids(counts.select("uri", "n"), ["uri"], "place").withColumn("value", value), "{", "}"), ["place"], path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(uri, n) of ``{uri: n}``."""
    return _document(spark, path, "map<string,bigint>").select(F.explode("j").alias("uri", "n"))


def write_table(df: DataFrame, path: str) -> None:
    """Ids, edges, features and flags: Parquet takes the place of saved tensors."""
    df.write.mode("overwrite").parquet(path)


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    """Metrics and histories as JSON lines."""
    df.coalesce(1).write.mode("append" if append else "overwrite").json(path)
