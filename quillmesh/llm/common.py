"""Shared pieces of the training-data operators: table access, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.plans.session import is_local, ship

__all__ = ["drop_materialized", "held_out", "materialize", "shared_dir", "ship", "table", "words"]

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression (the vertical tab must be spelled out there).
BLANK_RUN = r"[ \t\n\x0B\f\r]+"
BLANK_BYTES = b" \t\n\x0b\x0c\r"
#: Tables in the shared folder that this driver has written and not deleted.
_PATHS: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark whatever the store is."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where a local master has none set."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        set_dir = tempfile.mkdtemp(prefix="quillmesh-ckpt-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike a local checkpoint the table outlives any executor.  Tables that an operator has not
    deleted itself, as its result may still read them, go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _PATHS:
        atexit.register(_sweep, spark.sparkContext)
    _PATHS.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmesh_path = path
    return out


def _delete(sc, name: str) -> None:
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    _PATHS.discard(name)


def drop_materialized(*tables: DataFrame) -> None:
    """Delete the tables behind :func:`materialize` results that no later step reads."""
    for df in tables:
        _delete(df.sparkSession.sparkContext, df._quillmesh_path)


def _sweep(sc) -> None:
    """Delete what is left; without effect where the context has been stopped by then."""
    for name in list(_PATHS) if sc._jsc is not None else ():
        _delete(sc, name)


def words(text) -> "F.Column":
    """``[^\\x20\\x09-\\x0D]+`` words of a text as an array; null text gives an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def held_out(doc_id, modulus: int, remainder: int) -> "F.Column":
    """True for rows set aside from learning: crc32 of the id as text, modulo ``modulus``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
