"""Session helpers: sending the package to executors, and folders that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that they need no installed copy."""
    sc = spark.sparkContext
    if getattr(sc, "_quillmesh_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="quillmesh-"), "quillmesh_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(target)
    sc._quillmesh_shipped = True


def is_local(spark: SparkSession) -> bool:
    """True where driver and executors are one process, which shares any folder."""
    return spark.sparkContext.master.split("[")[0] == "local"


def scratch(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder; in a temporary one only where a local master has none set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(shared or tempfile.mkdtemp(prefix='quillmesh-')).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that every later step sees the same rows in the same places."""
    path = f"{scratch(df.sparkSession)}-{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
