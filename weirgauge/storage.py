"""Intermediate tables on the storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate data. Only a local session
    without that setting falls back to a folder of its own."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="weirgauge-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def read_if_there(spark: SparkSession, path: str, schema: T.StructType, folders: str | None = None) -> DataFrame:
    """The Parquet table at ``path``, or no rows if nothing is there yet. ``folders``
    is a pattern of partition folders, to list these only."""
    where = path if folders is None else f"{path.rstrip('/')}/{folders}"
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(where)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(rows: DataFrame, label: str) -> DataFrame:
    """Write ``rows`` once and read them back: cuts the lineage, survives lost
    executors, and later actions do not compute them again."""
    path = shared_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
