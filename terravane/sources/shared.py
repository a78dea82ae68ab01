"""Folders that the driver and every executor can reach."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local run gets a folder of its own and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if "base" not in _LOCAL:
        _LOCAL["base"] = "file://" + tempfile.mkdtemp(prefix="terravane-")
    return _LOCAL["base"]


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_base(spark)}/terravane/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, uri: str) -> DataFrame:
    """Writes a table into a shared folder and reads it back: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def delete(spark: SparkSession, uri: str) -> None:
    """Removes a work folder; where this process can't reach its store it stays."""
    with contextlib.suppress(pa.ArrowInvalid, OSError):
        fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        fs.delete_dir(path)
