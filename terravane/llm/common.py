"""What the corpus operators share: a shared work folder, raw files and balanced batches."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder URI that the driver and every executor can reach.

    It lies under ``spark.checkpoint.dir``; where that is unset a local session gets a temporary
    folder of this machine, and a cluster an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if "base" not in _LOCAL:
            _LOCAL["base"] = "file://" + tempfile.mkdtemp(prefix="terravane-")
            spark.sparkContext.setCheckpointDir(_LOCAL["base"])
        base = _LOCAL["base"]
    if "://" not in base:
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/terravane/{label}-{uuid.uuid4().hex[:12]}"


_LOCAL: dict[str, str] = {}


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (local, HDFS, S3, GCS) and the path in it."""
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def writing(uri: str) -> Iterator[pa.NativeFile]:
    """A file that gets its final name in one step when it is whole, so that a retried task only repeats it."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        yield out
    fs.move(part, path)


def put_file(uri: str, data: bytes) -> None:
    with writing(uri) as out:
        out.write(data)


@contextlib.contextmanager
def reading(uri: str) -> Iterator[pa.NativeFile]:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        yield f


def mark_empty(uri_of: Callable[[int], str], parts: int, made: set[int]) -> None:
    """Writes an empty file for each part that got no rows, so that a file that is missing later is an error."""
    for part in sorted(set(range(parts)) - made):
        put_file(uri_of(part), b"")


def get_file(uri: str) -> bytes:
    with reading(uri) as f:
        return f.read()


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Has Spark drop the shuffle files of an action as soon as it has ended; for actions whose result is stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def stored(df: DataFrame, uri: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage and survives lost executors."""
    with tidy(df.sparkSession):
        df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def with_row_id(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a long column that names each row, the same each time the table is read.

    Rows of files are named by file and place; rows of any other plan are numbered, which is as steady as the plan itself.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
        own = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    except AnalysisException:
        own = F.monotonically_increasing_id()
    return docs.withColumn(name, own)


#: What operators keep from task to task, by owner, as functions that drop it.
KEPT: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = [""]


def claim(owner: str) -> None:
    """Called by a task before it works: a worker that served another operator drops what that one had kept."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for name, drop in KEPT.items():
            if name != owner:
                drop()
        give_back()


def give_back() -> None:
    """Returns freed memory of this process to the machine, as idle workers share it with busy ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_bytes(docs: DataFrame, name: str = "text") -> int:
    """Bytes of all texts: one scan with a map-side sum."""
    return docs.agg(F.sum(F.octet_length(text_of(name))).alias("b")).first()["b"] or 0


def parts(total: int, each: int, most: int = 20_000) -> int:
    """So many parts that each holds about ``each``; at a very large total the parts grow instead of their number."""
    return max(1, min(most, -(-total // each)))
