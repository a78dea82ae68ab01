"""A table of documents that is upserted in place of a document store.

Rows lie in buckets by a hash of their key, and a bucket is a list of Parquet files. A save reads, merges and writes the buckets of its
keys alone; the files of all others stay. What a table consists of is said by its newest manifest, one small file that names the
files of every bucket. It is written last and appears under its number in one step, and only if no other save has taken that
number; a save that comes too late merges again on top of the other. Files that no manifest names (of jobs that failed, or were
committed by nobody) are never read, whatever committer wrote them and whether or not it leaves files of success.

A manifest also remembers the last batch of each stream, so a micro-batch that is repeated after a failure is not merged twice.
Readers keep what they have begun to read: files go only by ``vacuum``.

Taking a number is atomic on local and HDFS paths. Object stores without a rename that fails on existing names want one writer at a time.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Callable

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
ATTEMPTS = 8
_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Other saves took the next number again and again."""


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def versions(path: str) -> list[int]:
    fs, root = _open(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/manifests", allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))


def manifest(path: str, version: int) -> dict:
    fs, root = _open(path)
    with fs.open_input_file(f"{root}/manifests/{version:012d}.json") as f:
        return json.loads(f.read())


def _commit(path: str, body: dict) -> bool:
    """Puts a manifest under its number; False if that is taken."""
    fs, root = _open(path)
    fs.create_dir(f"{root}/manifests", recursive=True)
    new, name = f"{root}/manifests/{uuid.uuid4().hex}.new", f"{root}/manifests/{body['version']:012d}.json"
    with fs.open_output_stream(new) as f:
        f.write(json.dumps(body).encode())
    try:
        if isinstance(fs, pafs.LocalFileSystem):
            os.link(new, name)  # unlike a rename it fails where the name is taken
            os.unlink(new)
        elif fs.get_file_info(name).type != pafs.FileType.NotFound:
            return False
        else:
            fs.move(new, name)
    except (FileExistsError, OSError):
        if fs.get_file_info(name).type == pafs.FileType.NotFound:
            raise
        return False
    finally:
        with contextlib.suppress(FileNotFoundError, OSError):
            fs.delete_file(new)
    return True


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str, body: dict, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of some buckets, of all without a list; columns that older files lack are null."""
    names = [f"{path}/{n}" for b, own in body["files"].items() if buckets is None or int(b) in buckets for n in own]
    return spark.read.schema(StructType.fromJson(body["schema"])).parquet(*names) if names else None


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table, or what it was at a version."""
    done = versions(path)
    if not done:
        raise FileNotFoundError(f"nothing is saved under {path}")
    body = manifest(path, done[-1] if version is None else version)
    rows = _files(spark, path, body)
    return rows if rows is not None else spark.createDataFrame([], StructType.fromJson(body["schema"]))


def _written(spark: SparkSession, path: str, folder: str) -> dict[int, list[str]]:
    """The files of each bucket that a save has written; one name for each file reaches the driver."""
    fs, root = _open(f"{path}/{folder}")
    out: dict[int, list[str]] = {}
    for f in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        at = f.path.find(f"{_BUCKET}=")
        if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")) and at >= 0 and "/_temporary/" not in f.path:
            out.setdefault(int(f.path[at:].split("=")[1].split("/")[0]), []).append(f"{folder}/{f.path[at:]}")
    return out


def save(spark: SparkSession, new: DataFrame, path: str, key: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS, stream: str | None = None, batch: int = -1, rows_per_file: int = 5_000_000) -> int:
    """Merges ``new`` into the table and returns its new version. ``merge(old, new)`` gets the rows of the touched buckets, or None for a new table.

    The number of buckets is that of the first save. With ``stream`` a batch that is not later than the stream's last one changes nothing.
    """
    for _ in range(ATTEMPTS):
        done = versions(path)
        body = manifest(path, done[-1]) if done else {"version": -1, "buckets": buckets, "files": {}, "streams": {}}
        if stream is not None and body["streams"].get(stream, -1) >= batch:
            return body["version"]
        of = _bucket(key, body["buckets"])
        touched = sorted(r[0] for r in new.select(of.alias("b")).distinct().collect())
        old = _files(spark, path, body, touched) if done else None
        if old is None and done:
            old = spark.createDataFrame([], StructType.fromJson(body["schema"]))
        now, folder = merge(old, new), f"data/{uuid.uuid4().hex}"
        if touched:
            now.withColumn(_BUCKET, of).repartition(len(touched), _BUCKET).write.option("maxRecordsPerFile", rows_per_file).partitionBy(_BUCKET).parquet(f"{path}/{folder}")
        made = _written(spark, path, folder) if touched else {}
        if not set(made) <= set(touched):
            raise ValueError("the rows to be saved were others when they were read again; store them first")
        schema = json.loads(now.schema.json())
        kept = {b: own for b, own in body["files"].items() if int(b) not in touched}
        if done and set(now.columns) < {f["name"] for f in body["schema"]["fields"]}:
            raise ValueError("a merge must keep the columns of the table")
        streams = body["streams"] | ({stream: batch} if stream is not None else {})
        next_ = {"version": body["version"] + 1, "buckets": body["buckets"], "key": key, "schema": schema, "files": kept | {str(b): own for b, own in made.items()}, "streams": streams}
        if _commit(path, next_):
            return next_["version"]
    raise Conflict(f"{ATTEMPTS} other saves came first under {path}")


def vacuum(path: str, keep: int = 2) -> int:
    """Removes manifests but the last ``keep``, and the files that none of these names; returns how many files went.

    Run it when no save is under way, as the files of a save are named by a manifest only when it ends.
    """
    fs, root = _open(path)
    done = versions(path)
    named = {n for v in done[-keep:] for own in manifest(path, v)["files"].values() for n in own}
    for v in done[:-keep]:
        fs.delete_file(f"{root}/manifests/{v:012d}.json")
    gone = 0
    for f in fs.get_file_info(pafs.FileSelector(f"{root}/data", recursive=True, allow_not_found=True)):
        if f.is_file and f.path.removeprefix(root).lstrip("/") not in named:
            fs.delete_file(f.path)
            gone += 1
    return gone
