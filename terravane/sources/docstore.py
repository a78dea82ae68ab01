"""Scans of the upsert store as a data source of its own: ``spark.read.format("terravane_store")``.

A partition is one file of a bucket. Comparisons of columns with constants are taken over from Spark: Parquet row groups whose statistics rule them out
are passed over, and equality on the key leaves the files of its bucket alone. Options: path; version (the latest without it).
"""

from __future__ import annotations

import operator
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType, StructType

from terravane.sources import store

_COMPARED = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_PLAIN = (int, float, str, bool)


def bucket_of(value, kind, buckets: int) -> int | None:
    """The bucket of a key as ``store`` deals it; None where it isn't known for the type of the key."""
    if isinstance(kind, LongType):
        body = struct.pack("<q", value)
    elif isinstance(kind, (IntegerType, ShortType, ByteType)):
        body = struct.pack("<i", value)
    elif isinstance(kind, StringType):
        body = value.encode()
    else:
        return None
    number = xxhash.xxh64(body, seed=42).intdigest()
    return (number - (1 << 64) if number >> 63 else number) % buckets


@dataclass
class File(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class StoreReader(DataSourceReader):
    def __init__(self, path: str, body: dict, schema: StructType, key: str | None):
        self.path, self.body, self.schema, self.key, self.taken = path, body, schema, key, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if self._expression(f) is None:
                yield f
            else:
                self.taken.append(f)

    def _expression(self, f: Filter) -> pads.Expression | None:
        if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in self.schema.fieldNames():
            return None
        column = pads.field(f.attribute[0])
        if isinstance(f, IsNotNull):
            return ~column.is_null()
        if isinstance(f, IsNull):
            return column.is_null()
        if isinstance(f, In) and all(isinstance(v, _PLAIN) for v in f.value):
            return column.isin(list(f.value))
        if isinstance(f, EqualTo) and isinstance(f.value, _PLAIN):
            return column == f.value
        if type(f) in _COMPARED and isinstance(f.value, _PLAIN):
            return _COMPARED[type(f)](column, f.value)
        return None

    def buckets(self) -> set[int]:
        """The buckets that can hold what was asked for."""
        out = {int(b) for b in self.body["files"]}
        for f in self.taken:
            if self.key and isinstance(f, (EqualTo, In)) and f.attribute == (self.key,):
                values = [f.value] if isinstance(f, EqualTo) else [v for v in f.value if v is not None]
                wanted = [bucket_of(v, self.schema[self.key].dataType, self.body["buckets"]) for v in values]
                out = out & set(wanted) if None not in wanted else out
        return out

    def partitions(self) -> list[InputPartition]:
        keep = self.buckets()
        return [File(f"{self.path}/{name}") for b, own in sorted(self.body["files"].items()) if int(b) in keep for name in own] or [File("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = store._open(partition.path)
        wanted, own = to_arrow_schema(self.schema), pads.dataset(path, filesystem=fs, format="parquet")
        expressions = [self._expression(f) for f in self.taken]
        # A column that an older file lacks is null.
        full = pads.dataset(path, filesystem=fs, format="parquet", schema=pa.unify_schemas([own.schema, pa.schema([f for f in wanted if f.name not in own.schema.names])]))
        for batch in full.to_batches(columns=wanted.names, filter=reduce(operator.and_, expressions) if expressions else None):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in wanted], schema=wanted)


class StoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terravane_store"

    def _manifest(self) -> dict:
        path, version = self.options["path"], self.options.get("version")
        done = store.versions(path)
        if not done:
            raise FileNotFoundError(f"nothing is saved under {path}")
        return store.manifest(path, int(version) if version is not None else done[-1])

    def schema(self) -> StructType:
        return StructType.fromJson(self._manifest()["schema"])

    def reader(self, schema: StructType) -> StoreReader:
        body = self._manifest()
        return StoreReader(self.options["path"], body, schema, body.get("key"))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Python sources take filters over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)
