"""Fields of nested rows by a path that may not be there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def at_path(schema: StructType, path: str, joint: str = ".") -> Column:
    """The field at ``path``, null text where the schema has none; a null on the way gives null as well."""
    at, names = schema, path.split(joint)
    for name in names:
        if not isinstance(at, StructType) or name not in at.fieldNames():
            return F.lit(None).cast("string")
        at = at[name].dataType
    return F.col(".".join(f"`{n}`" for n in names))


def in_record(record: Column | str, path: str, kind: str = "string", joint: str = ".") -> Column:
    """The field at ``path`` of a VARIANT, whose schema nobody needs to know; null where a record has none, or one of another kind."""
    quoted = lambda p: f'["{p}"]' if "'" in p else f"['{p}']"
    steps = "".join(f"[{p}]" if p.isdigit() else quoted(p) for p in path.split(joint))
    return F.try_variant_get(F.col(record) if isinstance(record, str) else record, f"${steps}", kind)
