"""Random numbers from keys: the same in every attempt of a task, on every machine and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: int | str | Column) -> Column:
    """A number from 0 to 1, without 1, from the md5 of the parts as text with colons between; a str names a column."""
    own = [F.lit(str(p)) if isinstance(p, int) else F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *own).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def poisson(u: Column, mean: float = 1.0, most: int = 12) -> Column:
    """A Poisson number from a uniform one; numbers beyond ``most`` (of a chance under 1e-10 at mean 1) count as ``most``."""
    out, p, upto = F.lit(0), math.exp(-mean), 0.0
    for k in range(most):
        upto += p
        p *= mean / (k + 1)
        out = out + F.when(u >= upto, 1).otherwise(0)
    return out
