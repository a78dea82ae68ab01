"""Movement graphs from consecutive posts of each user.

A post and the next one of its user make an edge between their cells if these differ and the time between them lies strictly
between two bounds. Posts of one time follow each other by id. Null users, times or cells make no edges.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_MS = 60_000
HOUR_MS = 60 * MINUTE_MS


@dataclass(frozen=True)
class EdgeRule:
    """Bounds in ms, both exclusive, and the weight of one passage from its duration in ms."""

    more_than: int
    less_than: int
    weight: Callable[[Column], Column]


def _one(ms: Column) -> Column:
    return F.lit(1.0)


def _whole_minutes(ms: Column) -> Column:
    return F.floor(ms / MINUTE_MS).cast("double")


PASSAGES = EdgeRule(5 * MINUTE_MS, 12 * HOUR_MS, _one)
MINUTES = EdgeRule(5 * MINUTE_MS, 3 * HOUR_MS, _whole_minutes)


def consecutive_edges(posts: DataFrame, rule: EdgeRule = PASSAGES, user: str = "user_id", ts: str = "ts", cell: str = "cell", tie: str = "id") -> DataFrame:
    """(user, src, dst, ms, weight): one row for each passage.

    Time is cut into spans as long as the rule's upper bound. A passage begins in the span in which it ends or in the one before, so
    each post also stands at the front of the next span, and the one shuffle is by user and span: a user with very many
    posts is spread over time.
    """
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    slim = posts.select(user, ms.alias("_ms"), F.col(ts), F.col(cell).alias("dst"), F.col(tie)).where(F.col(user).isNotNull() & F.col(ts).isNotNull())
    span = F.floor(F.col("_ms") / rule.less_than)
    rows = slim.withColumn("_at", F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own"))))).select("*", "_at.*")
    order = Window.partitionBy(user, "span").orderBy(ts, tie)
    rows = rows.withColumn("src", F.lag("dst").over(order)).withColumn("ms", F.col("_ms") - F.lag("_ms").over(order)).where("own")
    return rows.where((F.col("src") != F.col("dst")) & (F.col("ms") > rule.more_than) & (F.col("ms") < rule.less_than)).select(user, "src", "dst", "ms", rule.weight(F.col("ms")).alias("weight"))


#: How the weights of one edge are put together.
AGGREGATES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "mean": F.avg}


def graph(edges: DataFrame, how: str = "sum") -> DataFrame:
    """(src, dst, weight), one row for each edge."""
    if how not in AGGREGATES:
        raise ValueError(f"how is one of {sorted(AGGREGATES)}")
    return edges.groupBy("src", "dst").agg(AGGREGATES[how]("weight").alias("weight"))


def passages_graph(posts: DataFrame, **names: str) -> DataFrame:
    """How often users went from a cell to another within 12 hours."""
    return graph(consecutive_edges(posts, PASSAGES, **names), "sum")


def minutes_graph(posts: DataFrame, **names: str) -> DataFrame:
    """The mean of whole minutes users took from a cell to another within 3 hours."""
    return graph(consecutive_edges(posts, MINUTES, **names), "mean")


def vertices(edges: DataFrame) -> DataFrame:
    """(id, weight): every end of an edge, of weight 1."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("weight", F.lit(1.0))
