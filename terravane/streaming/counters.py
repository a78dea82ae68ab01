"""Day counters of venues or users as keyed state of a stream.

Each id has one value with the counts of its open (period, day), and a timer for the earliest end of these periods; when the
watermark passes it, all periods that have ended are closed: one row for every day, zeros where there was nothing, and their state is
dropped; the next end sets the timer. So results come in append mode, once for each id and period, and state is as large as the periods that are open.

Records are counted by id and day within each part of a micro-batch before they are shuffled, so an id with a third of all records sends
one row for each part and day. Records older than the watermark are dropped, as in any stream;
``late`` says how far behind the newest record one may come, so a period closes that long after its end.

Ids that are null are one id. A stream that ends goes on from its checkpoint with all open periods.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terravane.functions import times

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Timers and maps need the RocksDB state store; a session that names it, or a subclass, is left as it is."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, _STORE)


class _Closing(StatefulProcessor):
    """Counts days and gives a period when it is closed.

    Every call of the state is a message to the JVM, so an id has one value, read and written once in a batch, and one timer, that of its earliest end.
    """

    def __init__(self, key: str, first: int, last: int):
        self.key, self.first, self.last = key, first, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("open", "ends array<long>, period array<string>, day array<int>, n array<long>")

    def _open(self) -> dict[tuple[int, str, int], int]:
        """The count of each (end, period, day) that is open."""
        value = self.counts.get()
        return {at: n for *at_, n in zip(*value, strict=True) for at in [tuple(at_)]} if value else {}

    def _keep(self, counts: dict[tuple[int, str, int], int]) -> None:
        if counts:
            self.counts.update((*(list(x) for x in zip(*counts, strict=True)), list(counts.values())))
            self.handle.registerTimer(min(end for end, _, _ in counts))
        else:
            self.counts.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts = self._open()
        for part in rows:
            for end, period, day, n in zip(*(part[c].tolist() for c in ("ends", "period", "day", "n")), strict=True):
                counts[end, period, day] = counts.get((end, period, day), 0) + n
        self._keep(counts)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto, counts, found = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), self._open(), {}
        for (end, period, day), n in counts.items():
            if end <= upto:
                found.setdefault((end, period), {})[day] = n
        if not found:  # closed with an earlier end
            return
        self._keep({at: n for at, n in counts.items() if at[0] > upto})
        days = list(range(self.first, self.last + 1))
        closed = [(period, day, own.get(day, 0)) for (_, period), own in sorted(found.items()) for day in days]
        yield pd.DataFrame({self.key: [key[0]] * len(closed), "period": [c[0] for c in closed], "day": [c[1] for c in closed], "n": [c[2] for c in closed]})

    def close(self) -> None:
        pass


def _partial(key: str):
    """Counts by id, period and day within a part; the latest time of each stands for it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.groupby([key, "ends", "period", "day"], dropna=False, as_index=False).agg(ts=("ts", "max"), n=("ts", "size"))

    return run


def closed_periods(posts: DataFrame, key: str, ts: str, size: int = 7, late: str = "8 days") -> DataFrame:
    """(key, period, day, n) for every day of each closed period of each id; append mode. A period is a week, a month or a year."""
    use_state_store(posts.sparkSession)
    unit = {7: "week", 31: "month", 356: "year"}[size]
    at = F.col(ts).cast("timestamp")
    start = F.date_trunc(unit, at)
    end = start + {7: F.expr("interval 7 days"), 31: F.expr("interval 1 month"), 356: F.expr("interval 1 year")}[size]
    rows = posts.select(F.col(key), at.alias("ts"), F.date_format(start, "yyyy-MM-dd").alias("period"), times.day_of_period(at, size).cast("int").alias("day"), F.unix_millis(end).alias("ends"))
    kind = rows.schema[key].dataType.simpleString()
    counted = rows.mapInPandas(_partial(key), f"{key} {kind}, ends long, period string, day int, ts timestamp, n long")
    first, last = {7: (0, 6), 31: (1, 31), 356: (1, 366)}[size]
    grouped = counted.withWatermark("ts", late).groupBy(key)
    return grouped.transformWithStateInPandas(_Closing(key, first, last), f"{key} {kind}, period string, day int, n long", "append", "eventTime")
