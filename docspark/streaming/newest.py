"""The newest row of every key of a stream, whatever order the rows come in.

A key's newest row is its state; an update is sent on only if a row beats it, so repeated and older rows cost
nothing downstream. Rows behind the watermark are dropped by event time and counted by Spark
(`late_rows`). A timer drops the state of a key that has been quiet for `keep`: a row that comes later than that starts
anew, so `keep` is as long as replacements of one key can lie apart, and bounds the state of an endless stream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What a query over keyed state needs of its session.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
_STATE = "at bigint, tie string, body string"


class _Newest(StatefulProcessor):
    """State of one key: time in microseconds, a tie-breaker, the row as JSON."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        before = self.newest.get()  # one call; None without state
        before = None if before is None else tuple(before)
        best = before
        for row in rows:
            if best is None or (row.at, row.tie) > best[:2]:
                best = (row.at, row.tie, row.body)
        if best != before:
            self.newest.update(best)
            timers = [None if x is None else x[0] // 1000 + self.keep_ms for x in (before, best)]
            if timers[0] != timers[1]:
                if timers[0] is not None:
                    self.handle.deleteTimer(timers[0])
                self.handle.registerTimer(timers[1])
            yield Row(body=best[2])

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[Row]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_by_key(stream: DataFrame, key: str, event_time: str, delay: str, keep_hours: float = 24.0 * 365) -> DataFrame:
    """A stream of the rows that are the newest of their key when they come, with all columns; to be written in update mode.

    Order is that of `event_time`, then of the row's text form, so equal times are decided alike in any order
    of arrival. Rows with a null key or time take no part.
    """
    if keep_hours <= 0:
        raise ValueError("keep_hours must be above zero")
    if stream.isStreaming and stream.sparkSession.conf.get(STATE_STORE[0], "") != STATE_STORE[1]:
        raise ValueError(f"set {STATE_STORE[0]} to {STATE_STORE[1]}")
    body = F.to_json(F.struct(*stream.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    rows = stream.where(F.col(key).isNotNull() & F.col(event_time).isNotNull()).withWatermark(event_time, delay)
    rows = rows.select(F.col(key).alias("key"), F.col(event_time), F.unix_micros(event_time).alias("at"), body.alias("body"))
    rows = rows.withColumn("tie", F.sha2("body", 256))
    found = rows.groupBy("key").transformWithState(
        _Newest(int(keep_hours * 3_600_000)), outputStructType="body string", outputMode="Update", timeMode="EventTime"
    )
    parsed = F.from_json("body", stream.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return found.select(parsed.alias("r")).select("r.*")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query has dropped so far for being behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
