"""What each user did of late, in state: one list a user, each event in it once.

An event stays as long as it lies within a span of its user's last event, so the list is what a batch query over all
events would keep, in whatever order they come. Rows that come are merged into the list by value; those that fall out
of the span leave it. Once the watermark has passed a user's last event by the span, nothing that is on time can
belong to the list any more, and an event-time timer clears it: the state follows users who are active.

The state of a user, and what a batch hands on for each user with new events, are that user's events of one span.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SPAN_MINUTES, LATE_MINUTES = 30, 2
FIELDS = ("ts_ms", "item", "action", "region")


class RecentEvents(StatefulProcessor):
    """Merges a user's new events into the list and gives the whole list. fields: of an event, its time first."""

    def __init__(self, fields: T.StructType, span_ms: int):
        self.fields, self.span_ms = fields, span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", self.fields)
        # there is one timer a user at a time
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        known, new = set(held), []
        for row in rows:
            event = tuple(row[c] for c in self.fields.names)
            if event not in known:
                known.add(event)
                new.append(event)
        last = max(e[0] for e in known)
        kept = [e for e in (*held, *new) if e[0] > last - self.span_ms]
        if len(kept) < len(held) + len(new):
            self.events.put(kept)
        elif new:
            self.events.appendList(new)
        if not self.alarm.exists():
            self._wake_at(last + self.span_ms)
        told = Row("user_id", *self.fields.names)
        for event in kept:
            yield told(*key, *event)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.alarm.clear()
        if self.events.exists():
            ends = max(e[0] for e in self.events.get()) + self.span_ms
            if ends <= timerValues.getCurrentWatermarkInMs():
                self.events.clear()
            else:
                self._wake_at(ends)
        return iter(())

    def _wake_at(self, at: int) -> None:
        self.alarm.update((at,))
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def history_rows(events: DataFrame, span_minutes: int = SPAN_MINUTES) -> DataFrame:
    """user_id, ts_ms, item, action, region, and title where there is one: each event once, those within the span of the user's last."""
    own = events.select("user_id", *FIELDS, *(["title"] if "title" in events.columns else [])).distinct()
    last = F.max("ts_ms").over(W.partitionBy("user_id"))
    return own.withColumn("__last", last).where(F.col("ts_ms") > F.col("__last") - span_minutes * 60_000).drop("__last")


def user_history(events: DataFrame, span_minutes: int = SPAN_MINUTES, late_minutes: int = LATE_MINUTES) -> DataFrame:
    """The rows of `history_rows`, of a batch; of a stream, those of every user with new events, in update mode.

    events: user_id, ts (event time), ts_ms, item, action, region and, where known, title; valid, so ts_ms is not
    null. An event may come after others that are younger by the span and `late_minutes`; later ones are dropped. A
    stream needs the state store of `with_rocksdb`.
    """
    if not events.isStreaming:
        return history_rows(events, span_minutes)
    names = [*FIELDS, *(["title"] if "title" in events.columns else [])]
    of = lambda cs: T.StructType([T.StructField(c, events.schema[c].dataType) for c in cs])
    on_time = events.withWatermark("ts", f"{span_minutes + late_minutes} minutes").select("user_id", "ts", *names)
    return on_time.groupBy("user_id").transformWithState(RecentEvents(of(names), span_minutes * 60_000), of(["user_id", *names]), "Update", "EventTime")
