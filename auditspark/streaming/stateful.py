"""Operators with state of their own: when a session's text is audited, and the cache of ages whose failures expire by themselves.

Both keep their state in RocksDB, so that it may exceed an executor's memory; ``use_rocksdb`` is called for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditspark.operators.ages import TTL_DAYS

#: Pause after a text before it is audited.
WAIT_MS = 800
TTL_MS = TTL_DAYS * 86_400_000
CHANGES = "session_id long, ts timestamp, kind string, text string, ok boolean"
NOTES = "domain string, kind string, creation_date timestamp, at timestamp"


def use_rocksdb(spark: SparkSession) -> None:
    """State stores of queries that start from now on are kept by RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(ts: pd.Timestamp) -> int:
    return int(ts.timestamp() * 1000)


class AuditTrigger(StatefulProcessor):
    """State: the text that waits and when its pause ends, the text that was last asked for, and the marker, the text last audited with success."""

    def __init__(self, wait_ms: int = WAIT_MS):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trigger", "waiting string, due long, asked string, marker string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting, due, asked, marker = self.state.get() if self.state.exists() else (None, None, None, None)
        old_due, found = due, []
        for row in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            if due is not None and due <= _ms(row.ts):
                found.append((due, waiting))
                asked, waiting, due = waiting, None, None
            text = None if pd.isna(row.text) else row.text
            if row.kind == "text":  # the latest text waits, anew; one that was audited needs nothing
                waiting, due = (None, None) if text is None or text == marker else (text, _ms(row.ts) + self.wait_ms)
            elif row.kind == "unsettled":
                waiting = due = None
            elif row.kind == "audited" and text is not None and text == asked:  # what was superseded has no effect
                asked = None
                if row.ok is True or row.ok == True:  # noqa: E712  numpy's true as well
                    marker = text
                    if waiting == marker:
                        waiting = due = None
            elif row.kind == "reset":
                waiting = due = asked = marker = None
        if old_due is not None and old_due != due:
            self.handle.deleteTimer(old_due)
        if due is not None and due != old_due:
            self.handle.registerTimer(due)
        self._keep(waiting, due, asked, marker)
        yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, due, asked, marker = self.state.get() if self.state.exists() else (None, None, None, None)
        if due is None or due != expiredTimerInfo.getExpiryTimeInMs():
            yield self._rows(key, [])
            return
        self._keep(None, None, waiting, marker)
        yield self._rows(key, [(due, waiting)])

    def _keep(self, *state) -> None:
        if any(x is not None for x in state):
            self.state.update(state)
        else:
            self.state.clear()

    @staticmethod
    def _rows(key, found: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"session_id": pd.Series([key[0]] * len(found), dtype="int64"), "asked_at": pd.to_datetime([d for d, _ in found], unit="ms"), "text": pd.Series([t for _, t in found], dtype=object)})

    def close(self) -> None:
        pass


def audit_requests(changes: DataFrame, wait_ms: int = WAIT_MS, late: str = "10 seconds") -> DataFrame:
    """Which text of a session is to be audited, and when: ``session_id``, ``asked_at`` and ``text``.

    ``changes`` has the columns CHANGES; ``kind`` is ``text`` (the session's settled text), ``unsettled`` (the answer goes
    on), ``audited`` (an audit of ``text`` ended, ``ok`` or not) or ``reset`` (the session was changed). A text is asked
    for after a pause without another one; the latest wins. The marker moves only when the audit last asked for has
    succeeded, so that a text whose audit failed is asked for again when it comes again, and one that was audited is not;
    a reset forgets all. Null texts ask for nothing. Time is that of the events; order within a batch is by it, so batches
    of any size give the same rows. Rows later than ``late`` are dropped by the watermark. A session's changes of one batch
    are held at once.
    """
    use_rocksdb(changes.sparkSession)
    marked = changes.select("session_id", F.col("ts").cast("timestamp").alias("ts"), "kind", "text", "ok").withWatermark("ts", late)
    return marked.groupBy("session_id").transformWithStateInPandas(AuditTrigger(wait_ms), "session_id long, asked_at timestamp, text string", "Append", "EventTime")


class AgeState(StatefulProcessor):
    """Two values a domain: a success without end, and a failure that the store itself drops after its time to live."""

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ok = handle.getValueState("ok", "creation_date timestamp, at timestamp")
        self.failed = handle.getValueState("failed", "at timestamp", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        plain = lambda ts: None if pd.isna(ts) else ts.to_pydatetime()
        for row in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            if row.kind == "failed":
                self.ok.clear()
                self.failed.update((plain(row.at),))
            elif row.kind == "ok" and not self.ok.exists():
                self.failed.clear()
                self.ok.update((plain(row.creation_date), plain(row.at)))
        kind, date, at = None, None, None
        if self.ok.exists():
            kind, (date, at) = "ok", self.ok.get()
        elif self.failed.exists():
            kind, (at,) = "failed", self.failed.get()
        yield pd.DataFrame({"domain": [key[0]], "kind": pd.Series([kind], dtype=object), "creation_date": pd.to_datetime(pd.Series([date])), "at": pd.to_datetime(pd.Series([at]))})

    def close(self) -> None:
        pass


def age_states(notes: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """What the cache holds on each domain of a batch after it: ``domain``, ``kind``, ``creation_date`` and ``at``; a null kind is nothing.

    ``notes`` has the columns NOTES; ``kind`` is ``ok``, ``failed`` or ``read``, which only asks. The first success stays,
    until a failure is noted; a failure stays until a success is noted, or for ``ttl_ms`` since it was stored. As the time
    to live is told by the clock, Spark always plans a further batch: with the trigger ``availableNow`` the stream doesn't end.
    """
    use_rocksdb(notes.sparkSession)
    return notes.select("domain", "kind", "creation_date", "at").groupBy("domain").transformWithStateInPandas(AgeState(ttl_ms), NOTES, "Update", "ProcessingTime")
