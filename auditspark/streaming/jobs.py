"""Streaming forms: audits of arriving texts and findings in them, first-seen domains, the age cache with a time to live, and rested texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditspark.config import Injection, Settings
from auditspark.functions.urls import domain, extract_urls
from auditspark.operators import audit, detect

CACHE = "domain string, kind string, seen_at timestamp"


def _each_batch(texts: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Each batch judged and written to its own folder ``batch=N``; a batch that is run again replaces what it wrote."""

    def batch(rows: DataFrame, number: int) -> None:
        judge(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_stream(texts: DataFrame, lists: Callable[[], tuple[DataFrame, DataFrame]], path: str, checkpoint: str, settings: Callable[[], Settings] = Settings):
    """Verdicts on arriving texts. ``lists`` gives the blocklist and the whitelist, and ``settings`` the settings; both are asked anew for each batch, so changes take effect while the stream runs."""
    return _each_batch(texts, lambda rows: audit.audit(rows, *lists(), settings()), path, checkpoint)


def detect_stream(texts: DataFrame, path: str, checkpoint: str, settings: Callable[[], Injection] = Injection):
    """Findings in arriving texts. ``settings`` are asked anew for each batch; while they are disabled nothing is found."""

    def judge(rows: DataFrame) -> DataFrame:
        now = settings()
        return detect.detect(rows if now.enabled else rows.where("false"), now)

    return _each_batch(texts, judge, path, checkpoint)


def first_seen(texts: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Domains of arriving texts, each once within the watermark."""
    urls = texts.select("doc_id", F.col(ts).cast("timestamp").alias("ts"), "text").withWatermark("ts", late)
    found = urls.select("ts", F.explode(extract_urls(F.col("text"))).alias("url")).select("ts", domain(F.col("url")).alias("domain")).where("domain is not null")
    return found.dropDuplicatesWithinWatermark(["domain"])


def age_cache(events: DataFrame) -> DataFrame:
    """State per domain from ``(domain, seen_at, kind)``: the first success stays until a failure replaces it, a failure for seven days of event time. ``stateful.age_states`` lets the store drop failures by itself."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("seen_at")
        kind, at = state.get if state.exists else (None, None)
        for row in rows.itertuples():
            if row.kind == "failed" or kind != "ok":
                kind, at = row.kind, row.seen_at
        state.update((kind, at.to_pydatetime() if hasattr(at, "to_pydatetime") else at))
        if kind == "failed":
            state.setTimeoutTimestamp(int(pd.Timestamp(at).timestamp() * 1000) + 7 * 86_400_000)
        yield pd.DataFrame({"domain": [key[0]], "kind": [kind], "seen_at": [at]})

    marked = events.withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", "1 minute")
    return marked.groupBy("domain").applyInPandasWithState(update, CACHE, "kind string, seen_at timestamp", "update", GroupStateTimeout.EventTimeTimeout)


def rested_texts(texts: DataFrame, wait: str = "800 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last text of each session after a pause."""
    marked = texts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy(F.session_window("ts", wait).alias("pause"), "session_id").agg(F.max_by("text", "ts").alias("text")).select("session_id", F.col("pause.end").alias("rested_at"), "text")
