"""Cache of domain ages: events ``(domain, seen_at, kind, creation_date)`` with kind ok or failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_DAYS = 7


def expired(seen_at: Column, now: Column) -> Column:
    return now - seen_at > F.expr(f"INTERVAL {TTL_DAYS} DAYS")


def first_ok(events: DataFrame) -> DataFrame:
    """A success is never replaced: the first of each domain."""
    return events.where("kind = 'ok'").groupBy("domain").agg(F.min("seen_at").alias("ok_at"), F.min_by("creation_date", "seen_at").alias("creation_date"))


def last_failed(events: DataFrame, now: Column) -> DataFrame:
    """The last failure of each domain, and whether it has expired."""
    out = events.where("kind = 'failed'").groupBy("domain").agg(F.max("seen_at").alias("failed_at"))
    return out.withColumn("expired", expired(F.col("failed_at"), now))


def upserted(events: DataFrame) -> DataFrame:
    """What the table holds after all events by time: a failure replaces anything, a success only a failure or nothing."""
    failed = events.where("kind = 'failed'").groupBy("domain").agg(F.max("seen_at").alias("failed_at"))
    later = events.where("kind = 'ok'").join(failed, "domain", "left").where("failed_at is null or seen_at > failed_at")
    first = later.groupBy("domain").agg(F.min("seen_at").alias("ok_at"))
    out = failed.join(first, "domain", "full")
    return out.select("domain", F.when(F.col("ok_at").isNotNull(), "ok").otherwise("failed").alias("kind"), F.coalesce("ok_at", "failed_at").alias("seen_at"))


def resolve(domains: DataFrame, cache: DataFrame, lookup: DataFrame) -> DataFrame:
    """``domains`` with date, status and source: a cached success, else the looked-up date; a cached failure doesn't stop a new lookup."""
    hit = first_ok(cache).select("domain", F.col("creation_date").alias("cached"), F.lit(True).alias("hit"))
    new = lookup.select("domain", F.col("creation_date").alias("found"), F.col("status").alias("found_status"))
    out = domains.join(hit, "domain", "left").join(new, "domain", "left")
    status = F.when(F.col("hit"), "ok").otherwise(F.coalesce("found_status", F.lit("failed")))
    return out.select(*domains.columns, F.when(F.col("hit"), F.col("cached")).when(F.col("found_status") == "ok", F.col("found")).alias("creation_date"), status.alias("status"), F.when(F.col("hit"), "cache").when(F.col("found_status") == "ok", "api_query").otherwise("unverifiable").alias("source_kind"))
