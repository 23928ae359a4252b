"""Access decisions on tool calls: candidates in nested arguments, held against the blocklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.config import Settings
from auditspark.functions.urls import host, is_ip, registrable
from auditspark.operators import lists

WEB_TOOL = r"(?i)^tool:web_|web[-_](search|fetch|browse)"
FETCH_TOOL = r"(?i)^tool:web_fetch|^web[-_]fetch"
BARE = r"(?i)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}"
#: A string of a JSON text, with the colon after it if it is a key.
STRING = r'"(?:[^"\\]|\\.)*"(?:\s*:)?'


def is_web_tool(name: Column) -> Column:
    return F.coalesce(name.rlike(WEB_TOOL), F.lit(False))


def is_fetch_tool(name: Column) -> Column:
    return F.coalesce(name.rlike(FETCH_TOOL), F.lit(False))


def leaves(args: Column) -> Column:
    """All strings of a JSON text that aren't keys, at any depth."""
    raw = F.regexp_extract_all(F.coalesce(args, F.lit("")), F.lit(STRING), F.lit(0))
    values = F.filter(raw, lambda x: ~x.endswith(":"))
    return F.transform(values, lambda x: F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v"), x))


def candidates(calls: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """A row per call and distinct domain in its arguments, with the place it is first seen: hosts of URLs, else bare domains in free text."""
    each = calls.select("call_id", F.posexplode(leaves(F.col("args"))).alias("pos", "leaf"))
    url = F.col("leaf").rlike(r"^[a-z][a-z0-9+.-]*://[^/?#]")
    h = host(F.col("leaf"))
    found = F.when(url, F.array(F.when(is_ip(h), h).otherwise(registrable(h, rules)))).otherwise(F.transform(F.regexp_extract_all("leaf", F.lit(BARE), F.lit(0)), lambda d: registrable(F.lower(d), rules)))
    each = each.select("call_id", "pos", F.posexplode(found).alias("part", "domain")).where("domain is not null")
    return each.groupBy("call_id", "domain").agg(F.min(F.struct("pos", "part")).alias("at"))


def decisions(calls: DataFrame, block: DataFrame, settings: Settings | None = None, rules: list[str] | None = None) -> DataFrame:
    """A row per call: ``decision`` (allow, ask, deny) and the first blocked domain."""
    policy = (settings or Settings()).enforcement
    web = calls.where(is_web_tool(F.col("name")))
    hit = lists.blocked(candidates(web, rules), block).where("blocked").groupBy("call_id").agg(F.min_by("domain", "at").alias("domain"))
    out = calls.join(hit, "call_id", "left")
    return out.select("call_id", F.when(F.col("domain").isNotNull() & F.lit(policy != "allow"), policy).otherwise("allow").alias("decision"), F.when(F.lit(policy != "allow"), F.col("domain")).alias("domain"))
