"""Allow- and blocklists: entries are rows ``(pos, domain, reason, date)``; a later position was added later.

Lists are joined without hints: Spark broadcasts them only while their size is below its own threshold, and else shuffles
and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.urls import public_suffix

def valid_entry(entry: Column) -> Column:
    """A domain with a dot, or a dot and a letter at least; printable ASCII without blanks, '@', '?' and '#'."""
    e = F.lower(F.trim(entry))
    shape = F.when(e.startswith("."), F.length(e) >= 2).otherwise(e.contains("."))
    return F.coalesce((e != "") & shape & e.rlike(r"^[\x21-\x7e]+$") & ~e.rlike("[@?#]"), F.lit(False))


def read_list(entries: DataFrame) -> DataFrame:
    """Lower-case and trimmed; empty entries go and of equal ones the first stays."""
    clean = entries.withColumn("domain", F.lower(F.trim("domain"))).where(F.coalesce(F.col("domain") != "", F.lit(False)))
    return clean.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy("pos"))).where("rank = 1").drop("rank")


def seeded(entries: DataFrame, seeds: list[str]) -> DataFrame:
    """The list with the seeds it lacks."""
    rows = entries.sparkSession.createDataFrame([(-len(seeds) + k, d, "seed", None) for k, d in enumerate(seeds)], "pos long, domain string, reason string, date timestamp")
    return entries.unionByName(rows.join(entries.select("domain"), "domain", "left_anti").select("pos", "domain", "reason", "date"))


def add(entries: DataFrame, domain: str, reason: str = "manual") -> DataFrame:
    """With the entry at the end, once; unchanged if it isn't valid."""
    spark = entries.sparkSession
    clean = domain.strip().lower()
    one = spark.createDataFrame([(clean, reason)], "domain string, reason string").where(valid_entry(F.col("domain")))
    last = entries.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("last"))
    new = one.crossJoin(last).select((F.col("last") + 1).cast("long").alias("pos"), "domain", "reason", F.lit(None).cast("timestamp").alias("date"))
    return entries.join(F.broadcast(new.select("domain")), "domain", "left_anti").select("pos", "domain", "reason", "date").unionByName(new)


def remove(entries: DataFrame, domain: str) -> DataFrame:
    return entries.where(F.col("domain") != domain.strip().lower())


def sets(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact domains, and entries with a leading dot."""
    names = read_list(entries).select("domain")
    return names.where(~F.col("domain").startswith(".")), names.where(F.col("domain").startswith("."))


def _suffixes(domain: Column) -> Column:
    """All ends of a domain at its dots, itself first."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def blocked(domains: DataFrame, entries: DataFrame, domain_col: str = "domain") -> DataFrame:
    """``domains`` with ``exact``, ``tld_blocked`` (a dotted entry is the public suffix or ends it) and ``blocked`` (either, or a dotted entry of two labels that the domain is or ends in).

    Each domain is joined by equality with its own few ends; there is no comparison of every domain with every entry.
    """
    exact, dotted = sets(entries)
    names = domains.select(domain_col).distinct().where(F.col(domain_col).isNotNull())
    ends = names.select(domain_col, F.explode(_suffixes(F.col(domain_col))).alias("end"), public_suffix(F.col(domain_col)).alias("suffix"))
    rules = dotted.select(F.substring("domain", 2, 1_000).alias("end"), F.lit(True).alias("dot")).unionByName(exact.select(F.col("domain").alias("end"), F.lit(False).alias("dot")))
    hits = ends.join(rules, "end")
    of_suffix = F.coalesce((F.col("suffix") == F.col("end")) | F.col("suffix").endswith(F.concat(F.lit("."), F.col("end"))), F.lit(False))
    tld = F.col("dot") & of_suffix
    deep = F.col("dot") & F.col("end").contains(".")
    hits = hits.groupBy(domain_col).agg(F.bool_or(~F.col("dot") & (F.col("end") == F.col(domain_col))).alias("exact"), F.bool_or(tld).alias("tld_blocked"), F.bool_or((~F.col("dot") & (F.col("end") == F.col(domain_col))) | deep | (tld & ~F.col("end").contains("."))).alias("blocked"))
    filled = [F.coalesce(c, F.lit(False)).alias(c) for c in ("exact", "tld_blocked", "blocked")]
    return domains.join(hits, domain_col, "left").select(*domains.columns, *filled)


def allowed(domains: DataFrame, entries: DataFrame, domain_col: str = "domain") -> DataFrame:
    """``domains`` with ``whitelisted``: whether the list has exactly this domain."""
    names = sets(entries)[0].select(F.col("domain").alias(domain_col), F.lit(True).alias("whitelisted"))
    return domains.join(names, domain_col, "left").select(*domains.columns, F.coalesce("whitelisted", F.lit(False)).alias("whitelisted"))


def apply_op(block: DataFrame, allow: DataFrame, op: str, domain: str, reason: str = "manual") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both lists after an operation (block, unblock, whitelist, unwhitelist), and one row on it: whether it was valid, whether an entry was removed, membership and counts after it."""
    name = domain.strip().lower()
    change = {"block": add, "whitelist": add, "unblock": remove, "unwhitelist": remove}[op]
    of_block = op in ("block", "unblock")
    before = block if of_block else allow
    after = change(before, name, reason) if change is add else remove(before, name)
    block, allow = (after, allow) if of_block else (block, after)
    has = F.coalesce(F.bool_or(F.col("domain") == name), F.lit(False))
    counted = lambda entries, side: read_list(entries).agg(has.alias(f"in_{side}"), F.count("*").alias(f"n_{side}"))
    was = read_list(before).agg(has.alias("was"))
    ok = valid_entry(F.lit(name)) if change is add else F.lit(name != "")
    row = counted(allow, "whitelist").crossJoin(counted(block, "blocklist")).crossJoin(was)  # one row each
    return block, allow, row.select(F.lit(op).alias("op"), F.lit(name).alias("domain"), ok.alias("ok"), (F.lit(change is remove) & F.col("was")).alias("removed"), "in_whitelist", "in_blocklist", "n_whitelist", "n_blocklist")
