"""Public suffixes as a table of rules ``(name, kind)``: kind is plain, wildcard (any one label before the name) or exception.

Each distinct host is exploded into its few ends, which meet the rules by equality; of all matches an exception wins, else
the longest. There is no literal of the list in a plan, and no comparison of every host with every rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions.urls import SUFFIXES, is_ip
from auditspark.operators.joins import BROADCAST_ROWS, join_even


def parse_rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rules of a list in the usual text form: one at the start of a line up to white space, ``//`` for comments, ``*.`` and ``!`` for wildcards and exceptions.

    Null and empty lines and comments give no rule; case is folded; repeated rules are one; a wildcard elsewhere than first is no rule.
    """
    word = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(column, F.lit("")), r"^\s*(\S*)", 1)), r"^\.", "")
    kind = F.when(word.startswith("!"), "exception").when(word.startswith("*."), "wildcard").otherwise("plain")
    rules = lines.select(word.alias("word"), kind.alias("kind")).where("word <> '' and not startswith(word, '//')")
    return rules.select(F.regexp_replace("word", r"^(!|\*\.)", "").alias("name"), "kind").where("name <> '' and not contains(name, '*')").distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of text files on any file system that Spark reads."""
    return parse_rules(spark.read.text(path))


def default_rules(spark: SparkSession) -> DataFrame:
    return parse_rules(spark.createDataFrame([(r,) for r in SUFFIXES], "value string"))


def _tail(labels: Column, k: Column) -> Column:
    return F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")


def suffix_table(hosts: DataFrame, rules: DataFrame, host_col: str = "host", most: int = BROADCAST_ROWS) -> DataFrame:
    """A row per distinct host that isn't null: the host, ``n`` (rows that have it), ``suffix`` and ``registrable``.

    Without a matching rule the last label is the suffix. ``registrable`` is the suffix and one label more, null if there is
    no such label. Both are null for addresses and for hosts with an empty label.
    """
    labels = F.split(host_col, r"\.")
    named = hosts.where(F.col(host_col).isNotNull()).groupBy(host_col).agg(F.count("*").alias("n"))
    plain = named.where(~is_ip(F.col(host_col)) & ~F.array_contains(labels, ""))
    ends = plain.select(host_col, F.size(labels).alias("size"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("k"), labels.alias("labels"))
    ends = ends.select(host_col, "size", "k", _tail(F.col("labels"), F.col("k")).alias("end"))
    hits = join_even(ends, rules.select(F.col("name").alias("end"), "kind"), "end", most)
    length = F.when(F.col("kind") == "exception", F.col("k") - 1).when(F.col("kind") == "plain", F.col("k")).when(F.col("size") > F.col("k"), F.col("k") + 1)
    best = hits.withColumn("length", length).where("length is not null").groupBy(host_col).agg(F.max(F.struct((F.col("kind") == "exception").alias("excepted"), "length")).alias("best"))
    out = named.join(plain.select(host_col, labels.alias("labels")), host_col, "left").join(best, host_col, "left")
    k = F.coalesce("best.length", F.lit(1))
    usable = F.col("labels").isNotNull()
    return out.select(host_col, "n", F.when(usable, _tail(F.col("labels"), k)).alias("suffix"), F.when(usable & (F.size("labels") > k), _tail(F.col("labels"), k + 1)).alias("registrable"))


def with_registrable(rows: DataFrame, rules: DataFrame, host_col: str = "host", most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with ``registrable`` of their host, null also for a null host; hosts that many rows have are joined apart."""
    known = suffix_table(rows, rules, host_col, most).select(host_col, "registrable")
    found = join_even(rows.where(F.col(host_col).isNotNull()), known, host_col, most)
    return found.unionByName(rows.where(F.col(host_col).isNull()).withColumn("registrable", F.lit(None).cast("string"))).select(*rows.columns, "registrable")
