"""Management of lists and settings as an ordered log of commands, of any number of stores.

A log has ``store``, ``seq`` (unique in a store), ``op``, ``domain``, ``reason``, ``value`` (boolean) and ``choice``. Ops:
``status``, ``enabled`` (value), ``mode`` and ``policy`` (choice), ``injection`` (value), ``block``, ``unblock``,
``whitelist``, ``unwhitelist``, ``remove`` (from both lists) and ``test_age``. Lists and settings at any time are folds of
the log: the last command on a domain says whether and where it stands, the last valid one on a setting its value.
Commands that are not valid, and unknown ops, change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.config import ACTIONS, MODES, SEED_BLOCKLIST, SEED_WHITELIST, Settings
from auditspark.operators.lists import valid_entry
from auditspark.operators.running import running

LOG = "store long, seq long, op string, domain string, reason string, value boolean, choice string"
#: Reason of an entry that came without one.
MANUAL = "manual"
_LIST_OPS = ("block", "unblock", "whitelist", "unwhitelist", "remove")


def _name() -> Column:
    return F.lower(F.trim(F.coalesce("domain", F.lit(""))))


def _settings() -> dict[str, Column]:
    """What a command sets, null if it sets nothing."""
    return {
        "enabled": F.when(F.col("op") == "enabled", F.col("value")),
        "mode": F.when((F.col("op") == "mode") & F.col("choice").isin(*MODES), F.col("choice")),
        "policy": F.when((F.col("op") == "policy") & F.col("choice").isin(*ACTIONS), F.col("choice")),
        "injection": F.when(F.col("op") == "injection", F.col("value")),
    }


def _defaults() -> dict[str, Column]:
    s = Settings()
    return {"enabled": F.lit(s.enabled), "mode": F.lit(s.mode), "policy": F.lit(s.enforcement), "injection": F.lit(s.injection.enabled)}


def with_seeds(log: DataFrame, block: list[str] | None = None, allow: list[str] | None = None) -> DataFrame:
    """The log after commands that put the seeds into both lists of each store, at places before 0."""
    seeds = [("block", d) for d in (SEED_BLOCKLIST if block is None else block)] + [("whitelist", d) for d in (SEED_WHITELIST if allow is None else allow)]
    if not seeds:
        return log.select("store", "seq", "op", "domain", "reason", "value", "choice")
    rows = F.array(*(F.struct(F.lit(k - len(seeds)).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(d).alias("domain")) for k, (op, d) in enumerate(seeds)))
    first = log.select("store").distinct().select("store", F.explode(rows).alias("s")).select("store", "s.seq", "s.op", "s.domain", F.lit("seed").alias("reason"), F.lit(None).cast("boolean").alias("value"), F.lit(None).cast("string").alias("choice"))
    return first.unionByName(log.select(first.columns))


def _changes(log: DataFrame) -> DataFrame:
    """A row per list and command on a domain: ``put`` is true if it adds the domain, false if it takes it away, null if it leaves the list alone."""
    valid = valid_entry(F.col("domain"))
    put = lambda add, cut: F.when((F.col("op") == add) & valid, True).when(F.col("op").isin(cut, "remove"), False)
    both = F.array(F.struct(F.lit("block").alias("list"), put("block", "unblock").alias("put")), F.struct(F.lit("whitelist").alias("list"), put("whitelist", "unwhitelist").alias("put")))
    rows = log.where(F.col("op").isin(*_LIST_OPS) & (_name() != ""))
    reason = F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit(MANUAL))
    return rows.select("store", "seq", _name().alias("domain"), reason.alias("reason"), F.explode(both).alias("c")).select("store", "seq", "domain", "reason", "c.*")


def entries_at(log: DataFrame, until: int | None = None) -> DataFrame:
    """Both lists of each store after the command ``until`` (null: after all): ``store``, ``list``, ``pos``, ``domain`` and ``reason``.

    One aggregate per list and domain, combined before the shuffle: the last command on it wins, and one that adds an
    entry again moves it to the end.
    """
    rows = _changes(log if until is None else log.where(F.col("seq") <= until)).where("put is not null")
    last = rows.groupBy("store", "list", "domain").agg(F.max_by(F.struct("put", "seq", "reason"), "seq").alias("last"))
    return last.where("last.put").select("store", "list", F.col("last.seq").alias("pos"), "domain", "last.reason")


def settings_at(log: DataFrame, until: int | None = None) -> DataFrame:
    """A row per store: ``enabled``, ``mode``, ``policy`` and ``injection`` after the command ``until``."""
    rows = log if until is None else log.where(F.col("seq") <= until)
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    return rows.groupBy("store").agg(*(F.coalesce(last(c), _defaults()[n]).alias(n) for n, c in _settings().items()))


def results(log: DataFrame, block: list[str] | None = None, allow: list[str] | None = None, age_ok: bool | None = None) -> DataFrame:
    """A row per command with what it did and how things stood after it.

    ``store``, ``seq``, ``op``, ``domain`` (as it is kept), ``ok``, ``removed``, ``in_blocklist`` and ``in_whitelist`` (of its
    domain), ``n_blocklist``, ``n_whitelist``, ``enabled``, ``mode``, ``policy`` and ``injection``. ``ok`` tells whether the
    command was valid; for ``test_age`` it is ``age_ok``, for unknown ops false. A hot store or domain is no task of its own.
    """
    rows = with_seeds(log, block, allow)
    seen = running(_changes(rows), ["store", "list", "domain"], "seq", lasts={"was": F.col("put")}, before=True)
    was = F.coalesce("was", F.lit(False))
    seen = seen.select("store", "seq", "list", was.alias("was"), F.coalesce("put", was).alias("now"))
    of = lambda c, name: F.bool_or(F.when(F.col("list") == name, F.col(c)))
    moved = seen.groupBy("store", "seq").agg(of("was", "block").alias("was_b"), of("now", "block").alias("in_blocklist"), of("was", "whitelist").alias("was_w"), of("now", "whitelist").alias("in_whitelist"))
    known = rows.alias("r").join(moved.alias("m"), F.col("r.store").eqNullSafe(F.col("m.store")) & (F.col("r.seq") == F.col("m.seq")), "left").select("r.*", *(f"m.{c}" for c in ("was_b", "in_blocklist", "was_w", "in_whitelist")))
    step = lambda now, old: F.coalesce(F.col(now).cast("long") - F.col(old).cast("long"), F.lit(0))
    out = running(known, ["store"], "seq", {"n_blocklist": step("in_blocklist", "was_b"), "n_whitelist": step("in_whitelist", "was_w")}, {f"last_{n}": c for n, c in _settings().items()})
    adds, cuts = F.col("op").isin("block", "whitelist"), F.col("op").isin("unblock", "unwhitelist", "remove")
    ok = F.when(adds, valid_entry(F.col("domain"))).when(cuts, _name() != "").when(F.col("op") == "enabled", F.col("value").isNotNull())
    ok = ok.when(F.col("op") == "mode", F.col("choice").isin(*MODES)).when(F.col("op") == "policy", F.col("choice").isin(*ACTIONS))
    ok = ok.when(F.col("op").isin("status", "injection"), True).when(F.col("op") == "test_age", F.lit(age_ok)).otherwise(False)
    gone = cuts & ((F.coalesce("was_b", F.lit(False)) & ~F.coalesce("in_blocklist", F.lit(False))) | (F.coalesce("was_w", F.lit(False)) & ~F.coalesce("in_whitelist", F.lit(False))))
    return out.where(F.col("seq") >= 0).select(
        "store", "seq", "op", F.when(F.col("op").isin(*_LIST_OPS), _name()).alias("domain"), F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(gone, F.lit(False)).alias("removed"),
        F.coalesce("in_blocklist", F.lit(False)).alias("in_blocklist"), F.coalesce("in_whitelist", F.lit(False)).alias("in_whitelist"), "n_blocklist", "n_whitelist",
        *(F.coalesce(f"last_{n}", default).alias(n) for n, default in _defaults().items()),
    )
