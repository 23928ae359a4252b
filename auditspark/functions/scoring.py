"""Scores and levels of domains, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditspark.config import Settings
from auditspark.functions.normalise import let
from auditspark.functions.urls import public_suffix

# Suffixes of either kind of risk.
LOW_RISK = ["edu", "gov", "mil", "org"]
HIGH_RISK = ["xyz", "top", "shop", "site", "online", "club", "work", "buzz", "icu", "tk", "ml", "ga", "cf", "gq"]


def level(score: Column) -> Column:
    return F.when(score >= 70, "critical").when(score >= 40, "warning").when(score >= 20, "suspicious").otherwise("trusted")


def tld_risk(domain: Column) -> Column:
    """-1, 0 or 1 by the exact public suffix."""
    return let(F.coalesce(public_suffix(domain), F.lit("")), lambda suffix: F.when(suffix.isin(LOW_RISK), -1).when(suffix.isin(HIGH_RISK), 1).otherwise(0))


def is_idn(domain: Column) -> Column:
    return domain.contains("xn--")


def odd_pattern(domain: Column) -> Column:
    """Two hyphens or three digits at least."""
    return (F.regexp_count(domain, F.lit("-")) >= 2) | (F.regexp_count(domain, F.lit("[0-9]")) >= 3)


def length_bonus(domain: Column, base, step) -> Column:
    extra = F.length(domain) - 30
    return F.when(extra > 0, F.least(F.lit(base), F.floor(extra / F.lit(step)) + 1)).otherwise(0)


def age_part(created: Column, status: Column, s: Settings) -> tuple[Column, Column]:
    """Points and reason by the year of registration, or by why it isn't known."""
    w, year = s.scoring, F.year(created)
    off = F.lit(not s.age_query) | (status == "disabled")
    points = F.when(created.isNotNull(), F.when(year >= w["cutoff_year"], w["post_cutoff"]).otherwise(0)).when(status == "failed", w["age_unavailable"]).when(off, w["age_disabled"]).otherwise(w["post_cutoff"])
    reason = F.when(created.isNotNull(), F.when(year >= w["cutoff_year"], "age_new").otherwise("age_old")).when(status == "failed", "age_failed").when(off, "age_disabled").otherwise("age_unknown")
    return points, reason


def parts(domain: Column, risk: Column, flags: dict[str, Column], tld_blocked: Column, created: Column, status: Column, s: Settings) -> list[tuple[Column, Column]]:
    """Points and reason code of each part of the normal score, in the order of the report; no reason if a part says nothing."""
    w = s.scoring
    when = lambda flag, points, code: (F.when(flag, points).otherwise(0), F.when(flag, F.lit(code)))
    long = length_bonus(domain, w["length_base"], w["length_extra_chars"])
    url = [("is_ip", "url_ip"), ("has_userinfo", "url_userinfo"), ("is_shortener", "url_shortener"), ("has_tracking", "url_tracking"), ("deep_path", "url_deep_path"), ("long_query", "url_long_query"), ("non_standard_port", "url_port")]
    return [
        when(tld_blocked & F.lit(s.blocklist_enabled[s.mode]), 40, "tld_blocked"),
        (risk * w["tld_trust"], F.when(risk < 0, "tld_low_risk").when(risk > 0, "tld_high_risk")),
        when(is_idn(domain), 15, "idn"),
        when(odd_pattern(domain), w["pattern"], "pattern"),
        (long, F.when(F.length(domain) > 30, "length")),
        *(when(flags[flag], w[key], key) for flag, key in url),
        age_part(created, status, s),
    ]


def normal(domain: Column, flags: dict[str, Column], tld_blocked: Column, created: Column, status: Column, s: Settings) -> Column:
    """``total``, the score before clamping, and ``reasons``."""

    def made(risk: Column) -> Column:
        each = parts(domain, risk, flags, tld_blocked, created, status, s)
        total = each[0][0]
        for points, _ in each[1:]:
            total = total + points
        return F.struct(total.cast("double").alias("total"), F.array_compact(F.array(*(reason for _, reason in each))).alias("reasons"))

    return let(tld_risk(domain), made)


def simple(created: Column, s: Settings) -> Column:
    return F.when(F.year(created) < s.scoring["cutoff_year"], 0).otherwise(100)
