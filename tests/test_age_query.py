"""The user's own function for ages: limits, failures, and its place behind the cache."""

import datetime as dt
import os
import time

import pytest

from auditspark.operators import age_query

UTC = dt.UTC


def lookup(domain):
    """Behaves as the name says."""
    if domain == "forever.com":
        while True:
            pass
    if domain == "dies.com":
        os._exit(3)
    if domain == "greedy.com":
        return str(bytearray(2**31))
    return {
        "iso.com": "2001-02-03T04:05:06", "zone.com": "2001-02-03T04:05:06+02:00", "ms.com": 981173106000, "dict.com": {"creation_date": "1999-01-01"}, "date.com": dt.date(2010, 5, 6), "wikipedia.org": "2001-01-13",
        "none.com": None, "bool.com": True, "text.com": "long ago", "list.com": [1], "empty.com": {}, "nan.com": float("nan"),
    }[domain]


GOOD = {"iso.com": dt.datetime(2001, 2, 3, 4, 5, 6), "zone.com": dt.datetime(2001, 2, 3, 2, 5, 6), "ms.com": dt.datetime(2001, 2, 3, 4, 5, 6), "dict.com": dt.datetime(1999, 1, 1), "date.com": dt.datetime(2010, 5, 6)}
BAD = ["none.com", "bool.com", "text.com", "list.com", "empty.com", "nan.com", "unknown.com", "dies.com", "forever.com", "greedy.com"]


def test_every_failure_is_a_row(spark):
    df = spark.createDataFrame([(d,) for d in [*GOOD, *BAD, "iso.com", None]], "domain string").coalesce(1)
    start = time.monotonic()
    got = {r.domain: (r.creation_date, r.status, r.error) for r in age_query.query_ages(df, lookup, deadline=2).collect()}
    assert time.monotonic() - start < 40
    assert {d: x[0] for d, x in got.items() if x[1] == "ok"} == GOOD
    assert {d for d, x in got.items() if x[1] == "failed"} == set(BAD) and all(x[0] is None and x[2] for x in got.values() if x[1] == "failed")
    assert "2 seconds" in got["forever.com"][2] and "without an answer" in got["dies.com"][2] and "MemoryError" in got["greedy.com"][2]
    assert age_query.query_ages(df.where("false"), lookup).count() == 0


def test_a_call_that_never_ends_costs_one_deadline():
    start = time.monotonic()
    rows = list(age_query.run_calls(lookup, iter(["forever.com", *["iso.com"] * 6]), deadline=1.5))
    assert 1.4 < time.monotonic() - start < 3
    assert [r[2] for r in rows].count("ok") == 6 and rows[-1][0] == "forever.com"


@pytest.mark.parametrize("in_flight", [1, 3])
def test_calls_in_flight_are_bounded(in_flight):
    asked = []

    def names():
        for k in range(9):
            asked.append(k)
            yield "iso.com"

    for n, _ in enumerate(age_query.run_calls(lookup, names(), in_flight=in_flight)):
        assert len(asked) <= n + in_flight + 1
    assert len(asked) == 9


def test_calls_are_made_only_behind_the_cache(spark):
    t = dt.datetime(2024, 1, 1)
    cache = spark.createDataFrame([("forever.com", t, "ok", dt.datetime(1995, 1, 1)), ("iso.com", t, "failed", None)], "domain string, seen_at timestamp, kind string, creation_date timestamp")
    domains = spark.createDataFrame([(1, "forever.com"), (2, "iso.com"), (3, "none.com"), (4, "iso.com")], "doc_id long, domain string")
    got = {r.doc_id: (r.creation_date, r.status, r.source_kind) for r in age_query.resolve_with(domains, cache, lookup, deadline=20).collect()}
    assert got == {1: (dt.datetime(1995, 1, 1), "ok", "cache"), 2: (GOOD["iso.com"], "ok", "api_query"), 3: (None, "failed", "unverifiable"), 4: (GOOD["iso.com"], "ok", "api_query")}


def test_function_is_tried_first():
    assert age_query.try_age(lookup) == (True, "2001-01-13T00:00:00")
    ok, error = age_query.try_age(lambda domain: 1 / 0)
    assert not ok and "ZeroDivisionError" in error
