"""Public suffixes as tables, even joins, running folds, and the log of commands."""

import random

import pytest

from auditspark.functions.urls import SUFFIXES, registrable
from auditspark.operators import audit, commands, joins, suffixes
from auditspark.operators.running import running
from pyspark.sql import functions as F


def rules_of(spark, lines):
    return suffixes.parse_rules(spark.createDataFrame([(x,) for x in lines], "value string"))


def table_of(spark, hosts, rules, most=joins.BROADCAST_ROWS):
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    return {r.host: (r.suffix, r.registrable) for r in suffixes.suffix_table(df, rules, most=most).collect()}


LIST = ["// a comment", "", None, "com", "  COM  ", "co.uk", "uk // note", ".jp", "*.ck", "!www.ck", "*.compute.example.com", "bad.*.com", "!", "*."]


def test_rules_of_a_list(spark):
    got = {(r.name, r.kind) for r in rules_of(spark, LIST).collect()}
    assert got == {("com", "plain"), ("co.uk", "plain"), ("uk", "plain"), ("jp", "plain"), ("ck", "wildcard"), ("www.ck", "exception"), ("compute.example.com", "wildcard")}


HOSTS = {
    "example.co.uk": ("co.uk", "example.co.uk"), "a.b.c.example.com": ("com", "example.com"), "localhost": ("localhost", None), "evil.example": ("example", "evil.example"),
    "co.uk": ("co.uk", None), "ck": ("ck", None), "foo.ck": ("foo.ck", None), "a.foo.ck": ("foo.ck", "a.foo.ck"), "www.ck": ("ck", "www.ck"), "x.www.ck": ("ck", "www.ck"),
    "b.compute.example.com": ("b.compute.example.com", None), "compute.example.com": ("com", "example.com"), "192.0.2.1": (None, None), "::1": (None, None), "a..com": (None, None), "a.com.": (None, None), "": (None, None),
}


@pytest.mark.parametrize("most", [joins.BROADCAST_ROWS, 2])
def test_longest_rule_and_exceptions(spark, most):
    assert table_of(spark, [*HOSTS, *HOSTS, None], rules_of(spark, LIST), most) == HOSTS


def test_no_hosts_and_no_rules(spark):
    assert table_of(spark, [], rules_of(spark, LIST)) == {}
    assert table_of(spark, ["a.b.c"], rules_of(spark, [])) == {"a.b.c": ("c", "b.c")}


def test_table_and_expression_agree(spark):
    hosts = [h for h in HOSTS if h and not h[0].isdigit() and ":" not in h] + ["a.b.com.au", "x.co.in", "q.org.uk"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    want = {r.host: r.d for r in df.select("host", registrable(F.col("host"), SUFFIXES).alias("d")).collect()}
    assert {h: d for h, (_, d) in table_of(spark, hosts, suffixes.default_rules(spark)).items()} == want


def test_ten_thousand_rules_are_no_part_of_the_plan(spark):
    lines = spark.range(10_000).select(F.concat(F.lit("zone"), "id", F.lit(".com")).alias("value"))
    texts = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("see https://a.b.zone"), F.col("id") * 7, F.lit(".com/x and https://me.co.uk")).alias("text"))
    found = audit.url_details(texts, suffixes.parse_rules(lines.unionByName(spark.createDataFrame([("co.uk",)], "value string"))))
    plan = found._jdf.queryExecution().toString()
    assert "zone77" not in plan and len(plan) < 200_000
    got = {(r.doc_id, r.domain) for r in found.collect()}
    assert got == {(k, f"b.zone{7 * k}.com") for k in range(500)} | {(k, "me.co.uk") for k in range(500)}


def test_audit_by_a_table_of_rules(spark):
    texts = spark.createDataFrame([(1, "https://a.b.shop.example/x https://192.0.2.1/ https://bit.ly/y"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "pos long, domain string, reason string, date timestamp")
    got = audit.audit(texts, none, none, rules=rules_of(spark, ["shop.example", "ly"])).collect()
    assert {r.domain for r in got} == {"b.shop.example", "192.0.2.1", "bit.ly"}
    assert "url_shortener" in next(r.reasons for r in got if r.domain == "bit.ly")


@pytest.mark.parametrize("most", [1000, 3])
def test_even_join_gives_the_same_rows(spark, most):
    rows = spark.createDataFrame([("hot", k) for k in range(300)] + [(f"k{k % 50}", k) for k in range(100)] + [(None, 1), ("alone", 1)], "key string, x int")
    side = spark.createDataFrame([("hot", "a"), ("hot", "b"), *((f"k{k}", "c") for k in range(40)), (None, "d")], "key string, y string")
    want = sorted(map(tuple, rows.join(side, "key").collect()))
    assert sorted(map(tuple, joins.join_even(rows, side, "key", most, bound=50).collect())) == want


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("blocks", [1, 3, 1000])
def test_running_folds(spark, blocks, before):
    rng = random.Random(blocks)
    rows = [(rng.choice(["a", "b", None]), k, rng.randint(-3, 3), rng.choice([None, None, "x", "y"])) for k in range(-5, 80)]
    df = spark.createDataFrame(rows, "key string, at long, n int, v string")
    got = {r.at: (r.total, r.latest) for r in running(df, ["key"], "at", {"total": F.col("n")}, {"latest": F.col("v")}, before, blocks).collect()}
    for key, at, _, _ in rows:
        past = [r for r in rows if r[0] == key and (r[1] < at if before else r[1] <= at)]
        assert got[at] == (sum(r[2] for r in past), next((r[3] for r in reversed(past) if r[3] is not None), None))
    assert running(df.where("false"), ["key"], "at", {"total": F.col("n")}).count() == 0


# --- commands


def log_of(spark, rows):
    """Rows (store, op, domain or value or choice), in order."""
    full = []
    for k, (store, op, x) in enumerate(rows):
        full.append((store, k, op, x if op in commands._LIST_OPS else None, None, x if op in ("enabled", "injection") else None, x if op in ("mode", "policy") else None))
    return spark.createDataFrame(full, commands.LOG)


STORY = [
    (1, "status", None), (1, "block", " Evil.COM "), (1, "block", "evil.com"), (1, "whitelist", "evil.com"), (1, "block", "not valid"), (1, "block", None), (1, "unblock", "none.org"), (1, "remove", "EVIL.com"),
    (1, "remove", "evil.com"), (1, "unwhitelist", "github.com"), (1, "mode", "simple"), (1, "mode", "nonsense"), (1, "policy", "ask"), (1, "policy", None), (1, "enabled", False), (1, "enabled", None),
    (1, "injection", False), (1, "injection", None), (1, "test_age", None), (1, "unknown", None), (1, None, None), (2, "block", ".xyz"), (None, "block", "a.b"), (None, "unblock", "a.b"),
]


def brute_results(rows):
    state, out = {}, []
    for k, (store, op, x) in enumerate(rows):
        s = state.setdefault(store, {"block": [".xyz", ".top"], "whitelist": ["wikipedia.org", "github.com"], "enabled": True, "mode": "normal", "policy": "deny", "injection": True})
        name, ok, removed = (x or "").strip().lower() if op in commands._LIST_OPS else None, False, False
        if op in ("block", "whitelist"):
            ok = name != "" and " " not in name and "." in name
            if ok:
                s[op] = [d for d in s[op] if d != name] + [name]
        elif op in ("unblock", "unwhitelist", "remove"):
            ok = name != ""
            for which in {"unblock": ["block"], "unwhitelist": ["whitelist"]}.get(op, ["block", "whitelist"]):
                removed |= name in s[which]
                s[which] = [d for d in s[which] if d != name]
        elif op in ("enabled", "injection"):
            ok = x is not None or op == "injection"
            s[op] = s[op] if x is None else x
        elif op in ("mode", "policy"):
            ok = x in (("normal", "simple", "whitelist") if op == "mode" else ("allow", "ask", "deny"))
            s[op] = x if ok else s[op]
        else:
            ok = op in ("status", "test_age")
        out.append((store, k, op, name, ok, removed, name in s["block"], name in s["whitelist"], len(s["block"]), len(s["whitelist"]), s["enabled"], s["mode"], s["policy"], s["injection"]))
    return out, state


def test_results_of_commands(spark):
    got = [tuple(r) for r in commands.results(log_of(spark, STORY), age_ok=True).orderBy("seq").collect()]
    assert got == brute_results(STORY)[0]


def test_lists_and_settings_at_any_time(spark):
    log = commands.with_seeds(log_of(spark, STORY))
    for until in (0, 3, 9, 13, None):
        state = brute_results(STORY[: len(STORY) if until is None else until + 1])[1]
        entries = commands.entries_at(log, until).orderBy("store", "list", "pos").collect()
        for store, s in state.items():
            for which in ("block", "whitelist"):
                assert [r.domain for r in entries if (r.store, r.list) == (store, which)] == s[which]
        settings = {r.store: (r.enabled, r["mode"], r.policy, r.injection) for r in commands.settings_at(log, until).collect()}
        assert all(settings[k] == (s["enabled"], s["mode"], s["policy"], s["injection"]) for k, s in state.items())


def test_entries_keep_their_last_reason(spark):
    rows = [(1, 0, "block", "a.b", "first", None, None), (1, 1, "block", "c.d", "  ", None, None), (1, 2, "block", "A.b", " again ", None, None)]
    got = commands.entries_at(spark.createDataFrame(rows, commands.LOG)).orderBy("pos").collect()
    assert [(r.domain, r.reason) for r in got] == [("c.d", "manual"), ("a.b", "again")]


def test_no_commands(spark):
    log = log_of(spark, [])
    assert commands.results(log).count() == commands.entries_at(commands.with_seeds(log)).count() == commands.settings_at(log).count() == 0
