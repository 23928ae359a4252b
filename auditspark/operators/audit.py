"""Citation audit: text to URLs, domains, signals, verdicts, ranks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.config import Settings
from auditspark.functions import scoring
from auditspark.functions.urls import FLAGS, detail, details, extract_urls, host
from auditspark.operators import lists
from auditspark.operators.suffixes import with_registrable

#: Characters of a text that are audited, and domains of a text whose age is looked up: both limits are part of the audit, and parameters.
AUDIT_CHARS, AGE_LOOKUPS = 65_536, 100


def url_details(texts: DataFrame, rules: list[str] | DataFrame | None = None, chars: int = AUDIT_CHARS) -> DataFrame:
    """A row per distinct URL of a text with a domain: doc_id, pos (from 0), url, domain and its signals.

    ``rules`` are public suffixes: a few as a list, which is part of the plan, or any number as a table (see ``suffixes``).
    """
    urls = extract_urls(F.substring("text", 1, chars))
    if not isinstance(rules, DataFrame):
        return texts.select("doc_id", F.explode(details(urls, rules)).alias("d")).select("doc_id", "d.*")
    rows = texts.select("doc_id", F.posexplode(urls).alias("pos", "url")).withColumn("host", host(F.col("url")))
    known = with_registrable(rows, rules)
    return known.select("doc_id", detail(F.col("url"), F.col("pos"), F.col("registrable")).alias("d")).select("doc_id", "d.*").where("domain is not null")


def domain_signals(details: DataFrame) -> DataFrame:
    """A row per text and domain: each signal if any URL has it, and where the domain is first seen."""
    return details.groupBy("doc_id", "domain").agg(F.min("pos").alias("first_pos"), *(F.bool_or(f).alias(f) for f in FLAGS))


def with_ages(domains: DataFrame, ages: DataFrame | None, settings: Settings, lookups: int = AGE_LOOKUPS) -> DataFrame:
    """With ``creation_date`` and ``age_status``; only a text's first domains are looked up, all stay."""
    if ages is None or not settings.age_query:
        return domains.withColumns({"creation_date": F.lit(None).cast("timestamp"), "age_status": F.lit("disabled")})
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_pos"))
    wanted = domains.withColumn("lookup", F.when(rank <= lookups, F.col("domain")))
    known = ages.select(F.col("domain").alias("lookup"), "creation_date", F.col("status").alias("age_status"))
    joined = wanted.join(known, "lookup", "left")
    return joined.select(*domains.columns, F.when(F.col("age_status") == "ok", F.col("creation_date")).alias("creation_date"), F.coalesce("age_status", F.lit("failed")).alias("age_status"))


def classify(domains: DataFrame, block: DataFrame, allow: DataFrame, settings: Settings) -> DataFrame:
    """Verdicts: blocklist first, then whitelist, then the mode's own score."""
    s, mode = settings, settings.mode
    judged = lists.allowed(lists.blocked(domains, block), allow)
    score = scoring.normal(F.col("domain"), {f: F.col(f) for f in FLAGS}, F.col("tld_blocked"), F.col("creation_date"), F.col("age_status"), s)
    judged = judged.withColumn("__score", score)
    total, reasons = F.col("__score.total"), F.col("__score.reasons")
    by_list = F.col("exact") & F.lit(s.blocklist_enabled[mode])
    by_white = F.col("whitelisted") & F.lit(mode == "whitelist" or mode == "normal" and s.whitelist_normal)
    if mode == "normal":
        own, why, judge = total, reasons, F.lit("score_engine")
    elif mode == "simple":
        own = scoring.simple(F.col("creation_date"), s).cast("double")
        why = F.array(F.when(F.col("creation_date").isNull(), "age_unknown").when(own == 0, "age_old").otherwise("age_new"))
        judge = F.when(F.col("creation_date").isNull(), "unverifiable").otherwise("timeline_2023")
    else:
        own, why, judge = F.lit(100.0), F.array(F.lit("not_whitelisted")), F.lit("whitelist")
    raw = F.when(by_list, 100.0).when(by_white, 0.0).otherwise(own)
    kind = F.lit("unverifiable") if mode == "whitelist" else F.when(F.col("creation_date").isNotNull(), "api_query").otherwise("unverifiable")
    action = F.when(F.lit(s.blocklist_enabled[mode]) & F.col("blocked"), s.enforcement).otherwise("allow")
    return judged.select(
        "doc_id", "domain", "first_pos",
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).cast("int").alias("score"),
        scoring.level(raw).alias("level"),
        F.when(by_list, F.array(F.lit("blocklist"))).when(by_white, F.array(F.lit("whitelist"))).otherwise(why).alias("reasons"),
        F.when(by_list, "blocklist").when(by_white, "whitelist").otherwise(judge).alias("judged_by"),
        F.when(by_list, "blocklist").when(by_white, "whitelist").otherwise(kind).alias("source_kind"),
        action.alias("action"), "creation_date",
    )


def rank_verdicts(verdicts: DataFrame) -> DataFrame:
    """With ``rank``: within a text by falling score, equals as first seen."""
    return verdicts.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "first_pos")))


def audit(texts: DataFrame, block: DataFrame, allow: DataFrame, settings: Settings | None = None, ages: DataFrame | None = None, rules: list[str] | DataFrame | None = None) -> DataFrame:
    """The whole chain. Disabled settings judge nothing."""
    settings = settings or Settings()
    if not settings.enabled:
        texts = texts.where("false")
    return rank_verdicts(classify(with_ages(domain_signals(url_details(texts, rules)), ages, settings), block, allow, settings))


def summaries(verdicts: DataFrame) -> DataFrame:
    """A row per text: number of domains, of those that aren't trusted, and the line for its end."""
    counted = verdicts.groupBy("doc_id").agg(F.count("*").alias("n_domains"), F.count_if(F.col("level") != "trusted").alias("n_bad"))
    line = F.when(F.col("n_bad") == 0, F.concat(F.col("n_domains").cast("string"), F.lit(" sources, all trusted"))).otherwise(F.concat(F.col("n_domains").cast("string"), F.lit(" sources, "), F.col("n_bad").cast("string"), F.lit(" suspicious")))
    return counted.withColumn("summary", line)


def render_verdicts(verdicts: DataFrame) -> DataFrame:
    head = F.concat_ws("  ", "level", F.col("score").cast("string"), "domain")
    rest = F.array_join(F.transform("reasons", lambda r: F.concat(F.lit("\n    reason: "), r)), "")
    return verdicts.withColumn("rendered", F.concat(head, rest, F.lit("\n    source: "), F.col("source_kind")))


def render_reports(verdicts: DataFrame, enforcement: str | None = None) -> DataFrame:
    """A report per text, its verdicts by rank."""
    rows = render_verdicts(verdicts).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "rendered"))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["rendered"]), "\n\n")
    head = F.concat(F.lit("Sources by threat ("), F.size("all").cast("string"), F.lit(" domains)\n"))
    tail = F.lit(f"\nPolicy: {enforcement}" if enforcement else "")
    return rows.select("doc_id", F.concat(head, body, tail).alias("report"))


def payload(verdicts: DataFrame, block: DataFrame, allow: DataFrame) -> DataFrame:
    """Verdicts with whether either list has exactly the domain."""
    names = lambda entries, name: lists.sets(entries)[0].select("domain", F.lit(True).alias(name))
    out = verdicts.join(names(allow, "in_whitelist"), "domain", "left").join(names(block, "in_blocklist"), "domain", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_whitelist", "in_blocklist")})


def without_ignored(verdicts: DataFrame, ignored: DataFrame) -> DataFrame:
    return verdicts.join(ignored.select("domain").distinct(), "domain", "left_anti")


def citation_audit(texts: DataFrame, block: DataFrame, allow: DataFrame, settings: Settings | None = None, ages: DataFrame | None = None) -> DataFrame:
    """A row per text: ``summary`` (empty without domains), ``report``, ``domain_count`` and ``verdicts``, an array by rank."""
    columns = ["domain", "score", "level", "reasons", "source_kind", "action", "creation_date"]
    rendered = render_verdicts(audit(texts, block, allow, settings, ages))
    rows = rendered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "rendered", *columns))).alias("all"))
    rows = texts.select("doc_id").join(rows, "doc_id", "left").withColumn("all", F.coalesce("all", F.array()))
    n, bad = F.size("all"), F.size(F.filter("all", lambda v: v["level"] != "trusted"))
    end = F.when(bad == 0, F.lit(" sources, all trusted")).otherwise(F.concat(F.lit(" sources, "), bad.cast("string"), F.lit(" suspicious")))
    report = F.concat(F.lit("Sources by threat ("), n.cast("string"), F.lit(" domains)\n"), F.array_join(F.transform("all", lambda v: v["rendered"]), "\n\n"))
    verdicts = F.transform("all", lambda v: F.struct(*(v[c].alias(c) for c in columns)))
    return rows.select("doc_id", F.when(n > 0, F.concat(n.cast("string"), end)).otherwise("").alias("summary"), report.alias("report"), n.alias("domain_count"), verdicts.alias("verdicts"))
