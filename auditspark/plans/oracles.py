"""The same queries as SQL for DuckDB."""

from __future__ import annotations

from auditspark.functions import normalise as N
from auditspark.functions import rules as R
from auditspark.functions.urls import FLAGS, SHORTENERS, SUFFIXES, TRACKING
from auditspark.plans import views as V


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _names(values: list[str]) -> str:
    return ", ".join(_q(v) for v in values)


def _rows(values: list[str]) -> str:
    return ", ".join(f"({k}, {_q(v)})" for k, v in enumerate(values))


def _class(points: list[int]) -> str:
    return "[" + "".join(f"\\x{{{p:x}}}" for p in points) + "]"


TWO = [s for s in SUFFIXES if s.count(".") == 1 and s[0] not in "*!"]
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
URL = rf"\bhttps?://(?:[^/\s@]+@)?{_LABEL}(?:\.{_LABEL})+(?::\d{{1,5}})?(?:/[^\s\"'<>()\[\]，。；：！？、】》]*)?"
TAIL = r"[.,;:!?，。；：！？、】》）)]+$"


def suffix(domain: str) -> str:
    labels = f"string_split({domain}, '.')"
    return f"CASE WHEN len({labels}) >= 2 AND array_to_string({labels}[-2:], '.') IN ({_names(TWO)}) THEN array_to_string({labels}[-2:], '.') ELSE {labels}[-1] END"


def registrable(host: str) -> str:
    labels = f"string_split({host}, '.')"
    return f"CASE WHEN len({labels}) >= 2 AND array_to_string({labels}[-2:], '.') IN ({_names(TWO)}) THEN CASE WHEN len({labels}) >= 3 THEN array_to_string({labels}[-3:], '.') END WHEN len({labels}) >= 2 THEN array_to_string({labels}[-2:], '.') END"


IP = r"regexp_matches({0}, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$')"
CTE = rf"""
cit AS (SELECT page_id AS doc_id, {V.CITATION} AS text FROM pages),
raw AS (SELECT doc_id, list_transform(regexp_extract_all(text, {_q(URL)}), lambda u: regexp_replace(u, '{TAIL}', '')) AS u FROM cit),
flat AS (SELECT doc_id, unnest(u) AS url, generate_subscripts(u, 1) AS k FROM raw),
urls AS (SELECT doc_id, url, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(k)) - 1 AS INT) AS pos FROM flat WHERE url <> '' GROUP BY doc_id, url),
hosts AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '')) AS host, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS auth, lower(regexp_extract(url, '^[^?#]*(\?[^#]*)', 1)) AS query FROM urls),
det AS (SELECT doc_id, pos, url, CASE WHEN {IP.format("host")} THEN host ELSE {registrable("host")} END AS domain,
  CAST({IP.format("host")} AS INT) AS is_ip,
  CAST(contains(auth, '@') AS INT) AS has_userinfo,
  CAST(coalesce(({registrable("host")}) IN ({_names(SHORTENERS)}), false) AS INT) AS is_shortener,
  CAST(regexp_matches(query, '{"|".join(TRACKING)}') AS INT) AS has_tracking,
  CAST(len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) >= 4 AS INT) AS deep_path,
  CAST(length(query) >= 120 OR length(url) >= 200 AS INT) AS long_query,
  CAST(regexp_extract(auth, ':(\d+)$', 1) <> '' AND coalesce(TRY_CAST(regexp_extract(auth, ':(\d+)$', 1) AS INT), -1) <> CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS INT) AS non_standard_port,
  CAST(len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS INT) AS path_depth
  FROM hosts),
dom AS (SELECT doc_id, domain, min(pos) AS first_pos, {", ".join(f"max({f}) AS {f}" for f in FLAGS)} FROM det WHERE domain IS NOT NULL GROUP BY doc_id, domain),
bl AS (SELECT DISTINCT lower(trim(e)) AS e FROM (VALUES {_rows(V.BLOCK)}) t(k, e) WHERE trim(e) <> ''),
wl AS (SELECT DISTINCT lower(trim(e)) AS e FROM (VALUES {_rows(V.ALLOW)}) t(k, e)),
age AS (SELECT * FROM (VALUES ('example.com', 2010, 'ok'), ('site.com', 2025, 'ok'), ('nasa.gov', 1995, 'ok'), ('bit.ly', NULL, 'failed')) t(name, year, status)),
sfx AS (SELECT DISTINCT domain, CASE WHEN NOT {IP.format("domain")} THEN {suffix("domain")} END AS suffix FROM dom),
hit AS (SELECT domain, any_value(suffix) AS suffix, bool_or(coalesce(e = domain, false)) AS exact,
  bool_or(coalesce(e LIKE '.%' AND (suffix = substr(e, 2) OR suffix LIKE '%' || e), false)) AS tld_blocked,
  bool_or(coalesce(e = domain OR (e LIKE '.%' AND CASE WHEN contains(substr(e, 2), '.') THEN domain = substr(e, 2) OR domain LIKE '%' || e ELSE suffix = substr(e, 2) OR suffix LIKE '%' || e END), false)) AS blocked
  FROM sfx CROSS JOIN bl GROUP BY domain),
facts AS (SELECT d.*, h.suffix, h.exact, h.tld_blocked, h.blocked, w.e IS NOT NULL AS white, a.year, a.status,
  CASE WHEN h.suffix IN ('edu','gov','mil','org') THEN -1 WHEN h.suffix IN ('xyz','top','shop','site','online','club','work','buzz','icu','tk','ml','ga','cf','gq') THEN 1 ELSE 0 END AS risk,
  contains(d.domain, 'xn--') AS idn,
  length(regexp_replace(d.domain, '[^-]', '', 'g')) >= 2 OR length(regexp_replace(d.domain, '[^0-9]', '', 'g')) >= 3 AS odd,
  CASE WHEN length(d.domain) > 30 THEN least(10, CAST(floor((length(d.domain) - 30) / 20.0) AS INT) + 1) ELSE 0 END AS long
  FROM dom d JOIN hit h ON d.domain = h.domain LEFT JOIN wl w ON w.e = d.domain LEFT JOIN age a ON a.name = d.domain),
base AS (SELECT *, risk * 10 + CASE WHEN idn THEN 15 ELSE 0 END + CASE WHEN odd THEN 15 ELSE 0 END + long + 25 * is_ip + 25 * has_userinfo + 15 * is_shortener + 5 * has_tracking + 5 * deep_path + 3 * long_query + 5 * non_standard_port AS points,
  concat_ws('|', CASE WHEN risk < 0 THEN 'tld_low_risk' WHEN risk > 0 THEN 'tld_high_risk' END, CASE WHEN idn THEN 'idn' END, CASE WHEN odd THEN 'pattern' END, CASE WHEN length(domain) > 30 THEN 'length' END, CASE WHEN is_ip = 1 THEN 'url_ip' END, CASE WHEN has_userinfo = 1 THEN 'url_userinfo' END, CASE WHEN is_shortener = 1 THEN 'url_shortener' END, CASE WHEN has_tracking = 1 THEN 'url_tracking' END, CASE WHEN deep_path = 1 THEN 'url_deep_path' END, CASE WHEN long_query = 1 THEN 'url_long_query' END, CASE WHEN non_standard_port = 1 THEN 'url_port' END) AS why
  FROM facts),
ver AS (SELECT *, CASE WHEN exact THEN 100 WHEN white THEN 0 ELSE greatest(0, least(100, points + CASE WHEN tld_blocked THEN 40 ELSE 0 END + 20)) END AS score,
  CASE WHEN exact THEN 'blocklist' WHEN white THEN 'whitelist' ELSE 'score_engine' END AS judged_by,
  CASE WHEN exact THEN 'blocklist' WHEN white THEN 'whitelist' ELSE 'unverifiable' END AS source_kind,
  CASE WHEN exact THEN 'blocklist' WHEN white THEN 'whitelist' ELSE concat_ws('|', CASE WHEN tld_blocked THEN 'tld_blocked' END, nullif(why, ''), 'age_disabled') END AS reasons,
  CASE WHEN blocked THEN 'deny' ELSE 'allow' END AS action FROM base),
lev AS (SELECT *, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 40 THEN 'warning' WHEN score >= 20 THEN 'suspicious' ELSE 'trusted' END AS level, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first_pos) AS INT) AS rank,
  'x' AS x FROM ver),
ren AS (SELECT *, level || '  ' || CAST(score AS VARCHAR) || '  ' || domain || array_to_string(list_transform(string_split(reasons, '|'), lambda r: chr(10) || '    reason: ' || r), '') || chr(10) || '    source: ' || source_kind AS rendered FROM lev)"""


def chain(select: str) -> str:
    return f"WITH {CTE}\n{select}"


_FL = ", ".join(FLAGS)
_LEVEL = "CASE WHEN {0} >= 70 THEN 'critical' WHEN {0} >= 40 THEN 'warning' WHEN {0} >= 20 THEN 'suspicious' ELSE 'trusted' END"
_AGED = "greatest(0, least(100, points + CASE WHEN tld_blocked THEN 40 ELSE 0 END + CASE WHEN status = 'ok' THEN CASE WHEN year >= 2023 THEN 50 ELSE 0 END ELSE 20 END))"
_FLAT = "SELECT page_id AS call_id, {0} AS name, {1} AS args FROM pages".format(V.CALL_NAME, V.CALL_ARGS)
_HID = f"(SELECT doc_id, {V.HIDDEN} AS text FROM documents)"
_SUS = f"(SELECT doc_id, {V.SUSPECT} AS text FROM documents)"
_INV = _class(N.INVISIBLE)
_SP = _class(N.SPACES)
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_FOLD = f"trim(regexp_replace(text, '{_SP}+', ' ', 'g'), ' ')"
_CACHE = f"(SELECT 'd' || CAST(user_id AS VARCHAR) AS domain, ts AS seen_at, {V.KIND} AS kind FROM events)"
_AT = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_RULES = " UNION ALL ".join(f"SELECT doc_id, {_q(r[0])} AS rule_id, {_q(r[1])} AS severity, CAST(len(regexp_extract_all(norm, {_q('(?i)' + r[3])})) AS BIGINT) AS n FROM folded" for r in R.DIRECT)
_LEAF = """leaves AS (SELECT call_id, name, unnest(list_filter(regexp_extract_all(args, '"(?:[^"\\\\]|\\\\.)*"(?:\\s*:)?'), lambda x: NOT x LIKE '%:')) AS leaf, generate_subscripts(list_filter(regexp_extract_all(args, '"(?:[^"\\\\]|\\\\.)*"(?:\\s*:)?'), lambda x: NOT x LIKE '%:'), 1) AS pos FROM calls),
plain AS (SELECT call_id, name, pos, trim(leaf, '"') AS leaf FROM leaves),
found AS (SELECT call_id, name, pos, CASE WHEN regexp_matches(leaf, '^[a-z]+://[^/?#]') THEN [regexp_replace(regexp_extract(leaf, '^[a-z]+://([^/?#]*)', 1), ':\\d*$', '')] ELSE regexp_extract_all(leaf, '(?i)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\\.)+[a-z]{2,}') END AS hosts FROM plain),
each AS (SELECT call_id, name, pos, unnest(hosts) AS host, generate_subscripts(hosts, 1) AS part FROM found)"""
_LEAF = f"WITH calls AS ({_FLAT}), {_LEAF}"
_WEB = "regexp_matches(name, '(?i)^tool:web_|web[-_](search|fetch|browse)')"
_SAN = f"regexp_replace({_FOLD}, '[\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}\\x{{feff}}]', '', 'g')"

_LISTED = f"(SELECT page_id, {V.LISTED} AS e FROM pages)"
_OK = "(coalesce(nm <> '' AND CASE WHEN nm LIKE '.%' THEN length(nm) >= 2 ELSE contains(nm, '.') END AND regexp_matches(nm, '^[\\x21-\\x7e]+$') AND NOT regexp_matches(nm, '[@?#]'), false))"
_LAST = ", ".join(
    f"coalesce(arg_max({c}, CASE WHEN {c} IS NOT NULL THEN seq END), {d}) AS {n}"
    for n, c, d in (
        ("enabled", "CASE WHEN op = 'enabled' THEN value END", "true"), ("mode", "CASE WHEN op = 'mode' AND choice IN ('normal', 'simple', 'whitelist') THEN choice END", "'normal'"),
        ("policy", "CASE WHEN op = 'policy' AND choice IN ('allow', 'ask', 'deny') THEN choice END", "'deny'"), ("injection", "CASE WHEN op = 'injection' THEN value END", "true"),
    )
)
_LOG = f"""own AS (SELECT user_id AS store, event_id AS seq, {V.OP} AS op, {V.OP_DOMAIN} AS domain, {V.OP_REASON} AS reason, {V.OP_VALUE} AS value, {V.OP_CHOICE} AS choice FROM events),
log AS (SELECT *, lower(trim(coalesce(domain, ''))) AS nm FROM (SELECT * FROM own UNION ALL
  SELECT DISTINCT store, k, o, d, 'seed', CAST(NULL AS BOOLEAN), CAST(NULL AS VARCHAR) FROM own CROSS JOIN (VALUES (-4, 'block', '.xyz'), (-3, 'block', '.top'), (-2, 'whitelist', 'wikipedia.org'), (-1, 'whitelist', 'github.com')) t(k, o, d))),
ch AS (SELECT store, seq, nm, list, coalesce(nullif(trim(reason), ''), 'manual') AS reason,
  CASE WHEN op = list AND {_OK} THEN true WHEN op IN ('un' || list, 'remove') THEN false END AS put
  FROM log CROSS JOIN (VALUES ('block'), ('whitelist')) l(list) WHERE nm <> '' AND op IN ('block', 'unblock', 'whitelist', 'unwhitelist', 'remove')),
now AS (SELECT store, list, max(seq) AS pos, nm AS domain, arg_max(reason, seq) AS reason FROM ch WHERE put IS NOT NULL GROUP BY store, list, nm HAVING arg_max(put, seq))"""
_DONE = f"""was AS (SELECT *, coalesce(last_value(put IGNORE NULLS) OVER (PARTITION BY store, list, nm ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was FROM ch),
af AS (SELECT *, coalesce(put, was) AS aft FROM was),
mv AS (SELECT store, seq, bool_or(was AND list = 'block') AS wb, bool_or(aft AND list = 'block') AS ab, bool_or(was AND list = 'whitelist') AS ww, bool_or(aft AND list = 'whitelist') AS aw FROM af GROUP BY store, seq),
all_ AS (SELECT log.*, coalesce(wb, false) AS wb, coalesce(ab, false) AS ab, coalesce(ww, false) AS ww, coalesce(aw, false) AS aw FROM log LEFT JOIN mv ON log.store = mv.store AND log.seq = mv.seq),
so_far AS (SELECT *, sum(ab::BIGINT - wb::BIGINT) OVER w AS nb, sum(aw::BIGINT - ww::BIGINT) OVER w AS nw,
  coalesce(last_value(CASE WHEN op = 'enabled' THEN value END IGNORE NULLS) OVER w, true) AS enabled, coalesce(last_value(CASE WHEN op = 'mode' AND choice IN ('normal', 'simple', 'whitelist') THEN choice END IGNORE NULLS) OVER w, 'normal') AS mode,
  coalesce(last_value(CASE WHEN op = 'policy' AND choice IN ('allow', 'ask', 'deny') THEN choice END IGNORE NULLS) OVER w, 'deny') AS policy, coalesce(last_value(CASE WHEN op = 'injection' THEN value END IGNORE NULLS) OVER w, true) AS injection
  FROM all_ WINDOW w AS (PARTITION BY store ORDER BY seq ROWS UNBOUNDED PRECEDING)),
done AS (SELECT store, seq, op, CASE WHEN op IN ('block', 'unblock', 'whitelist', 'unwhitelist', 'remove') THEN nm END AS domain,
  CASE WHEN op IN ('block', 'whitelist') THEN {_OK} WHEN op IN ('unblock', 'unwhitelist', 'remove') THEN nm <> '' WHEN op = 'enabled' THEN value IS NOT NULL WHEN op = 'mode' THEN choice IN ('normal', 'simple', 'whitelist')
    WHEN op = 'policy' THEN choice IN ('allow', 'ask', 'deny') ELSE op IN ('status', 'injection') END AS ok,
  op IN ('unblock', 'unwhitelist', 'remove') AND (wb AND NOT ab OR ww AND NOT aw) AS removed, ab AS in_blocklist, aw AS in_whitelist, CAST(nb AS BIGINT) AS n_blocklist, CAST(nw AS BIGINT) AS n_whitelist, enabled, mode, policy, injection
  FROM so_far WHERE seq >= 0)"""
_SUFFIX_RULES = f"""words AS (SELECT lower(regexp_extract(coalesce({V.RULE_LINE}, ''), '^\\s*(\\S*)', 1)) AS word FROM pages),
rules AS (SELECT DISTINCT regexp_replace(word, '^(!|\\*\\.)', '') AS name, CASE WHEN word LIKE '!%' THEN 'exception' WHEN word LIKE '*.%' THEN 'wildcard' ELSE 'plain' END AS kind FROM words WHERE word <> '' AND NOT word LIKE '//%')"""
_SUFFIXED = f"""named AS (SELECT host, count(*) AS n, string_split(host, '.') AS ls, {IP.format("host")} AS ip FROM (#HOSTS#) GROUP BY host),
ends AS (SELECT host, ls, unnest(range(1, len(ls) + 1)) AS k FROM named WHERE NOT ip),
met AS (SELECT host, kind = 'exception' AS excepted, CASE kind WHEN 'exception' THEN k - 1 WHEN 'plain' THEN k ELSE CASE WHEN len(ls) > k THEN k + 1 END END AS length FROM ends JOIN rules ON rules.name = array_to_string(ls[len(ls) - k + 1:], '.')),
best AS (SELECT host, coalesce(max(length) FILTER (excepted), max(length)) AS length FROM met WHERE length IS NOT NULL GROUP BY host),
cut AS (SELECT named.*, coalesce(length, 1) AS k FROM named LEFT JOIN best ON named.host = best.host),
suffixed AS (SELECT host, n, CASE WHEN NOT ip THEN array_to_string(ls[len(ls) - k + 1:], '.') END AS suffix, CASE WHEN NOT ip AND len(ls) > k THEN array_to_string(ls[len(ls) - k:], '.') END AS registrable FROM cut)"""

ORACLES: dict[str, str] = {
    "extract_urls": chain("SELECT doc_id, pos, url FROM urls"),
    "extract_domain": chain("SELECT doc_id, url, domain FROM det WHERE domain IS NOT NULL"),
    "is_ip_literal": chain("SELECT DISTINCT url, is_ip FROM det WHERE domain IS NOT NULL"),
    "url_signals": chain(f"SELECT doc_id, url, {_FL}, path_depth FROM det WHERE domain IS NOT NULL"),
    "scan_detailed": chain("SELECT doc_id, pos, url, domain FROM det WHERE domain IS NOT NULL"),
    "scan": chain("SELECT doc_id, count(*) AS n_urls, count(DISTINCT domain) AS n_domains FROM det WHERE domain IS NOT NULL GROUP BY doc_id"),
    "domain_signals": chain(f"SELECT doc_id, domain, {_FL} FROM dom"),
    "first_seen_dedup": chain("SELECT doc_id, domain, first_pos FROM dom"),
    "level_from_score": f"SELECT event_id, {_LEVEL.format('(event_id % 101)')} AS level FROM events",
    "tld_risk": chain("SELECT DISTINCT domain, risk FROM facts"),
    "idn_check": chain("SELECT DISTINCT domain, CAST(idn AS INT) AS idn FROM facts"),
    "pattern_check": chain("SELECT DISTINCT domain, CAST(odd AS INT) AS odd FROM facts"),
    "length_bonus": chain("SELECT DISTINCT domain, CAST(long AS INT) AS bonus FROM facts"),
    "tld_blocked": chain("SELECT domain, CAST(tld_blocked AS INT) AS tld_blocked FROM hit"),
    "blocks": chain("SELECT domain, CAST(blocked AS INT) AS blocked FROM hit"),
    "score_normal": chain("SELECT doc_id, domain, CAST(greatest(0, least(100, points + 20)) AS INT) AS score, concat_ws('|', nullif(why, ''), 'age_disabled') AS reasons FROM base"),
    "age_branch": chain(f"SELECT doc_id, domain, CAST(s AS INT) AS score, {_LEVEL.format('s')} AS level, source_kind FROM (SELECT doc_id, domain, CASE WHEN exact THEN 100 WHEN white THEN 0 ELSE {_AGED} END AS s, CASE WHEN exact THEN 'blocklist' WHEN white THEN 'whitelist' WHEN status = 'ok' THEN 'api_query' ELSE 'unverifiable' END AS source_kind FROM base)"),
    "score_simple": chain("SELECT doc_id, domain, CAST(CASE WHEN exact THEN 100 WHEN status = 'ok' AND year < 2023 THEN 0 ELSE 100 END AS INT) AS score, CASE WHEN NOT exact AND status = 'ok' AND year < 2023 THEN 'trusted' ELSE 'critical' END AS level, CASE WHEN exact THEN 'blocklist' WHEN status = 'ok' THEN 'timeline_2023' ELSE 'unverifiable' END AS judged_by FROM base"),
    "score_whitelist": chain("SELECT doc_id, domain, CAST(CASE WHEN white AND NOT exact THEN 0 ELSE 100 END AS INT) AS score, CASE WHEN white AND NOT exact THEN 'trusted' ELSE 'critical' END AS level, CASE WHEN exact THEN 'blocklist' ELSE 'whitelist' END AS judged_by FROM base"),
    "classify": chain("SELECT doc_id, domain, CAST(score AS INT) AS score, level, judged_by, source_kind, reasons FROM lev"),
    "verdict_action": chain("SELECT doc_id, domain, action FROM ver"),
    "source_kind": chain("SELECT DISTINCT domain, CASE WHEN domain = 'site.com' THEN 'cache' WHEN status = 'ok' THEN 'api_query' ELSE 'unverifiable' END AS source_kind FROM facts"),
    "rank_verdicts": chain("SELECT doc_id, domain, rank FROM lev"),
    "audit_all": chain("SELECT doc_id, domain, first_pos, CAST(score AS INT) AS score, level, judged_by, action, rank FROM lev"),
    "audit_payload": chain("SELECT doc_id, domain, CAST(white AS INT) AS in_whitelist, CAST(exact AS INT) AS in_blocklist FROM lev"),
    "render_verdict": chain("SELECT doc_id, domain, rendered FROM ren"),
    "render_report": chain("SELECT doc_id, 'Sources by threat (' || CAST(count(*) AS VARCHAR) || ' domains)' || chr(10) || string_agg(rendered, chr(10) || chr(10) ORDER BY rank) || chr(10) || 'Policy: deny' AS report FROM ren GROUP BY doc_id"),
    "summary_line": chain("SELECT doc_id, CASE WHEN count(*) FILTER (level <> 'trusted') = 0 THEN CAST(count(*) AS VARCHAR) || ' sources, all trusted' ELSE CAST(count(*) AS VARCHAR) || ' sources, ' || CAST(count(*) FILTER (level <> 'trusted') AS VARCHAR) || ' suspicious' END AS summary FROM lev GROUP BY doc_id"),
    "non_trusted_count": chain("SELECT doc_id, count(*) FILTER (level <> 'trusted') AS n_bad FROM lev GROUP BY doc_id"),
    "citation_audit": chain("""SELECT c.doc_id, CASE WHEN count(r.domain) = 0 THEN '' WHEN count(*) FILTER (r.level <> 'trusted') = 0 THEN CAST(count(r.domain) AS VARCHAR) || ' sources, all trusted'
        ELSE CAST(count(r.domain) AS VARCHAR) || ' sources, ' || CAST(count(*) FILTER (r.level <> 'trusted') AS VARCHAR) || ' suspicious' END AS summary,
        'Sources by threat (' || CAST(count(r.domain) AS VARCHAR) || ' domains)' || chr(10) || coalesce(string_agg(r.rendered, chr(10) || chr(10) ORDER BY r.rank), '') AS report, count(r.domain) AS domain_count,
        coalesce(string_agg(r.domain || ' ' || CAST(r.score AS VARCHAR) || ' ' || r.action, '|' ORDER BY r.rank), '') AS verdicts FROM cit c LEFT JOIN ren r ON c.doc_id = r.doc_id GROUP BY c.doc_id"""),
    "ignore_filter": chain("SELECT doc_id, domain FROM lev WHERE domain NOT IN ('bit.ly', 'site.com')"),
    "read_list": f"SELECT min(page_id) AS pos, lower(trim(e)) AS domain FROM {_LISTED} WHERE trim(e) <> '' GROUP BY lower(trim(e))",
    "list_sets": f"SELECT DISTINCT lower(trim(e)) AS domain, CASE WHEN trim(e) LIKE '.%' THEN 'dotted' ELSE 'exact' END AS kind FROM {_LISTED} WHERE trim(e) <> ''",
    "domain_validation": r"""WITH v AS (SELECT page_id, lower(trim(url)) AS a, lower(trim(regexp_extract(url, '^https?://([^/]+)', 1))) AS b, lower(trim('.' || regexp_extract(url, '([a-z]+)\.example', 1))) AS c FROM pages)
        SELECT page_id, """ + ", ".join(f"CAST({x} <> '' AND CASE WHEN {x} LIKE '.%' THEN length({x}) >= 2 ELSE contains({x}, '.') END AND regexp_matches({x}, '^[\\x21-\\x7e]+$') AND NOT regexp_matches({x}, '[@?#]') AS INT) AS {n}" for x, n in (("a", "url_ok"), ("b", "host_ok"), ("c", "dotted_ok"))) + " FROM v",
    "ensure_seeded": f"SELECT page_id AS pos, e AS domain, 'fixed' AS reason FROM {_LISTED} UNION ALL SELECT k, d, 'seed' FROM (VALUES (-3::BIGINT, '.com'), (-2, '.top'), (-1, 'wikipedia.org')) t(k, d) WHERE d NOT IN (SELECT e FROM {_LISTED} WHERE e IS NOT NULL)",
    "add_to_list": f"WITH l AS (SELECT min(page_id) AS pos, lower(trim(e)) AS domain FROM {_LISTED} WHERE trim(e) <> '' GROUP BY lower(trim(e))) SELECT pos, domain, 'fixed' AS reason FROM l WHERE domain <> '.com' UNION ALL SELECT max(pos) + 1, '.com', 'again' FROM l",
    "remove_from_list": f"SELECT min(page_id) AS pos, lower(trim(e)) AS domain FROM {_LISTED} WHERE trim(e) <> '' AND lower(trim(e)) <> '.com' GROUP BY lower(trim(e))",
    "status_payload": f"""WITH {_LOG}, s AS (SELECT store, {_LAST} FROM log GROUP BY store), n AS (SELECT store, count(*) FILTER (list = 'block') AS b, count(*) FILTER (list = 'whitelist') AS w FROM now GROUP BY store)
        SELECT s.store, enabled, mode, policy, injection, coalesce(b, 0) AS n_block, coalesce(w, 0) AS n_whitelist FROM s LEFT JOIN n ON s.store = n.store""",
    "invisible_count": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_INV}')) AS BIGINT) AS n, round(len(regexp_extract_all(text, '{_INV}')) / CAST(length(text) AS DOUBLE), 9) AS ratio FROM {_HID}",
    "strip_invisible": f"SELECT doc_id, md5(regexp_replace(text, '{_INV}', '', 'g')) AS digest FROM {_HID}",
    "invisible_in_word": f"SELECT doc_id, CAST(regexp_matches(text, '[\\p{{L}}\\p{{N}}]{_INV}[\\p{{L}}\\p{{N}}]') AS INT) AS inside FROM {_HID}",
    "half_width": f"SELECT doc_id, md5(translate(text, {_q(_WIDE)}, {_q(''.join(chr(ord(c) - 0xFEE0) for c in _WIDE))})) AS digest FROM {_HID}",
    "homoglyphs": f"SELECT doc_id, md5(translate(text, {_q(''.join(N.HOMOGLYPHS))}, {_q(''.join(N.HOMOGLYPHS.values()))})) AS digest FROM {_HID}",
    "fold_space": f"SELECT doc_id, md5({_FOLD}) AS digest FROM {_HID}",
    "rule_scan": f"WITH folded AS (SELECT doc_id, {_FOLD} AS norm FROM {_SUS}) SELECT doc_id, rule_id, n FROM ({_RULES}) WHERE n > 0",
    "notice_summary": f"""WITH b AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z]+', ' ', 'g') || ' zz ' || {V.SAID} AS text FROM documents WHERE doc_id % 11 <> 0), folded AS (SELECT doc_id, {_FOLD} AS norm FROM b)
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_findings, CAST(sum(CASE WHEN severity = 'high' THEN n ELSE 0 END) AS BIGINT) AS n_high FROM ({_RULES}) WHERE n > 0 GROUP BY doc_id""",
    "age_query": chain("SELECT DISTINCT domain, CASE WHEN regexp_matches(domain, '[0-9]') THEN 'failed' ELSE 'ok' END AS status, CASE WHEN NOT regexp_matches(domain, '[0-9]') THEN CAST(1990 + length(domain) % 30 AS INT) END AS year FROM dom"),
    "norm_anomaly": f"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '{_INV}')) / CAST(length(text) AS DOUBLE) > 0.001 THEN 'medium' ELSE 'low' END AS severity FROM {_HID} WHERE regexp_matches(text, '{_INV}')",
    "hidden_in_word": f"SELECT doc_id, 'high' AS severity FROM {_HID} WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]{_INV}[\\p{{L}}\\p{{N}}]')",
    "printable_ratio": rf"SELECT doc_id, round(len(regexp_extract_all(text, '[\x20-\x7e\t\n\r]')) / CAST(length(text) AS DOUBLE), 9) AS ratio FROM {_HID}",
    "sanitize_untrusted": f"SELECT doc_id, md5(regexp_replace(CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '…' ELSE t END, '([\\\\`])', '\\\\\\1', 'g')) AS digest FROM (SELECT doc_id, {_SAN} AS t FROM {_HID})",
    "evidence": f"SELECT doc_id, md5(CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END) AS digest FROM (SELECT doc_id, {_FOLD} AS t FROM {_HID})",
    "merge_findings": f"""WITH b AS (SELECT {V.RESPONSE} AS response_id, doc_id, doc_id % 3 AS pos, {V.SOURCE} AS url,
          CASE WHEN doc_id % 11 = 0 THEN NULL ELSE regexp_replace(lower(text), '[^a-z]+', ' ', 'g') || ' zz ' || {V.SAID} END AS text FROM documents WHERE ({V.TOOL}) = 'web_fetch'),
        folded AS (SELECT doc_id, {_FOLD} AS norm FROM b WHERE text IS NOT NULL), k AS (SELECT doc_id, sum(n) AS n, sum(CASE WHEN severity = 'high' THEN n ELSE 0 END) AS h FROM ({_RULES}) GROUP BY doc_id)
        SELECT response_id, count(text) AS n_blocks, coalesce(sum(n), 0) = 0 AS clean, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_findings, CAST(coalesce(sum(h), 0) AS BIGINT) AS n_high,
          CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS scanned_bytes, false AS truncated, arg_min(url, CASE WHEN url IS NOT NULL THEN pos END) AS url
        FROM b LEFT JOIN k ON b.doc_id = k.doc_id GROUP BY response_id""",
    "benign_comment": f"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<!--(?s:.)*?-->')) AS comment, generate_subscripts(regexp_extract_all(html, '<!--(?s:.)*?-->'), 1) - 1 AS pos FROM pages),
        b AS (SELECT page_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(comment, '^<!--', ''), '-->$', ''), '{_SP}+', ' ', 'g'), ' ') AS body FROM c)
        SELECT page_id, CAST(pos AS INT) AS pos, CAST(body = '' OR ((length(body) <= 80 OR regexp_matches(body, '(?i)^(?:\\[if|\\[endif\\]|!|build|built|generated|version|copyright|\\(c\\))')) AND NOT ({" OR ".join(f"regexp_matches(body, {_q('(?i)' + r[3])})" for r in R.DIRECT)})) AS INT) AS benign FROM b""",
    "tool_filter": f"SELECT call_id, CAST({_WEB} AS INT) AS web, CAST(regexp_matches(name, '(?i)^tool:web_fetch|^web[-_]fetch') AS INT) AS fetch FROM ({_FLAT})",
    "deep_strings": _LEAF + " SELECT call_id, leaf FROM plain",
    "collect_domains": _LEAF + f" SELECT DISTINCT call_id, {registrable('lower(host)')} AS domain FROM each",
    "block_decision": _LEAF + f""", doms AS (SELECT call_id, name, pos, part, {registrable('lower(host)')} AS domain FROM each),
        bl AS (SELECT DISTINCT lower(trim(e)) AS e FROM (VALUES {_rows(V.BLOCK)}) t(k, e) WHERE trim(e) <> ''),
        bad AS (SELECT d.call_id, arg_min(domain, pos * 1000 + part) AS domain FROM doms d JOIN bl ON (e = domain OR (e LIKE '.%' AND (domain = substr(e, 2) OR domain LIKE '%' || e))) WHERE {_WEB} GROUP BY d.call_id)
        SELECT c.call_id, CASE WHEN b.domain IS NULL THEN 'allow' ELSE 'deny' END AS decision, b.domain FROM calls c LEFT JOIN bad b ON c.call_id = b.call_id""",
    "last_assistant": "SELECT conv_id, trim(arg_max(text, turn)) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id HAVING trim(arg_max(text, turn)) <> ''",
    "current_turn": "WITH a AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS anchor FROM conversations) SELECT conv_id, turn, role FROM a WHERE anchor IS NULL OR turn > anchor",
    "audit_input": """WITH a AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS anchor FROM conversations),
        t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS tools FROM a WHERE (anchor IS NULL OR turn > anchor) AND role NOT IN ('assistant', 'user') GROUP BY conv_id),
        l AS (SELECT conv_id, trim(arg_max(text, turn)) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id HAVING trim(arg_max(text, turn)) <> '')
        SELECT l.conv_id, CASE WHEN coalesce(trim(tools), '') = '' THEN text ELSE text || chr(10) || chr(10) || trim(tools) END AS text FROM l LEFT JOIN t ON l.conv_id = t.conv_id""",
    "pick_session": "SELECT conv_id % 50 AS list_id, arg_min(conv_id, CASE WHEN role = 'system' THEN 1 WHEN turn > 3 THEN 2 ELSE 3 END * 1000000000000 + conv_id * 1000 + turn) AS session_id FROM conversations GROUP BY conv_id % 50",
    "audit_trigger": f"""WITH a AS (SELECT user_id AS session_id, ts, event_type AS text, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS nxt FROM events),
        r AS (SELECT session_id, ts, text, lag(text) OVER (PARTITION BY session_id ORDER BY ts, text) AS before FROM a WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 800000)
        SELECT session_id, {_AT.format('ts')} AS at, text FROM r WHERE before IS NULL OR before <> text""",
    "cache_ok_immutable": f"SELECT domain, {_AT.format('min(seen_at)')} AS ok_at FROM {_CACHE} WHERE kind = 'ok' GROUP BY domain",
    "cache_failed_ttl": f"SELECT domain, CAST(TIMESTAMP '{V.NOW}' - max(seen_at) > INTERVAL 7 DAY AS INT) AS expired FROM {_CACHE} WHERE kind = 'failed' GROUP BY domain",
    "cache_upsert": f"""WITH c AS (SELECT * FROM {_CACHE}), f AS (SELECT domain, max(CASE WHEN kind = 'failed' THEN seen_at END) AS failed_at FROM c GROUP BY domain),
        o AS (SELECT c.domain, min(seen_at) AS ok_at FROM c JOIN f ON c.domain = f.domain WHERE kind = 'ok' AND (failed_at IS NULL OR seen_at > failed_at) GROUP BY c.domain)
        SELECT f.domain, CASE WHEN ok_at IS NULL THEN 'failed' ELSE 'ok' END AS kind, {_AT.format('coalesce(ok_at, failed_at)')} AS seen_at FROM f LEFT JOIN o ON f.domain = o.domain""",
    "age_resolver": chain("SELECT DISTINCT domain, coalesce(status, 'failed') AS status, CAST(CASE WHEN status = 'ok' THEN year END AS INT) AS year FROM facts"),
    "age_lookup_cap": chain("SELECT doc_id, domain, coalesce(status, 'failed') AS age_status FROM facts"),
    "extend_token": f"WITH t AS (SELECT page_id AS doc_id, regexp_extract(text, '(https?://[a-z0-9.-]+)', 1) AS u, CAST(page_id % 7 AS VARCHAR) AS k FROM (SELECT page_id, {V.CITATION} AS text FROM pages)) SELECT doc_id, u || '。evil' || k || '.xyz' AS url, 'evil' || k || '.xyz' AS domain FROM t WHERE contains(substr(u, 9), '.')",
    "apply_list_op": f"WITH {_LOG}, {_DONE} SELECT store, seq, op, domain, ok, removed, in_whitelist, in_blocklist, n_whitelist, n_blocklist FROM done WHERE op IN ('block', 'unblock', 'whitelist', 'unwhitelist')",
    "citation_manage": f"WITH {_LOG}, {_DONE} SELECT * FROM done",
    "list_history": f"WITH {_LOG} SELECT store, list, pos, domain, reason FROM now",
    "suffix_rules": f"WITH {_SUFFIX_RULES} SELECT * FROM rules",
    "suffix_table": f"WITH {_SUFFIX_RULES}, {_SUFFIXED.replace('#HOSTS#', f'SELECT {V.HOST} AS host FROM pages')} SELECT host, n, suffix, registrable FROM suffixed",
    "url_details_by_table": chain("SELECT 1").rpartition(chr(10))[0] + f""", {_SUFFIX_RULES}, {_SUFFIXED.replace("#HOSTS#", "SELECT host FROM hosts")}
        SELECT doc_id, pos, url, CASE WHEN {IP.format("hosts.host")} THEN hosts.host ELSE coalesce(registrable, hosts.host) END AS domain, CAST(coalesce(registrable IN ({_names(SHORTENERS)}), false) AS INT) AS is_shortener
        FROM hosts JOIN suffixed ON hosts.host = suffixed.host""",
    "safe_key": "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS key FROM pages",
    "migrate_legacy": "WITH r AS (SELECT page_id, 'k' || CAST(page_id % 100 AS VARCHAR) AS key FROM pages) SELECT page_id, key FROM r WHERE page_id % 3 <> 0 AND key NOT IN (SELECT key FROM r WHERE page_id % 7 = 0)",
    "invisible_ratio": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_INV}')) / CAST(length(text) AS DOUBLE) > 0.001 AS INT) AS high FROM {_HID}",
    "invisible_homoglyph": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_INV}')) AS BIGINT) AS n_invisible, CAST(len(regexp_extract_all(text, '{_class([ord(c) for c in N.HOMOGLYPHS])}')) AS BIGINT) AS n_homoglyphs FROM {_HID}",
    "nonce": "SELECT page_id, 1 AS ok FROM pages",
    "pick_nodes": "SELECT conv_id, CASE WHEN count(*) FILTER (role = 'system') > 0 THEN count(*) FILTER (role = 'system') ELSE count(*) END AS n_nodes FROM conversations GROUP BY conv_id",
    "is_settled": "SELECT event_id, CAST(event_id % 8 IN (0, 1, 2, 3) AS INT) AS interrupted, CAST(event_id % 8 NOT IN (1, 4) AS INT) AS settled FROM events",
    "session_reset": "WITH l AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events) SELECT user_id AS viewer, CAST(count(*) FILTER (event_type IS DISTINCT FROM before) AS BIGINT) AS n_visits FROM l GROUP BY user_id",
    "tool_text": f"SELECT page_id AS call_id, CASE WHEN contains({V.CALL_NAME}, 'web') THEN {V.CALL_NAME} || ' ' || {V.CALL_ARGS} || chr(10) ELSE '' END || url AS text FROM pages",
}
