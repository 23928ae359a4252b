"""URLs in text, their hosts and registrable domains, and what their structure tells, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditspark.functions.normalise import let

# Registrable domains of link shorteners, and parts of a query that tell of tracking.
SHORTENERS = ["bit.ly", "t.co", "tinyurl.com", "goo.gl", "ow.ly", "is.gd", "buff.ly", "t.cn", "dwz.cn", "suo.im", "url.cn"]
TRACKING = ["utm_", "gclid", "gbraid", "wbraid", "fbclid", "msclkid", "dclid", "yclid", "mc_cid", "mc_eid", "_ga", "igshid", "ttclid"]

#: Public suffixes that are used unless others are given; '*.' and '!' as in the public list. Unlisted: the last label.
SUFFIXES = ["com", "org", "net", "gov", "edu", "mil", "int", "io", "ly", "xyz", "top", "example", "uk", "co.uk", "org.uk", "gov.uk", "ac.uk", "jp", "co.jp", "cn", "com.cn", "au", "com.au", "br", "com.br", "in", "co.in", "*.ck", "!www.ck"]

#: White space inside a character class.
_SPACE = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_ON = r"(?:[A-Za-z0-9._-]|%[0-9a-fA-F]{2}(?=[A-Za-z0-9])|[。．｡](?=[A-Za-z0-9]))"
_PATH = rf"/[^{_SPACE}\"'<>()\[\]，。；：！？、】》]*"
URL = rf"(?<![A-Za-z0-9_])https?://(?:[^/{_SPACE}@]+@)?{_LABEL}(?:\.{_LABEL})+(?::\d{{1,5}})?(?:{_PATH}|{_ON}+)?"
TAIL = r"[.,;:!?，。；：！？、】》）)]+$"
IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


def extract_urls(text: Column) -> Column:
    """Distinct URLs in the order of their first place, without punctuation at their ends; null text has none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, TAIL, ""))
    return F.array_distinct(F.filter(found, lambda u: u != ""))


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


def _host(authority: Column) -> Column:
    bare = F.translate(F.regexp_replace(authority, r"^.*@|:\d*$", ""), "。．｡", "...")
    decoded = let(bare, lambda b: F.when(b.contains("%"), F.coalesce(F.try_url_decode(b), b)).otherwise(b))
    return F.nullif(F.lower(decoded), F.lit(""))


def host(url: Column) -> Column:
    """The lower-case host: user and port taken off, encoded and ideographic dots resolved; null if there is none."""
    return _host(_authority(url))


def is_ip(host_: Column) -> Column:
    """IPv4 in four numbers (of any size) or anything with a colon."""
    return host_.rlike(IPV4) | host_.contains(":")


def _tail(labels: Column, k: Column) -> Column:
    return F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")


def _suffix_length(labels: Column, rules: list[str]) -> Column:
    """Labels of the longest public suffix."""
    usual = [r for r in rules if not r.startswith(("*.", "!"))]
    wild, excepted = [r[2:] for r in rules if r.startswith("*.")], [r[1:] for r in rules if r.startswith("!")]
    at = lambda k, names: _tail(labels, k).isin(names) if names else F.lit(False)
    all_k = F.sequence(F.lit(1), F.size(labels))
    longest = F.array_max(F.filter(all_k, lambda k: at(k, usual) | ((k > 1) & at(k - 1, wild))))
    if excepted:
        longest = F.coalesce(F.array_max(F.filter(all_k, lambda k: at(k, excepted))) - 1, longest)
    return F.coalesce(longest, F.lit(1))


def public_suffix(domain: Column, rules: list[str] | None = None) -> Column:
    """The public suffix of a domain; null for an address."""
    suffix = let(F.split(domain, r"\."), lambda labels: _tail(labels, _suffix_length(labels, rules or SUFFIXES)))
    return F.when(~is_ip(domain), suffix)


def registrable(host_: Column, rules: list[str] | None = None) -> Column:
    """The public suffix and one label more; null if there is no such label."""

    def of(labels: Column) -> Column:
        whole = (F.size(labels) > 0) & ~F.exists(labels, lambda x: x == "")
        return let(_suffix_length(labels, rules or SUFFIXES), lambda k: F.when(whole & (F.size(labels) > k), _tail(labels, k + 1)))

    return let(F.split(host_, r"\."), of)


def _domain(h: Column, registered: Column) -> Column:
    return F.when(is_ip(h), h).otherwise(F.coalesce(registered, F.when(h.contains("."), h)))


def domain(url: Column, rules: list[str] | None = None) -> Column:
    """What a URL is judged by: an address whole, else the registrable domain, else a host of two labels or more."""
    return let(host(url), lambda h: _domain(h, registrable(h, rules)))


def _signals(url: Column, authority: Column, h: Column, registered: Column) -> dict[str, Column]:
    query = F.lower(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1))
    depth = F.size(F.filter(F.split(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != ""))
    default = F.when(F.substring(url, 1, 6) == "https:", "443").otherwise("80")
    port = F.regexp_extract(authority, r":0*(\d+)$", 1)
    return {
        "is_ip": is_ip(h),
        "has_userinfo": F.regexp_extract(url, r"^[a-z]+://([^/]*)", 1).contains("@"),
        "is_shortener": F.coalesce(registered.isin(SHORTENERS), F.lit(False)),
        "has_tracking": query.rlike("|".join(TRACKING)),
        "deep_path": depth >= 4,
        "long_query": let(query, lambda q: F.when(q == "?", 0).otherwise(F.length(q)) >= 120) | (F.length(url) >= 200),
        "non_standard_port": (port != "") & (port != default),
        "path_depth": depth.cast("int"),
    }


def signals(url: Column, rules: list[str] | None = None) -> dict[str, Column]:
    """What the structure of a URL tells, one flag each, and its number of path segments."""
    h = host(url)
    return _signals(url, _authority(url), h, registrable(h, rules))


def _detail(url: Column, pos: Column, authority: Column, h: Column, registered: Column) -> Column:
    return F.struct(pos.cast("int").alias("pos"), url.alias("url"), _domain(h, registered).alias("domain"), *(c.alias(n) for n, c in _signals(url, authority, h, registered).items()))


def details(urls: Column, rules: list[str] | None = None) -> Column:
    """``pos`` (from 0), ``url``, ``domain`` and the signals of each URL of an array that has a domain; what several of them need is computed once."""

    def one(url: Column, pos: Column) -> Column:
        return let(_authority(url), lambda a: let(_host(a), lambda h: let(registrable(h, rules), lambda r: _detail(url, pos, a, h, r))))

    return F.filter(F.transform(urls, one), lambda d: d["domain"].isNotNull())


def detail(url: Column, pos: Column, registered: Column) -> Column:
    """The same for one URL whose registrable domain is known."""
    return let(_authority(url), lambda a: let(_host(a), lambda h: _detail(url, pos, a, h, registered)))


FLAGS = ["is_ip", "has_userinfo", "is_shortener", "has_tracking", "deep_path", "long_query", "non_standard_port"]
