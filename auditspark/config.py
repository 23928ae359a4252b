"""Settings: defaults, and what of a stored JSON object is taken over."""

from __future__ import annotations

import json
import math
import sys
from dataclasses import asdict, dataclass, field, replace

MODES = ("normal", "simple", "whitelist")
ACTIONS = ("allow", "ask", "deny")

# List entries that a new installation has.
SEED_WHITELIST = ["wikipedia.org", "github.com"]
SEED_BLOCKLIST = [".xyz", ".top"]

# Default weights of the score.
SCORING = {
    "tld_trust": 10, "pattern": 15, "length_base": 10, "length_extra_chars": 20, "post_cutoff": 50, "cutoff_year": 2023, "age_unavailable": 20, "age_disabled": 20,
    "url_ip": 25, "url_userinfo": 25, "url_shortener": 15, "url_tracking": 5, "url_deep_path": 5, "url_long_query": 3, "url_port": 5,
}


#: No bound: more than any text has.
UNBOUNDED = sys.maxsize


@dataclass(frozen=True)
class Injection:
    """Whole texts are scanned and all payloads decoded unless a bound is set."""

    enabled: bool = True
    scan_max_bytes: int = UNBOUNDED
    fuzzy: bool = False
    fuzzy_threshold: int = 1
    decode_max_bytes: int = UNBOUNDED
    decode_max_candidates: int = UNBOUNDED
    invisible_ratio: float = 0.001


@dataclass(frozen=True)
class Settings:
    enabled: bool = True
    mode: str = "normal"
    blocklist_enabled: dict = field(default_factory=lambda: dict.fromkeys(MODES, True))
    whitelist_normal: bool = True
    age_query: bool = False
    enforcement: str = "deny"
    scoring: dict = field(default_factory=lambda: dict(SCORING))
    injection: Injection = field(default_factory=Injection)


def _number(value, default, low=None, high=None):
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        return default
    return value if low is None else int(min(max(value, low), high))


def sanitise(text: str | None) -> Settings:
    """Settings from stored JSON: what is of the wrong type or out of range falls back to its default, and so does all if the text can't be read."""
    base = Settings()
    try:
        raw = json.loads(text or "")
    except ValueError:
        return base
    if not isinstance(raw, dict):
        return base
    flag = lambda value, default: value if isinstance(value, bool) else default
    part = lambda key: raw[key] if isinstance(raw.get(key), dict) else {}
    weights, own = part("scoring"), part("injection")
    injection = Injection(
        enabled=flag(own.get("enabled"), True),
        fuzzy=flag(own.get("fuzzy"), False),
        fuzzy_threshold=_number(own.get("fuzzy_threshold"), 1, 1, 2),
        scan_max_bytes=_number(own.get("scan_max_bytes"), UNBOUNDED, 4096, UNBOUNDED),
    )
    return replace(
        base,
        enabled=flag(raw.get("enabled"), True),
        mode=raw["mode"] if raw.get("mode") in MODES else base.mode,
        blocklist_enabled={m: flag(part("blocklist_enabled").get(m), True) for m in MODES},
        whitelist_normal=flag(raw.get("whitelist_normal"), True),
        age_query=flag(raw.get("age_query"), False),
        enforcement=raw["enforcement"] if raw.get("enforcement") in ACTIONS else base.enforcement,
        scoring={k: _number(weights.get(k), v) for k, v in SCORING.items()},
        injection=injection,
    )


#: Settings that a flat form has: its name, where the value is kept, and the range of numbers or the choices.
FLAT = {
    "enabled": (("enabled",), bool),
    "mode": (("mode",), MODES),
    "enforcement": (("enforcement",), ACTIONS),
    "whitelist_normal": (("whitelist_normal",), bool),
    "age_query": (("age_query",), bool),
    **{f"blocklist_{m}": (("blocklist_enabled", m), bool) for m in MODES},
    "cutoff_year": (("scoring", "cutoff_year"), (2000, 2100)),
    **{k: (("scoring", k), (0, 100)) for k in ("tld_trust", "pattern", "post_cutoff", "url_ip", "url_shortener", "url_tracking")},
    "injection": (("injection", "enabled"), bool),
    "injection_fuzzy": (("injection", "fuzzy"), bool),
    "injection_fuzzy_threshold": (("injection", "fuzzy_threshold"), (1, 2)),
    "injection_scan_max_bytes": (("injection", "scan_max_bytes"), (4096, UNBOUNDED)),
}


def to_section(settings: Settings) -> dict:
    """The flat form of settings."""
    nested = asdict(settings)
    return {name: nested[at[0]] if len(at) == 1 else nested[at[0]][at[1]] for name, (at, _) in FLAT.items()}


def from_section(section: dict, current: Settings) -> Settings:
    """Settings with the values of a flat form; numbers are brought into their range, and all that the form lacks or has of the wrong type stays as it is."""
    nested = asdict(current)
    for name, (at, kind) in FLAT.items():
        place = nested if len(at) == 1 else nested[at[0]]
        old, new = place[at[-1]], section.get(name)
        if kind is bool:
            place[at[-1]] = new if isinstance(new, bool) else old
        elif isinstance(kind[0], str):
            place[at[-1]] = new if new in kind else old
        else:
            place[at[-1]] = _number(new, old, *kind)
    return Settings(**nested | {"injection": Injection(**nested["injection"])})


def patched(current: Settings, patch: object) -> Settings:
    """Settings after a part of the flat form; ValueError if it holds no field of the right type."""
    fits = lambda kind, v: isinstance(v, bool) if kind is bool else v in kind if isinstance(kind[0], str) else _number(v, None) is not None
    clean = {k: v for k, v in patch.items() if k in FLAT and fits(FLAT[k][1], v)} if isinstance(patch, dict) else {}
    if not clean:
        raise ValueError("no known setting in the patch")
    return from_section(to_section(current) | clean, current)
