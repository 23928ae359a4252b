"""Normalisation of text before detection, step by step, as Column expressions (one vectorised helper, for NFKC)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that can't be seen.
INVISIBLE = [
    0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E,
    0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x3164, 0xFEFF, 0xFFA0,
]
# What white space is, and what of it isn't in the regular class.
SPACES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
# Cyrillic and Greek letters that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсхуіјѕԁһɡνρτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijsdhgvptABEZHIKMNOPTYX", strict=True))
# Named references that are decoded, and those that are common in print.
NAMED = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&", "nbsp": " ", "colon": ":", "semi": ";", "num": "#", "dollar": "$", "percnt": "%", "lpar": "(", "rpar": ")",
    "ast": "*", "plus": "+", "equals": "=", "quest": "?", "commat": "@", "excl": "!", "period": ".", "sol": "/", "bsol": "\\", "verbar": "|", "comma": ",", "lsqb": "[",
    "rsqb": "]", "lbrack": "[", "rbrack": "]", "lcub": "{", "rcub": "}", "lowbar": "_", "grave": "`", "tilde": "~", "hat": "^", "middot": "·",
    "aacute": "a", "eacute": "e", "iacute": "i", "oacute": "o", "uacute": "u", "ntilde": "n",
}
TYPOGRAPHIC = "nbsp amp lt gt quot apos middot hellip mdash ndash copy reg trade deg plusmn times divide frac12 laquo raquo sect para bull dagger euro pound yen".split()
ENTITY = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]{1,9});"
REPEAT = r"(.)\1{3,}"


def char_class(points: list[int]) -> str:
    """The class of these code points, neighbours as ranges, which are far cheaper to test than single ones."""
    ordered = sorted(set(points))
    starts = [p for p in ordered if p - 1 not in ordered]
    ends = [p for p in ordered if p + 1 not in ordered]
    return "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), made)[0]


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, char_class(INVISIBLE) + "+", "")


def invisible_count(text: Column) -> Column:
    return F.length(text) - F.length(strip_invisible(text))


def homoglyph_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "".join(HOMOGLYPHS), ""))


def invisible_in_word(text: Column) -> Column:
    return (invisible_count(text) > 0) & text.rlike(rf"[\p{{L}}\p{{N}}]{char_class(INVISIBLE)}[\p{{L}}\p{{N}}]")


def repeat_runs(text: Column) -> Column:
    return F.regexp_count(text, F.lit(REPEAT))


def _decoded(entity: Column) -> Column:
    """The character a reference stands for, or the reference itself if it is none of those that are decoded."""
    body = F.lower(F.substring(entity, 2, 1_000_000))
    body = F.regexp_replace(body, ";$", "")
    hexed = F.conv(F.when(body.startswith("#x") & (F.length(body) <= 10), F.substring(body, 3, 8)), 16, 10).try_cast("long")
    code = F.coalesce(hexed, F.when(body.startswith("#") & ~body.startswith("#x"), F.substring(body, 2, 18)).try_cast("long"))
    named = F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))
    return F.coalesce(F.when(code.between(0x20, 0x7E), F.char(code)), F.try_element_at(named, body), entity)


def decode_entities(text: Column) -> Column:
    """References decoded in one pass; unknown ones stay."""
    between, found = F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    pairs = F.zip_with(between, F.transform(found, _decoded), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(pairs, "")).otherwise(text)


def suspicious_entities(text: Column) -> Column:
    """References that print doesn't need: named ones one by one, numeric ones by runs that hold a letter; a named reference or the end of the text ends a run."""
    found = F.filter(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), lambda e: _decoded(e) != e)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("run"), F.lit(False).alias("letter"))

    def step(state: Column, e: Column) -> Column:
        numeric = e.startswith("&#")
        closed = state["n"] + F.when(state["letter"], state["run"]).otherwise(0)
        odd = F.when(F.lower(F.regexp_replace(e, "[&;]", "")).isin(TYPOGRAPHIC), 0).otherwise(1)
        return F.struct(F.when(numeric, state["n"]).otherwise(closed + odd).alias("n"), F.when(numeric, state["run"] + 1).otherwise(0).alias("run"), (numeric & (state["letter"] | _decoded(e).rlike("[A-Za-z]"))).alias("letter"))

    counted = F.aggregate(found, zero, step, lambda s: s["n"] + F.when(s["letter"], s["run"]).otherwise(0))
    return F.when(text.contains("&"), counted).otherwise(0)


#: Rows of an Arrow batch that are Python objects at a time.
ROWS = 128


def by_slices(made: Callable[[list], list], returns: str, kind: pa.DataType) -> Callable[[Column], Column]:
    """A function of lists of values for columns. A batch stays in Arrow's form, and only a slice of it is Python objects at a time, so that a worker's memory is a batch or two at any size of the table."""

    @F.arrow_udf(returns)
    def run(values: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array(made(values.slice(at, ROWS).to_pylist()), kind) for at in range(0, max(len(values), 1), ROWS)])

    return run


def nfkc(text: Column) -> Column:
    return by_slices(lambda texts: [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts], "string", pa.string())(text)


def half_width(text: Column) -> Column:
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    return F.when(text.rlike(r"[\x{ff01}-\x{ff5e}]"), F.translate(text, wide, "".join(chr(ord(c) - 0xFEE0) for c in wide))).otherwise(text)


def homoglyphs(text: Column) -> Column:
    return F.translate(text, "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))


def collapse_repeats(text: Column) -> Column:
    return F.regexp_replace(text, REPEAT, "$1")


def fold_space(text: Column) -> Column:
    every, other = char_class(SPACES), char_class([p for p in SPACES if p != 0x20])
    return F.trim(F.regexp_replace(text, f" {every}+|{other}{every}*", " "))


def for_decoding(text: Column) -> Column:
    """Steps up to the copy that encoded payloads are looked for in. NFKC also makes full-width characters half as wide (``half_width``)."""
    return nfkc(decode_entities(strip_invisible(text)))


def normalised(decoding: Column) -> Column:
    return fold_space(collapse_repeats(decoding))
