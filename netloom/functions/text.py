"""Text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _span(first: str, last: str) -> str:
    return "".join(chr(c) for c in range(ord(first), ord(last) + 1))


def _shift(chars: str, by: int) -> str:
    return "".join(chr(ord(c) + by) for c in chars)


_HIRA_SEARCH = _span("ぁ", "ん")
_HIRA_FULL = _span("ぁ", "ゖ")
_KATA_FULL = _span("ァ", "ヶ")
_WIDE_ALNUM = _span("０", "９") + _span("Ａ", "Ｚ") + _span("ａ", "ｚ")
_KANA_TO_KATA = 0x60
_WIDE_TO_ASCII = -0xFEE0


def normalize_for_search(c: Column) -> Column:
    """Hiragana to katakana, full-width digits and letters to half-width."""
    return F.translate(c, _HIRA_SEARCH + _WIDE_ALNUM,
                       _shift(_HIRA_SEARCH, _KANA_TO_KATA) + _shift(_WIDE_ALNUM, _WIDE_TO_ASCII))


def hiragana_to_katakana(c: Column) -> Column:
    return F.translate(c, _HIRA_FULL, _shift(_HIRA_FULL, _KANA_TO_KATA))


def katakana_to_hiragana(c: Column) -> Column:
    return F.translate(c, _KATA_FULL, _shift(_KATA_FULL, -_KANA_TO_KATA))


def hash_prefixed_color(c: Column) -> Column:
    """`RRGGBB` to `#RRGGBB`; blank becomes NULL."""
    v = F.nullif(F.trim(c), F.lit(""))
    return F.when(v.startswith("#"), v).otherwise(F.concat(F.lit("#"), v))


# Vowels with a macron and their plain forms. (fixed values)
MACRONS, PLAIN_VOWELS = "āīūēōĀĪŪĒŌ", "aiueoAIUEO"


def strip_macrons(c: Column) -> Column:
    return F.translate(c, MACRONS, PLAIN_VOWELS)


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters and leave the rest alone."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def gtfs_minutes(c: Column) -> Column:
    """`HH:MM[:SS]` as minutes, hours past 24 allowed; anything else NULL."""
    p = F.split(F.trim(c), ":")
    n = [F.get(p, F.lit(i)).try_cast("double") for i in range(3)]
    return F.when((F.size(p) >= 2) & (F.size(p) <= 3), n[0] * 60.0 + n[1] + F.coalesce(n[2], F.lit(0.0)) / 60.0)


def clock_time(c: Column) -> Column:
    """`HH:MM:SS` as it is, `H:MM` as zero-padded `HH:MM:00`; unreadable is NULL."""
    full = c.rlike(r"^\+?\d+:\+?\d+:\+?\d+$")
    p = F.split(c, ":")
    hour, minute = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    short = c.rlike(r"^\+?\d+:\+?\d+$") & (minute.try_cast("int") < 60)
    pad = lambda v: F.when(F.length(v.cast("string")) < 2, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
    return F.when(full, c).when(short, F.concat(pad(hour.try_cast("int")), F.lit(":"), pad(minute.try_cast("int")), F.lit(":00")))


def match_key(name: Column) -> Column:
    """Station name for comparison: width and case variants folded, spaces, middle dots and
    bracketed notes dropped, a trailing word for station removed."""
    # Compatibility forms of the characters names use: ASCII block, brackets, half-width kana.
    from netloom.functions.kana import fold_width
    s = F.trim(fold_width(F.coalesce(name, F.lit(""))))
    s = F.regexp_replace(s, r"[\s・]", "")
    s = F.regexp_replace(s, r"\(.*?\)", "")
    s = F.translate(s, "ヶノ", "ケの")
    return F.regexp_replace(s, "(停留場|停留所|駅前|駅)$", "")
