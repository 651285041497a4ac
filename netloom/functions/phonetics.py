"""Phonetic rewriting of kana and romanised words as Column expressions.

Each conversion is a short chain of regular rewrites over the whole string: split by the
longest unit, map units, then resolve nasals, doubled consonants and long vowels by looking
at what follows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions.kana import literal_map

# Kana units and their sounds.
_VOWELS = ["a", "i", "ɯ", "e", "o"]
_ROWS = {
    "アイウエオ": "", "カキクケコ": "k", "サシスセソ": "s", "タチツテト": "t", "ナニヌネノ": "n",
    "ハヒフヘホ": "h", "マミムメモ": "m", "ラリルレロ": "ɾ", "ガギグゲゴ": "g", "ザジズゼゾ": "z",
    "ダヂヅデド": "d", "バビブベボ": "b", "パピプペポ": "p", "ァィゥェォ": "",
}
_SPECIAL = {
    "キ": "kʲi", "シ": "ɕi", "チ": "t͡ɕi", "ツ": "t͡sɯ", "ニ": "ɲi", "ヒ": "çi", "フ": "ɸɯ",
    "ジ": "ʤi", "ヂ": "dʑi", "ヅ": "dzɯ", "ヤ": "ja", "ユ": "jɯ", "ヨ": "jo", "ャ": "ja", "ュ": "jɯ",
    "ョ": "jo", "ワ": "wa", "ヰ": "i", "ヱ": "e", "ヲ": "o",
    "　": " ", " ": " ", "・": " ", "（": " ", "）": " ", "(": " ", ")": " ",
}
_GLIDES = {"キ": "kʲ", "シ": "ɕ", "チ": "t͡ɕ", "ニ": "ɲ", "ヒ": "ç", "ミ": "mʲ", "リ": "ɾʲ", "ギ": "gʲ",
           "ジ": "dʑ", "ビ": "bʲ", "ピ": "pʲ"}
# Nasal before a following sound: what it starts with and the nasal it takes.
_NASALS = [("[bpm]", "m"), ("(ɲ|dʑ|ʤ|ɕ|gʲ|kʲ|j|ç)", "ɲ"), ("[kgŋ]", "ŋ"), ("[ntdszɾ]", "n"), ("", "ɴ")]
# Marks used while rewriting: nasal, doubled consonant, and the resolved nasals.
_NASAL, _DOUBLE = "", ""
_DONE = ""


def _sounds() -> dict[str, str]:
    table = {k: row + v for chars, row in _ROWS.items() for k, v in zip(chars, _VOWELS)}
    table.update(_SPECIAL)
    for kana, onset in _GLIDES.items():
        table.update({kana + small: onset + v for small, v in zip("ャュョ", ["a", "ɯ", "o"])})
    table.update({"ン": _NASAL, "ッ": _DOUBLE, "ー": "ː"})
    return table


SOUNDS = _sounds()
_PAIRS = "|".join(sorted(k for k in SOUNDS if len(k) == 2))


def kana_to_ipa(c: Column) -> Column:
    """IPA of a katakana reading; NULL if it has any other character, blank for blank."""
    units = F.regexp_extract_all(c, F.lit(f"({_PAIRS}|.)"), F.lit(1))
    table = literal_map(SOUNDS)
    known = F.forall(units, lambda u: F.map_contains_key(table, u))
    out = F.array_join(F.transform(units, lambda u: table[u]), "")
    skip = f"[{_NASAL}{_DOUBLE}ː{_DONE}]*"
    for mark, (follows, _) in zip(_DONE, _NASALS):
        out = F.regexp_replace(out, f"{_NASAL}(?={skip}{follows})", mark)
    out = F.regexp_replace(out, f"{_DOUBLE}(?={skip}t͡[ɕs])", "t")
    out = F.regexp_replace(out, f"{_DOUBLE}(?={skip}(dʑ|ʤ))", "d")
    out = F.regexp_replace(out, f"{_DOUBLE}(?={skip}([^aiɯeouəɐ {_NASAL}{_DOUBLE}ː{_DONE}]))", "$1")
    out = F.translate(out, _DOUBLE + _DONE, "" + "".join(n for _, n in _NASALS))
    out = F.replace(out, F.lit(""), F.lit(""))
    out = F.regexp_replace(out, "(?<=[^ː])ː+", "ː")
    out = F.regexp_replace(out, "(?<=[aiɯeou])(?=[aiɯeou])", ".")
    return F.when(known, F.trim(F.regexp_replace(out, r"\s+", " ")))


# Romanised units and kana, by consonant in vowel order (blank: not used).
_ROMAN_ROWS = {
    "k": "カキクケコ", "g": "ガギグゲゴ", "s": "サ スセソ", "z": "ザ ズゼゾ", "t": "タ  テト", "d": "ダ  デド",
    "n": "ナニヌネノ", "h": "ハヒ ヘホ", "b": "バビブベボ", "p": "パピプペポ", "m": "マミムメモ",
    "y": "ヤ ユ ヨ", "r": "ラリルレロ", "": "アイウエオ",
}
_ROMAN_OTHER = {"shi": "シ", "chi": "チ", "tsu": "ツ", "fu": "フ", "ji": "ジ", "wa": "ワ", "wo": "ヲ", "va": "ヴァ",
                "vi": "ヴィ", "vu": "ヴ", "ve": "ヴェ", "vo": "ヴォ", "ltsu": "ッ", "xtsu": "ッ"}
_ROMAN_GLIDES = {"ky": "キ", "gy": "ギ", "sh": "シ", "sy": "シ", "ch": "チ", "ty": "チ", "ny": "ニ", "hy": "ヒ",
                 "my": "ミ", "ry": "リ", "by": "ビ", "py": "ピ", "j": "ジ", "jy": "ジ"}


def _roman_units() -> dict[str, str]:
    table = {row + v: k for row, chars in _ROMAN_ROWS.items() for v, k in zip("aiueo", chars) if k != " "}
    table.update({"ya": "ヤ", "yu": "ユ", "yo": "ヨ"})
    table.pop("yi", None), table.pop("ye", None)
    table.update(_ROMAN_OTHER)
    for onset, kana in _ROMAN_GLIDES.items():
        table.update({onset + v: kana + small for v, small in zip("auo", "ャュョ")})
    return table


ROMAN = _roman_units()
_ROMAN_PATTERN = "|".join(sorted(ROMAN, key=lambda k: (-len(k), k)))


def romaji_to_katakana(c: Column) -> Column:
    """Katakana of a lower-case romanised word; NULL when it is not readable as one."""
    out = F.regexp_replace(c, r"([a-z&&[^aiueon]])(?=\1)", "ッ")
    out = F.regexp_replace(out, "m(?=[bp])", "ン")
    out = F.regexp_replace(out, "n(?![aiueoy])", "ン")
    units = F.regexp_extract_all(out, F.lit(f"({_ROMAN_PATTERN}|.)"), F.lit(1))
    table = literal_map({**ROMAN, "ッ": "ッ", "ン": "ン", "'": ""})
    known = F.forall(units, lambda u: F.map_contains_key(table, u))
    return F.when(known, F.array_join(F.transform(units, lambda u: table[u]), ""))


# Digits, token characters, long vowels of romanised names.
DIGITS = {"0": "zɪɹoʊ", "1": "wʌn", "2": "tuː", "3": "θɹiː", "4": "fɔɹ", "5": "faɪv", "6": "sɪks",
          "7": "sɛvən", "8": "eɪt", "9": "naɪn"}
TOKEN_CHARS = "A-Za-z0-9'.ĀĪŪĒŌāīūēōÂÎÛÊÔâîûêô"
LONG_VOWELS = {"Āā": "aa", "Ââ": "aa", "Īī": "ii", "Îî": "ii", "Ūū": "uu", "Ûû": "uu",
               "Ēē": "ei", "Êê": "ei", "Ōō": "ou", "Ôô": "ou"}
JAPANESE_SUFFIX = "kaigan"
# Line-name endings read in English, longest first; the exception keeps its reading.
LINE_SUFFIXES = [("ホンセン", " meɪn laɪn"), ("シセン", " laɪn"), ("セン", " laɪn")]
LINE_EXCEPTION = "シンカンセン"


def normalize_token(c: Column) -> Column:
    out = F.regexp_replace(c, r"\.+$", "")
    for chars, plain in LONG_VOWELS.items():
        out = F.regexp_replace(out, f"[{chars}]", plain)
    # Most words have nothing to replace.
    return F.lower(F.when(c.rlike(rf"[{''.join(LONG_VOWELS)}]|\.+$"), out).otherwise(c))


def digits_to_ipa(c: Column) -> Column:
    table = literal_map(DIGITS)
    return F.when(c.rlike("^[0-9]+$"), F.array_join(F.transform(F.split(c, ""), lambda d: table[d]), ""))


def name_tokens(c: Column, camel_case: bool = True) -> Column:
    """Words of a romanised name; a capital after a small letter starts a new one."""
    if camel_case:
        c = F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " ")
    return F.regexp_extract_all(c, F.lit(f"([{TOKEN_CHARS}]+)"), F.lit(1))


def line_name_ipa(c: Column) -> Column:
    """IPA of a line's reading with its ending in English."""
    stem, suffix = c, F.lit("")
    for ending, english in reversed(LINE_SUFFIXES):
        here = c.endswith(ending) & (F.char_length(c) > len(ending)) & ~c.endswith(LINE_EXCEPTION)
        stem = F.when(here, F.substr(c, F.lit(1), F.char_length(c) - len(ending))).otherwise(stem)
        suffix = F.when(here, F.lit(english)).otherwise(suffix)
    return F.nullif(F.concat(kana_to_ipa(stem), suffix), F.lit(""))
