"""Kana readings: width folding and romanisation as whole-string rewrite rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Consonant rows of the kana table, the vowels in order.
_ROWS = {
    "": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ",
    "h": "ハヒフヘホ", "m": "マミムメモ", "r": "ラリルレロ", "g": "ガギグゲゴ", "z": "ザジズゼゾ",
    "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ",
}
_IRREGULAR = {
    "シ": "shi", "チ": "chi", "ツ": "tsu", "フ": "fu", "ジ": "ji", "ヂ": "ji", "ヅ": "zu",
    "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa", "ヰ": "wi", "ヱ": "we", "ヲ": "o", "ン": "n", "ヴ": "vu",
    "ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o", "ャ": "ya", "ュ": "yu", "ョ": "yo", "ヮ": "wa",
}
# Kana that combine with small ya, yu and yo, and the consonant they then stand for.
_GLIDES = {
    "キ": "ky", "シ": "sh", "チ": "ch", "ニ": "ny", "ヒ": "hy", "ミ": "my", "リ": "ry", "ギ": "gy",
    "ジ": "j", "ヂ": "j", "ビ": "by", "ピ": "py", "フ": "fy",
}
_OTHER_PAIRS = {
    "シェ": "she", "ジェ": "je", "チェ": "che", "ティ": "ti", "テュ": "tyu", "ディ": "di", "デュ": "dyu",
    "トゥ": "tu", "ドゥ": "du", "ファ": "fa", "フィ": "fi", "フェ": "fe", "フォ": "fo", "ウィ": "wi",
    "ウェ": "we", "ウォ": "wo", "ヴァ": "va", "ヴィ": "vi", "ヴェ": "ve", "ヴォ": "vo", "ヴュ": "vyu",
    "ツァ": "tsa", "ツィ": "tsi", "ツェ": "tse", "ツォ": "tso", "イェ": "ye", "クァ": "kwa", "グァ": "gwa",
}
_SEPARATORS = "・ 　/／"
# Half-width kana in code order (U+FF65..U+FF9D) and their full-width forms.
_HALF = "".join(chr(c) for c in range(0xFF65, 0xFF9E))
_FULL = "・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
_VOICED_FROM, _VOICED_TO = "ウカキクケコサシスセソタチツテトハヒフヘホ", "ヴガギグゲゴザジズゼゾダヂヅデドバビブベボ"
_SEMI_FROM, _SEMI_TO = "ハヒフヘホ", "パピプペポ"
_HIRAGANA = "".join(chr(c) for c in range(0x3041, 0x3097))
_HIRA_TO_KATA = "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))


def _romaji_table() -> dict[str, str]:
    table = {kana: row + vowel for row, chars in _ROWS.items() for kana, vowel in zip(chars, "aiueo")}
    table.update(_IRREGULAR)
    for kana, consonant in _GLIDES.items():
        table.update({kana + small: consonant + vowel for small, vowel in zip("ャュョ", "auo")})
    table.update(_OTHER_PAIRS)
    return table


ROMAJI = _romaji_table()
_PAIRS = sorted(k for k in ROMAJI if len(k) == 2)
_SINGLES = "".join(sorted(k for k in ROMAJI if len(k) == 1))
# Single kana whose syllable ends in o; a following u, o or long mark lengthens it.
_O_KANA = "".join(k for k in ROMAJI if len(k) == 1 and ROMAJI[k].endswith("o"))
_YU_FIRSTS = "".join(sorted({k[0] for k in _PAIRS if k[1] == "ュ"}))
_LONG = dict(zip("aiueo", "āīūēō"))


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def to_fullwidth_katakana(c: Column) -> Column:
    """Hiragana and half-width kana as full-width katakana; a voicing mark merges with the
    half-width kana before it where such a form exists."""
    half = dict(zip(_FULL, _HALF))
    out = c
    for plain, voiced in zip(_VOICED_FROM, _VOICED_TO):
        out = F.replace(out, F.lit(half[plain] + "ﾞ"), F.lit(voiced))
    for plain, semi in zip(_SEMI_FROM, _SEMI_TO):
        out = F.replace(out, F.lit(half[plain] + "ﾟ"), F.lit(semi))
    return F.translate(out, _HALF + _HIRAGANA, _FULL + _HIRA_TO_KATA)


def kana_to_romaji(c: Column) -> Column:
    """Romaji of a kana reading with macrons on long vowels; NULL for unreadable text.

    Works by rewriting the whole string: merge lengthening kana into a long mark, replace
    kana by syllables, then resolve long marks and doubled consonants.
    """
    kana = to_fullwidth_katakana(c)
    readable = kana.rlike(f"^[{_SINGLES}ッー{_SEPARATORS}]+$")
    merged = F.regexp_replace(kana, f"([{_O_KANA}])[ーウオ]+", "$1ー")
    merged = F.regexp_replace(merged, f"([{_YU_FIRSTS}]ュ)[ーウ]+", "$1ー")
    merged = F.regexp_replace(merged, f"[{_SEPARATORS}]", " ")
    tokens = F.regexp_extract_all(merged, F.lit("(" + "|".join(_PAIRS) + "|.)"), F.lit(1))
    table = literal_map({**ROMAJI, "ッ": "ッ", "ー": "ー", " ": " "})
    out = F.array_join(F.transform(tokens, lambda t: table[t]), "")
    for vowel, long in _LONG.items():
        out = F.regexp_replace(out, f"{vowel}(ッ*)ー+", f"{long}$1")
    out = F.regexp_replace(out, "([āīūēō]ッ*)ー+", "$1")
    dangling = out.contains("ー")
    out = F.regexp_replace(out, "ッ+ch", "tch")
    out = F.regexp_replace(out, "ッ+([a-z&&[^aiueo]])", "$1$1")
    out = F.trim(F.regexp_replace(F.replace(out, F.lit("ッ"), F.lit("")), " +", " "))
    return F.when(readable & ~dangling, F.nullif(out, F.lit("")))


def romaji_display_name(c: Column) -> Column:
    """Title-cased romaji for name columns."""
    return F.initcap(kana_to_romaji(c))


# Full-width ASCII block and the ideographic space with their plain forms. (fixed values)
_WIDE_ASCII = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_PLAIN_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def fold_width(c: Column) -> Column:
    """Full-width ASCII to plain, half-width kana to full-width; hiragana stays."""
    half = dict(zip(_FULL, _HALF))
    out = c
    for plain, voiced in zip(_VOICED_FROM + _SEMI_FROM, _VOICED_TO + _SEMI_TO):
        mark = "ﾟ" if voiced in _SEMI_TO else "ﾞ"
        out = F.replace(out, F.lit(half[plain] + mark), F.lit(voiced))
    return F.translate(out, _HALF + _WIDE_ASCII, _FULL + _PLAIN_ASCII)
