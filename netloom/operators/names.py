"""Pronunciation of names as jobs over distinct names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import english, kana
from netloom.functions import phonetics as P
from netloom.functions.text import katakana_to_hiragana
from netloom.operators import common as C

# The whole word table of the service.  Another table (word, ipa) passed by the caller replaces it.
ENGLISH = english.WORDS


def english_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENGLISH.items()), "word string, ipa string")


def romanise(names: DataFrame, reading: str, out: str = "roman") -> DataFrame:
    """Romaji of kana readings: computed once per distinct reading, joined back."""
    distinct = names.select(reading).distinct().withColumn(out, kana.romaji_display_name(F.col(reading)))
    return names.join(distinct, reading, "left")


def pronounce_kana(names: DataFrame, reading: str, out: str = "ipa") -> DataFrame:
    distinct = names.select(reading).distinct().withColumn(
        out, F.nullif(P.kana_to_ipa(F.col(reading)), F.lit("")))
    return names.join(distinct, reading, "left")


def _word_parts(tokens: DataFrame) -> DataFrame:
    """Words with their parts: a word ending in the Japanese suffix splits before it."""
    size = len(P.JAPANESE_SUFFIX)
    norm = P.normalize_token(F.col("token"))
    rows = tokens.withColumn("norm", norm).where("norm <> ''")
    cut = F.char_length("norm") - size
    stem = F.substr("token", F.lit(1), cut)
    splits = F.col("norm").endswith(P.JAPANESE_SUFFIX) & (cut > 0) & (P.normalize_token(stem) != "")
    part = lambda i, t: F.struct(F.lit(i).alias("part"), t.alias("surface"))
    return rows.withColumn("_p", F.explode(F.when(splits, F.array(part(0, stem), part(1, F.lit(P.JAPANESE_SUFFIX))))
                                           .otherwise(F.array(part(0, F.col("token")))))).select(
        *[c for c in tokens.columns if c != "token"], F.col("token"), "_p.part", "_p.surface",
        P.normalize_token(F.col("_p.surface")).alias("norm"))


def resolve_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Sound of each distinct word: dictionary, then digits, then as romanised Japanese."""
    joined = words.join(dictionary.select(F.col("word").alias("norm"), F.col("ipa").alias("_english")), "norm", "left")
    reading = P.romaji_to_katakana(F.col("norm"))
    english = F.coalesce("_english", P.digits_to_ipa(F.col("norm")))
    return joined.withColumn("_kana", F.when(english.isNull(), reading)).select(
        "norm", F.coalesce(english, P.kana_to_ipa(F.col("_kana"))).alias("pronunciation"),
        F.when(english.isNotNull(), "en-US").otherwise("ja-JP").alias("lang"),
        F.when(english.isNull(), katakana_to_hiragana(F.col("_kana"))).alias("_hiragana"))


def tts_segments(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Speech segments of names, in (token_no, part) order.

    ``names(name_k, name_r)``.  A romanised name is spoken word by word; if any word cannot be
    resolved, or there is none, the kana reading is spoken as one segment.
    """
    distinct = names.select("name_k", "name_r").distinct()
    roman = F.nullif(F.trim("name_r"), F.lit(""))
    tokens = distinct.where(roman.isNotNull()).select(
        "name_k", "name_r", F.posexplode(P.name_tokens(F.trim("name_r"))).alias("token_no", "token"))
    last = tokens.groupBy("name_k", "name_r").agg(F.max("token_no").alias("last_no"))
    parts = _word_parts(tokens)
    words = resolve_words(parts.select("norm").distinct(), dictionary)
    spoken = _null_safe(parts.join(words, "norm"), last, ["name_k", "name_r"])
    # Segments of one word: only the last carries the word separator.
    ends = F.when(F.col("token").eqNullSafe(F.col("surface")) | (F.col("part") == 1), True).otherwise(False)
    spoken = spoken.select(
        "name_k", "name_r", "token_no", "part", "surface",
        F.coalesce("_hiragana", "surface").alias("fallback_text"), "pronunciation", "lang",
        F.when(~ends | (F.col("token_no") < F.col("last_no")), " ").otherwise("").alias("separator"))
    complete = spoken.groupBy("name_k", "name_r").agg(
        F.bool_and(F.col("pronunciation").isNotNull()).alias("resolved")).where("resolved").drop("resolved")
    by_word = _null_safe(spoken, complete, ["name_k", "name_r"], "left_semi")
    rest = _null_safe(distinct, complete, ["name_k", "name_r"], "left_anti")
    by_kana = rest.withColumn("pronunciation", F.nullif(P.kana_to_ipa(F.col("name_k")), F.lit(""))).where(
        "pronunciation is not null").select(
        "name_k", "name_r", F.lit(0).alias("token_no"), F.lit(0).alias("part"), F.col("name_k").alias("surface"),
        katakana_to_hiragana(F.col("name_k")).alias("fallback_text"), "pronunciation", F.lit("ja-JP").alias("lang"),
        F.lit("").alias("separator"))
    # English voices flap the Japanese r; these segments are for English voices.
    return by_word.unionByName(by_kana).withColumns({
        "pronunciation": F.replace("pronunciation", F.lit("ɾ"), F.lit("l")), "alphabet": F.lit("Ipa")})


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"_r_{k}")
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def joined_pronunciation(segments: DataFrame) -> DataFrame:
    """Segments of a name as one text; a name has few words, so they fit one array."""
    ordered = F.array_sort(F.collect_list(F.struct("token_no", "part", "pronunciation", "separator")))
    text = F.trim(F.array_join(F.transform(ordered, lambda s: F.concat(s["pronunciation"], s["separator"])), ""))
    return segments.groupBy("name_k", "name_r").agg(F.nullif(text, F.lit("")).alias("name_roman_ipa"))


def pronounce_names(names: DataFrame, dictionary: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """(name_k, name_r, name_ipa, name_roman_ipa) of distinct station or type names; ``segments``: their speech segments, if known."""
    distinct = names.select("name_k", "name_r").distinct().withColumn(
        "name_ipa", F.nullif(P.kana_to_ipa(F.col("name_k")), F.lit("")))
    return _left(distinct, joined_pronunciation(tts_segments(names, dictionary) if segments is None else segments))


def pronounce_lines(names: DataFrame, dictionary: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """As for stations, but the reading's line ending is English and the romanised name has
    no kana to fall back on."""
    distinct = names.select("name_k", "name_r").distinct().withColumn("name_ipa", P.line_name_ipa(F.col("name_k")))
    if segments is None:
        segments = tts_segments(names.select(F.lit("").alias("name_k"), "name_r").distinct(), dictionary)
    spoken = joined_pronunciation(segments).select("name_r", "name_roman_ipa")
    return distinct.join(spoken, "name_r", "left")


def speak(public: DataFrame, dictionary: DataFrame, lines: bool = False) -> DataFrame:
    """Public stations or train types (``lines``: public lines) with name_ipa, name_roman_ipa and name_segments, the
    parts of the romanised name in order: array<struct<token_no, part, surface, pronunciation, separator>>.

    Names are pronounced once each, however many rows share one, and joined back on (name_katakana, name_roman).
    """
    # Names and segments are read by several branches, so each is made once: neither all rows nor the words are gone through again.
    names = C.materialize(public.select(F.col("name_katakana").alias("name_k"), F.col("name_roman").alias("name_r")).distinct(), "names")
    asked = names.select(F.lit("").alias("name_k"), "name_r").distinct() if lines else names
    parts = C.materialize(tts_segments(asked, dictionary), "segments")
    spoken = C.materialize((pronounce_lines if lines else pronounce_names)(names, dictionary, parts), "spoken-names")
    fields = [c for c in ("token_no", "part", "surface", "pronunciation", "separator") if c in parts.columns]
    listed = parts.groupBy("name_k", "name_r").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("name_segments"))
    if lines:
        whole = spoken.join(listed.drop("name_k"), spoken["name_r"].eqNullSafe(listed["name_r"]), "left").drop(listed["name_r"])
    else:
        whole = _left(spoken, listed)
    whole = whole.select(F.col("name_k").alias("_k"), F.col("name_r").alias("_r"), "name_ipa", "name_roman_ipa", "name_segments")
    return public.join(whole, public["name_katakana"].eqNullSafe(F.col("_k")) & public["name_roman"].eqNullSafe(F.col("_r")), "left").drop("_k", "_r")


def _left(left: DataFrame, right: DataFrame) -> DataFrame:
    return _null_safe(left, right, ["name_k", "name_r"], "left")


def audit_pronunciation(names: DataFrame, dictionary: DataFrame, examples: int = 3) -> DataFrame:
    """Every word of romanised names that cannot be spoken, with its count and the first ``examples`` different names
    it occurs in; ranking is the caller's.

    ``names(ord, name_r)``; every occurrence counts.
    """
    trimmed = names.select("ord", F.trim("name_r").alias("name_r")).where("name_r <> ''")
    # The words of a name are sorted and counted inside its row, so nothing is shuffled to count them; a name stands as a digest, taken
    # once a name and not once a word, so long names are not moved with their words.
    keyed = trimmed.select("ord", _name_key(F.col("name_r")).alias("name_key"), F.sort_array(F.filter(
        F.transform(P.name_tokens(F.col("name_r"), camel_case=False), P.normalize_token), lambda t: t != "")).alias("tokens"))
    starts = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1)))
    runs = keyed.where(F.size("tokens") > 0).withColumn("starts", starts)
    counted = F.transform("starts", lambda i, k: F.struct(
        F.get("tokens", i).alias("token"), (F.coalesce(F.get("starts", k + 1), F.size("tokens")) - i).cast("bigint").alias("n")))
    # Read for the words, their counts and their names, so the names are cut into words once.
    words = C.materialize(runs.select("ord", "name_key", F.explode(counted).alias("w")).select("ord", "name_key", "w.*"), "words")
    counts = C.materialize(words.groupBy("token").agg(F.sum("n").alias("count")), "word-counts")
    parts = _word_parts(counts.select("token"))
    sounds = resolve_words(parts.select("norm").distinct(), dictionary)
    silent = (parts.join(sounds, "norm").groupBy("token")
              .agg(F.bool_or(F.col("pronunciation").isNull()).alias("silent")).where("silent").select("token"))
    bad = C.materialize(counts.join(silent, "token", "left_semi"), "silent-words")
    # A name that comes again, with a later ord, is no other name. What is left of a name are rows with one ord, which share a rank.
    again = words.select("name_key", "ord").distinct()
    first = again.groupBy("name_key").agg(F.min("ord").alias("_ord"))
    again = again.join(first, "name_key").where(~F.col("ord").eqNullSafe(F.col("_ord"))).drop("_ord")
    order = Window.partitionBy("token").orderBy(F.col("ord").asc_nulls_last(), "name_key")
    # Pruned to ``examples`` names a word before words are shuffled.
    shown = (_null_safe(words.drop("n"), again, ["name_key", "ord"], "left_anti").withColumn("_rank", F.dense_rank().over(order))
             .where(F.col("_rank") <= examples).drop("_rank").distinct().join(bad, "token"))
    texts = trimmed.groupBy(F.md5(F.col("name_r").cast("binary")).alias("_key")).agg(F.min("name_r").alias("name_r"))
    named = shown.withColumn("_key", F.lower(F.hex("name_key"))).join(texts, "_key")
    return named.groupBy("token", "count").agg(F.array_sort(F.collect_list("name_r")).alias("examples"))


def _name_key(name: Column) -> Column:
    return F.unhex(F.md5(name.cast("binary")))
