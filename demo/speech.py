"""Pronunciation jobs over the driver's texts and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from demo.adapter import driver_table, network, source_sql
from demo.registry import query
from netloom.functions import phonetics as P
from netloom.operators import enrich as E
from netloom.operators import lookup as L
from netloom.operators import names as N

PAIRS = """SELECT DISTINCT translate(substr(c_name, 10), '0123456789', 'カンコッシアキョウー') AS name_k,
  concat(CASE c_mktsegment WHEN 'MACHINERY' THEN 'Kasai-Rinkai Park' WHEN 'HOUSEHOLD' THEN 'Inagekaigan' WHEN 'BUILDING' THEN 'Shin''ōsaka'
    WHEN 'FURNITURE' THEN '???' ELSE 'ShinMinato Xq' END, CASE WHEN c_nationkey % 3 = 0 THEN concat(' ', c_nationkey) ELSE '' END) AS name_r FROM {customer}"""


@query("kana_ipa")
def kana_ipa(spark, sf):
    names = source_sql(spark, sf, PAIRS, "customer")
    return N.pronounce_kana(names.select("name_k"), "name_k")


@query("tts_segments")
def tts_segments(spark, sf):
    return N.tts_segments(source_sql(spark, sf, PAIRS, "customer"), N.english_words(spark))


@query("pronounced_names")
def pronounced_names(spark, sf):
    return N.pronounce_names(source_sql(spark, sf, PAIRS, "customer"), N.english_words(spark))


LINES = """SELECT DISTINCT concat(translate(substr(c_name, 15), '0123456789', 'カミコトシアキワウナ'),
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'ホンセン' WHEN 'HOUSEHOLD' THEN 'シンカンセン' WHEN 'BUILDING' THEN 'シセン' ELSE 'セン' END) AS name_k,
  concat(c_mktsegment, ' Line') AS name_r FROM {customer}"""


@query("pronounced_lines")
def pronounced_lines(spark, sf):
    return N.pronounce_lines(source_sql(spark, sf, LINES, "customer"), N.english_words(spark))


@query("spoken_stations")
def spoken_stations(spark, sf):
    """Public stations of the whole network with readings, spoken forms and the number of spoken parts."""
    net = network(spark, sf)
    wide = L.to_wide(net, L.active(net.stations), L.active_lines(net))
    return N.speak(E.to_public_station(wide), N.english_words(spark)).select(
        "id", "name_katakana", "name_roman", "name_ipa", "name_roman_ipa", F.coalesce(F.size("name_segments"), F.lit(0)).alias("n_segments"))


@query("spoken_lines")
def spoken_lines(spark, sf):
    """Public lines with readings and spoken forms."""
    return N.speak(E.to_public_line(network(spark, sf).lines), N.english_words(spark), lines=True).select(
        "id", "name_katakana", "name_roman", "name_ipa", "name_roman_ipa")


_TOK = "regexp_extract_all({t}, '[A-Za-z0-9''.ĀĪŪĒŌāīūēōÂÎÛÊÔâîûêô]+')"
_NORM = "regexp_replace({t}, '\\.+$', '')"
for _chars, _plain in P.LONG_VOWELS.items():
    _NORM = f"regexp_replace({_NORM}, '[{_chars}]', '{_plain}', 'g')"
_NORM = f"lower({_NORM})"


@query("digit_words", "SELECT c_custkey, " + "".join(["replace("] * 10) + "CAST(c_custkey AS VARCHAR)"
       + "".join(f", '{d}', '{s}')" for d, s in P.DIGITS.items()) + " AS spoken FROM customer", raw=True)
def digit_words(spark, sf):
    return driver_table(spark, sf, "customer").select(
        "c_custkey", P.digits_to_ipa(F.col("c_custkey").cast("string")).alias("spoken"))


@query("name_tokens", f"""
SELECT doc_id, len({_TOK.format(t='text')}) AS tokens, md5(array_to_string(list_transform({_TOK.format(t='text')}, lambda x: {_NORM.format(t='x')}), ' ')) AS digest
FROM documents""", raw=True)
def name_tokens(spark, sf):
    tokens = P.name_tokens(F.col("text"), camel_case=False)
    return driver_table(spark, sf, "documents").select(
        "doc_id", F.size(tokens).alias("tokens"),
        F.md5(F.array_join(F.transform(tokens, P.normalize_token), " ").cast("binary")).alias("digest"))


@query("pronunciation_audit")
def pronunciation_audit(spark, sf):
    docs = driver_table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("name_r"))
    return N.audit_pronunciation(docs, N.english_words(spark)).select("token", "count", F.size("examples").alias("examples"))
