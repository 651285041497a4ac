"""One query for each operator over its whole table, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from netloom.llm import bpe, chat, htmltext, infill, langid, mixing, negatives, quality, secrets, simhash, sql, tiling, toxicity, warc
from netloom.llm.shared import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def _fold(by: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


@query("op6_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of three folds in four."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(_fold(4) != 2))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), F.col("toxicity.score").alias("score"),
                         (F.col("toxicity.score") >= 0.3).cast("int").alias("predicted"),
                         F.array_join("toxicity.hits", " ").alias("hits"))


@query("op7_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    import public_tokenizers as tok

    return bpe.token_digests(read(spark, sf_dir, "documents"), tok.path(bpe.RANKS), tok.PATTERN)


@query("op8_decontaminate")
def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item's tokens, in any order of its passages."""
    return tiling.leaked_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op9_simhash")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint over three-word shingles and component within three bits of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, most=3, checks=0, repeats=True)
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op1_secrets")
def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the rules' spans, and all spans."""
    return secrets.secret_report(read(spark, sf_dir, "documents"))


@query("op2_warc", sql.WARC)
def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive, normalised, and read back."""
    return warc.round_trip(read(spark, sf_dir, "pages"))


@query("op3_preferences", sql.PREFERENCES)
def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and paired completions of every conversation against its neighbour's last reply."""
    return chat.preference_rows(read(spark, sf_dir, "conversations"))


@query("op4_language")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two folds in three."""
    docs = read(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(_fold(3) != 1))
    found = langid.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op5_quality", sql.QUALITY)
def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.report(read(spark, sf_dir, "documents"))


@query("op10_main_text")
def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = htmltext.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op11_mixing", sql.MIXING)
def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document and how many of them a mix of the sources by weight takes."""
    return mixing.mixture(read(spark, sf_dir, "documents"))


@query("op12_infill", sql.INFILL)
def infills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document's fill-in-middle output and of the text restored from it."""
    return infill.infill_digests(read(spark, sf_dir, "documents"))


@query("op13_hard_negatives", sql.NEGATIVES)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector and each of its positives."""
    return negatives.mined(read(spark, sf_dir, "embeddings"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
