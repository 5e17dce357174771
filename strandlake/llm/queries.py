"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, html_text, language_id, license_scan, mixing, near_dedup, oracle, periodic_runs, pii, quality_model, quality_rules, spelling_variants, suffix_dedup, token_output

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.score(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(html_text.extract(common.table(spark, sf_dir, "pages")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classify(common.table(spark, sf_dir, "documents"), size=2)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove(common.table(spark, sf_dir, "documents")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.find(common.table(spark, sf_dir, "documents")))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The shares of tokens that the mixture is to have, by domain; a domain is a language.
TARGETS = {"de": 0.18, "en": 0.55, "es": 0.12, "fr": 0.15}


def domains(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """The labelled table of domains: documents that the table of labels covers, with the language they are filed under."""
    covered = common.table(spark, sf_dir, "labels").select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(covered, "doc_id", "left_semi")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return mixing.rates(docs, domains(spark, sf_dir, docs), TARGETS)[0]


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(common.table(spark, sf_dir, "documents"), vocabulary())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find(docs, common.table(spark, sf_dir, "benchmark"))
    items = F.transform("matches", lambda m: m["item_id"])
    return found.select("doc_id", (F.size("matches") == 0).alias("kept"), items.alias("item_ids"), F.array_min(F.transform("matches", lambda m: m["distance"])).alias("distance"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(common.table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(common.table(spark, sf_dir, "documents")))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digest(periodic_runs.find(periodic_runs.with_repeats(docs)))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants.runs(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling_variants.variants(spelling_variants.counted(spelling_variants.with_deletions(found)))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_html_text": op2_html_text,
        "op3_near_dedup": op3_near_dedup,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_license_scan": op5_license_scan,
        "op6_mixing": op6_mixing,
        "op7_token_output": op7_token_output,
        "op8_decontamination": op8_decontamination,
        "op9_quality_rules": op9_quality_rules,
        "op10_pii": op10_pii,
        "op11_language_id": op11_language_id,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
