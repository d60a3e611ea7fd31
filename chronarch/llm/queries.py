"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronarch.llm.bpe import encode
from chronarch.llm.collocations import collocations
from chronarch.llm.crossparse import identify_language
from chronarch.llm.decontamination import contamination
from chronarch.llm.fill_middle import fill_in_middle, restored
from chronarch.llm.jaccard_join import similar_components
from chronarch.llm.line_rules import line_rules
from chronarch.llm.oracle import ORACLE_SQL
from chronarch.llm.quality import score_quality
from chronarch.llm.sharding import assign_shards
from chronarch.llm.substring_dedup import remove_repeats
from chronarch.llm.surrogates import replace_personal_data
from chronarch.llm.toxicity import score_toxicity
from chronarch.llm.url_filter import judge_pages

#: Rules for pages (fixed values).
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SHARDS = 40
#: The surrogates' key; a deployment sets its own.
KEY = "chronarch-demonstration"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def remainder(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``: what is held out from learning."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op2_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    out = assign_shards(docs, "size", "doc_id", SHARDS, ties=["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op5_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, table(spark, sf_dir, "labels"), remainder(4) != 2, keep_text=False)
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), ids=False)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_rules(docs, clean=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, rate=50, spm=80)
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"), least=100, top=2000)


def op13_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = identify_language(docs, remainder(4) != 2)
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_byte_shards, op3_url_redirects, op4_toxicity_neighbours, op5_quality_attention,
        op6_bpe_transducer, op7_surrogates, op8_decontamination, op9_line_frequency, op10_substring_dedup,
        op11_fill_in_middle, op12_collocations, op13_cross_parsing,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
