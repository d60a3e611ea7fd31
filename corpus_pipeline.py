"""A corpus of documents made ready for training, in five stages.

Each stage works on all rows that the one before kept, written as Parquet and read
again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronarch.llm.bpe import encode
from chronarch.llm.decontamination import contamination
from chronarch.llm.jaccard_join import similar_groups
from chronarch.llm.quality import score_quality
from chronarch.llm.queries import KEY, remainder, table, vocabulary
from chronarch.llm.surrogates import replace_personal_data
from chronarch.llm.tables import text_key, written

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return scored.where("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram similarity (five words, 0.8), the one of least id stays.

    Of rows with one id, or with none, the one whose text has the least key stays; an
    id comes last if it is null.  Documents without words are linked with nothing and
    all stay.
    """
    keyed = docs.withColumn("__key", text_key(F.col("text")))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    groups = similar_groups(docs.where(worded))
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    stays = first.select(F.coalesce("first.doc_id", F.lit(0)).alias("__id"), F.col("first.none").alias("__none"), F.col("first.text_key").alias("__key"))
    named = keyed.where(worded).withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull()})
    kept = named.join(stays, ["__id", "__none", "__key"], "left_semi").dropDuplicates(["__id", "__none", "__key"])
    return kept.select(docs.columns).union(docs.where(~worded))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; n_chars follows the text."""
    out = replace_personal_data(docs, KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and digests of them and of what they decode to."""
    return encode(docs, vocabulary())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
