"""From documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; between stages the rows are written as Parquet and read again. All but
the last return the columns of ``documents``, whatever their names: a column
that is named as one of an operator's own goes round it.

Defined results, stage by stage. Quality: a null or empty text has no words and
goes; a null language is a group of its own; repeated rows are judged alike.
Language: a text without a letter, or most of whose letters occur in no
labelled text of the language found, goes; without labelled text all go.
Near duplicates: of equal and similar texts the row of the least id stays, a
null id last; a null text is like no other. Personal data: null stays null.
Packing: a null or empty text is its end token. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import best_fit_packing, language_id, near_dedup, pii
from lodestone.llm import quality_rules as rules
from lodestone.llm.arrow_words import keeping
from lodestone.llm.queries import TRUSTED_LOSS, trusted, word_bpe
from lodestone.llm.storage import written

KNOWN_LETTERS = 0.5  # of a text's letters, at least, occur in the labelled text of its language


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the n-gram ratio go."""
    return keeping(docs, rules.ADDED, lambda d: rules.quality_rules(d, trusted(spark, sf_dir), group="lang", loss=TRUSTED_LOSS).where("kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or in none of the learned ones, go; ``lang`` becomes the predicted one."""

    def found(d: DataFrame) -> DataFrame:
        labelled = d.where(language_id.crc_bucket(F.col("doc_id"), 5) != 0)
        out = language_id.identify_language(d, labelled)
        return out.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("known_letters") >= KNOWN_LETTERS)).withColumn("lang", F.col("lang_pred"))

    return keeping(docs, language_id.ADDED, found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; ``n_chars`` follows."""

    def without(d: DataFrame) -> DataFrame:
        out = pii.find_pii(d, redact=True).withColumn("text", F.col("redacted"))
        return out.withColumn("n_chars", F.length("text").cast("long"))

    return keeping(docs, pii.ADDED, without)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 4096 tokens at most."""
    return best_fit_packing.best_fit_packing(docs, word_bpe())


STAGES = [("quality_rules", quality), ("language_id", language), ("near_dedup", near_duplicates), ("personal_data", personal_data), ("best_fit_packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = written(out, name)
    return out
