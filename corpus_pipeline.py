"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row goes only if it has no letter, or if no language holds this share of the decoded loss.
LEAST_LANGUAGE_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told; the bit classifiers learn from rows of ``docs`` with a language.

    Null texts and texts without a letter go, empty ones among them; a text goes if its best language holds less than ``LEAST_LANGUAGE_SHARE``; texts of any
    length are read whole; equal texts fare alike, so repeated rows all stay or all go; without any labelled row all rows go; an empty table gives no rows;
    columns of any names are kept."""
    from assertia.llm.common import unused
    from assertia.llm.language_id import UNKNOWN, identify

    names = lang, score, _ = unused(docs, "lang_pred", "lang_score", "lang_unsure")
    return identify(docs, F.lit(True), names=names).where((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SHARE)).drop(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; a text of which nothing is left goes.

    Null and empty texts lose nothing and stay; ``n_chars`` follows the text where lines went; repeated rows and equal texts lose the same lines; of a
    recurring line the document of least id (not null) keeps it; an empty table gives no rows; columns of any names are kept."""
    from assertia.llm.common import unused
    from assertia.llm.line_dedup import dedup_lines

    names = _, dropped = unused(docs, "lines", "dropped")
    found = dedup_lines(docs, names=names).where((F.col(dropped) == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.drop(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, by shingles of five words.

    Null texts and texts without words all stay; of a group, and of repeated rows, the least id's row stays, ties going to the least text hash and then to any
    one of equal rows; a null id counts as the greatest; an empty table gives no rows; columns of any names are kept."""
    from assertia.llm.near_dup import deduplicate

    return deduplicate(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is inside benchmark windows.

    Null texts and texts without words stay; rows are judged by their text, so repeated rows and equal texts fare alike, whatever their ids; without a benchmark
    all rows stay; an empty table gives no rows; columns of any names are kept."""
    from assertia.llm.common import packed, unpacked
    from assertia.llm.decontaminate import contamination

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = packed(docs, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")).alias("k"), F.col("text"))
    found = contamination(keyed.select("k", "text"), benchmark, id_col="k").where("contaminated").select(F.col("k.th").alias("of"), F.col("k.id").alias("id")).distinct()
    same = F.col("k.id").eqNullSafe(F.col("id")) & (F.col("k.th") == F.col("of"))
    return unpacked(keyed.select("row", "k").join(found, same, "left_anti"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight has it, in a global shuffle; ``copy`` and ``place`` (or names close to them, if taken) are added.

    A null source is a source; null and empty texts are copied at their source's rate; rows of one id get one count; a source without characters gives no rows;
    an empty table gives no rows; columns of any names are kept."""
    from assertia.llm.common import unused
    from assertia.llm.mixing import replicate, shuffled

    names = unused(docs, "copy", "place")
    return shuffled(replicate(docs, names=names), names[1])


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Language ID is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    from assertia.llm.common import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
