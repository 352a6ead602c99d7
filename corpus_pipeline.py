"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame.

``run`` writes each stage's result as Parquet to the shared folder and rereads it for the next stage. All stages
but the last return the columns of ``documents``. Null texts have no letter and go at the first stage. Rows are judged one
by one: those with equal or null ids take part like all others, but that passages of rows with null ids are never taken out.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import bpe, decontaminate, jaccard, langid, suffix
from inkframe.llm.scratch import drop, save, table
from inkframe.session import ship

#: A text goes if less of its letters are in one language.
LEAST_SHARE = 0.5
#: Bytes of a passage that counts as repeated.
PASSAGE = 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that have letters, half of them at least in spans of one language."""
    found = langid.predict(docs, langid.train(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, keeps one row, with the smallest id; null ids go last."""
    rows = save(docs.withColumn("_row", F.monotonically_increasing_id()), "rows-with-numbers")
    found = jaccard.similar(rows.select("_row", "text"), percent=75, n=5, id_col="_row").select("_row", "component_id")
    ids = found.join(rows.select("_row", "doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    first = save(ids.groupBy("component_id").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("component_id", F.col("first._row").alias("stays")), "near-duplicates-first")
    gone = save(found.join(first, "component_id").where("_row <> stays").select("_row"), "near-duplicates")
    return rows.join(gone, "_row", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that stand in a document with a smaller id too; documents of which nothing but white space is left go."""
    out = suffix.dedup(docs, PASSAGE, whole_characters=True, keep=["lang", "source"])
    text = F.col("kept").cast("string")
    out = out.where((F.col("n_removed") == 0) | text.rlike(r"\S"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without an overlap with an item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' ids, and the digest of what they decode to."""
    both = bpe.round_trip(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = docs.select("doc_id", "lang", "source", both("text").alias("found")).select("doc_id", "lang", "source", "found.*")
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _shipped(stage: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _shipped(language)),
    ("ngram_jaccard", _shipped(near_duplicates)),
    ("suffix_dedup", _shipped(repeated_passages)),
    ("decontamination", _shipped(decontaminated)),
    ("byte_bpe", _shipped(tokens)),
]
#: The stages learn, compare hashes and encode, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, save(stage(spark, docs, sf_dir), f"stage-{name}")
        if hasattr(before, "saved_path"):
            drop(before)
    return docs
