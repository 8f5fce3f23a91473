"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns documents with the same columns; the last
returns the pieces of packed sequences. ORACLE_SQL is None: SQL cannot express the stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import minhash, packing, pii, quality, sentences
from terrane.llm.spaces import read, written

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labelled ones, does not reject.

    Each row is judged by itself: null and empty texts by their metadata and statistics, rows that repeat alike.
    """
    scored = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return _rows(scored).where(F.col(_last(scored)) >= 0.5).drop(_last(scored)).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest id.

    Texts without words, null texts and rows without an id stay; rows that share an id are one document and stay or go together.
    """
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later places of repeated sentence runs go; a document of which no word is left goes too. n_chars follows the text.

    Texts that held no word before, null texts and rows without an id stay as they are.
    """
    cut = sentences.remove_repeats(docs)
    n, text = len(docs.columns), f"c{docs.columns.index('text')}"
    left = _rows(cut).where(F.expr(rf"c{n} = 0 or {text} rlike '[^\\x20\\x09-\\x0D]'"))
    return _with_length(left, docs, F.col(f"c{n}") > 0)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts, plain or disguised, is replaced by its kind; n_chars follows. Null texts stay null, with their n_chars."""
    return _with_length(_rows(pii.redact(docs)), docs, F.lit(True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences; null and empty texts are their end id alone."""
    return packing.contract(docs)


def _rows(df: DataFrame) -> DataFrame:
    """The rows under names that no table can clash with."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def _last(df: DataFrame) -> str:
    return f"c{len(df.columns) - 1}"


def _with_length(rows: DataFrame, docs: DataFrame, where: Column) -> DataFrame:
    """The columns of docs, with n_chars counted anew where a condition holds."""
    text, n = f"c{docs.columns.index('text')}", f"c{docs.columns.index('n_chars')}"
    counted = F.when(where, F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col(n))).otherwise(F.col(n))
    return rows.select(*(counted.alias(n) if f"c{k}" == n else F.col(f"c{k}") for k in range(len(docs.columns)))).toDF(*docs.columns)


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("passages", drop_repeated_passages), ("personal_data", mask_personal_data), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
