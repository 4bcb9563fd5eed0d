"""A training-data pipeline over ``documents``: language ID, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir); ``docs`` is what the stage before kept,
written as Parquet and read again.  All stages but the last return the columns
of ``documents``; the last returns the pieces of packed training windows.

Language rules cannot be said in SQL, so ``ORACLE_SQL`` is None; tests hold the
stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.llm import language_id, packing, quality_rules, simhash
from mudline.llm.shared import new_dir


def own_names(docs: DataFrame) -> str:
    """A prefix for a stage's own columns that no column of ``docs`` begins with."""
    prefix = "stage_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models can tell; fitted on a bounded sample of the input's ``lang``.

    Null and empty texts and texts without a letter go; rows without ``lang``
    teach nothing but are judged; without any row to learn from none can be told,
    so all go.  Very long texts are scored whole, repeated rows are judged alike,
    columns pass through whatever their names, and an empty table stays empty.
    """
    own = own_names(docs)
    models = language_id.learn(docs, F.lit(True))
    return language_id.predict(docs, models, prefix=own).filter(~F.col(f"{own}rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition rules.

    Null and empty texts have no words and go.  Very long texts are measured
    whole, repeated rows are judged alike, columns pass through whatever their
    names, and an empty table stays empty.
    """
    own = own_names(docs)
    return quality_rules.annotate(docs, prefix=own).filter(F.col(f"{own}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more on five-word shingles): that with the smallest id.

    Rows are told apart by id and text, so a repeated id loses no text.  Texts
    without a word are one group; rows without id come last in theirs; of rows that
    repeat id and text one stays.  Columns pass through, and an empty table stays
    empty.
    """
    return simhash.deduplicate(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed windows; null and empty texts are a piece of one id, repeated rows have pieces of their own, very long texts several pieces.

    The result has the packing's columns alone, so columns of the documents with
    their names (``start``, ``offset``, ``length``) do not matter.
    """
    return packing.pack(docs)


STAGES = [("language_id", language), ("quality_rules", quality), ("simhash_dedup", near_duplicates), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_dir(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
