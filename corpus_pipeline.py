"""A training-data pipeline over ``documents``: toxicity, exact and near dedup, decontamination, mixing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of documents. ``run`` writes each stage's result to the shared folder
and reads it back as the next one's input. The stages' operators say what they do with nulls, empty
texts, ties, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veiljoin.llm.common import save, small
from veiljoin.llm.decontaminate import decontaminate
from veiljoin.llm.exact_dedup import exact_dedup, text_key
from veiljoin.llm.mixing import mix_sources
from veiljoin.llm.near_dedup import near_classes
from veiljoin.llm.queries import held_out, table
from veiljoin.llm.toxicity import fit_lexicon, reject_toxic


def drop_rows(docs: DataFrame, verdicts: DataFrame, group: str) -> DataFrame:
    """The documents that their verdict keeps, one of each ``group``, a column of ``verdicts``.

    Rows whose id is unique find their verdict by it. Rows that share an id, or have none, find it by id and text, so a
    text goes only by its own verdict; of those that are kept with one id and one group, the least row stays. Rows
    whose group is null all stay. Columns must be of types that sort.
    """
    verdicts = save(verdicts.select("doc_id", "kept", "text_key", group), "pipeline-verdicts")
    again = verdicts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("again_id"))
    again = save(again, "pipeline-again")
    gone = small(save(verdicts.filter("not kept").select("doc_id").distinct(), "pipeline-gone"))
    if again.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    shared = lambda df: df["doc_id"].eqNullSafe(F.col("again_id"))
    alone = docs.join(again, shared(docs), "left_anti").join(gone, "doc_id", "left_anti").select(*docs.columns)
    many = docs.join(again, shared(docs), "left_semi").select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("row_id"), text_key(F.col("text")).alias("row_key")
    )
    told = verdicts.join(again, shared(verdicts), "left_semi").filter("kept").drop("kept").distinct()
    kept = many.join(told, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("text_key")))
    one = kept.filter(F.col(group).isNotNull()).groupBy("row_id", group).agg(F.min("row").alias("row"))
    return alone.unionByName(one.select("row.*")).unionByName(kept.filter(F.col(group).isNull()).select("row.*"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above 0.3 go. The lexicon is fitted on labelled rows that aren't held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return reject_toxic(docs, fit_lexicon(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, one of them if several have it, or if all have none."""
    return drop_rows(docs, exact_dedup(docs), "text_sha256")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id stays; rows without an id stay."""
    return drop_rows(docs, near_classes(docs), "class_key")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at equal weights: documents with their copy number, in shuffled order."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can express neither the learnt lexicon nor weighted sampling; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
