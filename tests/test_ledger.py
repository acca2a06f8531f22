"""Budgets of private sources: releases add up over columns, stages and derived tables, and overspending raises."""

import math

import pytest
from pyspark.sql import functions as F

from veiljoin.functions.budget import BudgetError, Ledger
from veiljoin.operators import features, join

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def test_a_basis_and_a_join_add_up_whatever_the_table_is_derived_by(spark, vectors):
    ledger, known = Ledger(5.0), spark.range(500).withColumn("label", F.lit(1.0))
    features.private_pca_power(vectors, "x", 2, 1.0, 2, None, 1, ledger=ledger)
    features.private_pca_laplace(vectors.filter("id > 10"), "x", 2, 0.5, 1, ledger=ledger)
    assert ledger.left(vectors) == ledger.left(vectors.filter("id < 3").withColumnRenamed("x", "y")) == pytest.approx(3.5)
    held = dict(eps_memb=1.0, eps_val=2.0, data_type="Real", sens=[1.0, 1.0])
    narrow = vectors.select("id", F.slice("x", 1, 2).alias("x"))
    join.join_features(known, narrow, "id", "label", "x", 2, ledger=ledger, **held)
    assert ledger.left(vectors) == pytest.approx(0.5)
    with pytest.raises(BudgetError):
        join.join_features(known, narrow.distinct(), "id", "label", "x", 2, ledger=ledger, **held)
    assert ledger.left(vectors) == pytest.approx(0.5)  # a refused release costs nothing
    with pytest.raises(BudgetError):
        features.private_pca_power(vectors, "x", 2, None, 2, None, 1, ledger=ledger)  # without noise
    with pytest.raises(BudgetError):
        features.private_pca_power(features.Moments.of(vectors, "x"), "x", 2, 0.1, 2, None, 1, ledger=ledger)


def test_joined_and_written_tables_keep_their_sources(spark, vectors, tmp_path):
    ledger = Ledger(2.0)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    both = vectors.join(labels, "id")
    ledger.charge(both, "model", 1.5)
    assert ledger.left(vectors) == ledger.left(labels) == 0.5 and ledger.left(spark.read.parquet(f"{SF}/orders.parquet")) == 2.0
    both.select("id", "quality", (F.col("id") % 2).alias("part")).write.partitionBy("part").parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    assert len(ledger.sources(kept)) == 1
    ledger.inherit(kept, both)
    assert ledger.sources(kept) == ledger.sources(both) and ledger.left(kept) == 0.5
    with pytest.raises(BudgetError):
        ledger.charge(kept.filter("part = 1"), "again", 1.0)


def test_columns_share_a_release_and_tables_without_files_are_their_plan(spark):
    known, private = spark.range(20).withColumn("l", F.lit(1.0)), spark.range(10).selectExpr("id", "1.0D AS f", "2.0D AS g")
    ledger = Ledger(2.0)
    join.join_values(known, private, "id", ["f", "g"], eps_memb=0.5, eps_val=1.0, sens=1.0, seed=1, ledger=ledger)
    assert ledger.left(private) == 0.5 and ledger.left(known) == 2.0
    signs = spark.range(10).select("id", F.array(F.lit(1.0), F.lit(-1.0)).alias("x"))
    join.join_signs(known.withColumnRenamed("l", "label"), signs, "id", "label", "x", 2, 1, eps_memb=0.5, eps_val=0.5, ledger=ledger)
    assert ledger.left(signs) == 1.0
    for eps in (-1.0, math.inf):
        with pytest.raises(BudgetError):
            ledger.charge(private, "x", eps)
