"""Exact dedup, in DataFrame functions only: group by a 128-bit content hash, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, small


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def md5_binary(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def text_key(text: Column) -> Column:
    """Tells rows of one id apart: a 64-bit hash of the text as it is, null counting as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = md5_binary,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, text_key.

    Texts are hashed once, into a narrow table; rows are grouped by hash over that. Only texts whose
    hash several rows share are read again and compared by bytes: they are grouped by (hash,
    normalised text), where partial aggregation merges copies before the shuffle, so a text that a
    third of all rows share is one row a task. Those texts are found by a broadcast of their keys up
    to the bound of ``common.small``, beyond it by a join that shuffles texts. Rows find their group
    through narrow rows that Spark may split when one hash is hot. Only hashes that several texts
    share, if there are any, are joined by text as well.

    Null texts count as empty; empty texts are equal to each other. ``keep_id`` is the smallest
    id; a null id is never smallest unless all of a group are null, whose keep_id is null and
    whose rows are all kept. Rows that repeat an id and a text all carry the same verdict. An
    empty table gives an empty result; columns other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    base = rows.withColumn("norm", normalised(F.col("text"))).withColumn("h", content_hash(F.col("norm")))
    members = save(base.select("id", "key", "h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")), "exact-members")
    found = [
        F.min("id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
    ]
    groups = save(members.groupBy("h").agg(*found).filter("group_size > 1"), "exact-groups")
    keys = members.join(small(groups.select("h")), "h", "left_semi").select("key").distinct()
    again = rows.join(small(save(keys, "exact-keys")), "key", "left_semi")
    again = again.withColumn("norm", normalised(F.col("text"))).withColumn("h", content_hash(F.col("norm"))).select("id", "key", "h", "norm")
    texts = again.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("rows")).groupBy("h").agg(F.count(F.lit(1)).alias("texts"))
    clashing = save(texts.filter("texts > 1").select("h"), "exact-clashing")
    out = members.join(small(groups), "h", "left").withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))})
    if not clashing.isEmpty():
        clash = again.join(small(clashing), "h", "left_semi")
        told = clash.groupBy("h", "norm").agg(*found)
        apart = clash.join(told, ["h", "norm"]).select(
            "id", "key", "keep_id", "group_size", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")
        )
        out = out.join(small(clashing), "h", "left_anti").select(*apart.columns).unionByName(apart)
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("key").alias("text_key"),
    )
