"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside the groups.

Native DataFrame operations only. Two passes over the texts:

1. `groupBy(hash)` with count, kept id and the smallest and largest normalised text. Both texts
   are equal exactly when every text of the group has the same bytes, so the comparison is part of a
   combining aggregate: a group of any size sends one row per map task, and no text is paired.
2. Each row gets its group's figures by a join on the hash. The groups are cut off by a checkpoint,
   so both sides of the join are plain exchanges and Spark splits a hot hash at run time.

A hash shared by different texts (a collision) is grouped again by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietday.llm.common import ascii_lower, cut, one_of_each, text_or_empty


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hasher=content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. `keep` is "min" or "max": which id of a group
    stays. Null text counts as empty, so null and empty texts form one group. A null id never wins
    against another; a group of null ids only has keep_id null and keeps its rows. Repeated rows
    (same id, same text) count in group_size and are kept or dropped together. A very long text is hashed and compared
    whole; a task holds two of a hash. An empty table gives no rows; other columns are ignored.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(text_or_empty(text_col)).alias("norm"))
    hashed = rows.withColumn("h", hasher(F.col("norm")))
    groups = cut(
        hashed.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), pick("id").alias("keep_id"), F.min("norm").alias("lo"), F.max("norm").alias("hi"))
        .select("h", "n", "keep_id", (F.col("lo") == F.col("hi")).alias("pure"))
    )
    narrow = hashed.select("id", "h", F.sha2("norm", 256).alias("text_sha256"))
    found = narrow.join(groups.where("pure"), "h").select("id", "keep_id", "n", "text_sha256")
    mixed = groups.where(~F.col("pure")).select("h")
    if not mixed.isEmpty():
        again = hashed.join(mixed, "h", "left_semi").withColumn("text_sha256", F.sha2("norm", 256))
        exact = cut(again.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n"), pick("id").alias("keep_id")))
        found = found.unionByName(again.join(exact, ["h", "norm"]).select("id", "keep_id", "n", "text_sha256"))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The input's rows and columns without the rows of which an equal text with a preferred id stays.

    A row is dropped by its id and text, so another text under the same id, or without an id, stays. Repeated
    rows of the preferred id stay together, as do groups without ids; `one_exact_copy` leaves one row. Null and empty
    texts are one group; very long texts are compared whole; an empty table stays empty; nulls in other columns and their names don't matter.
    """
    gone = exact_groups(docs, id_col, text_col, keep).where(~F.col("kept")).select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    same = docs[id_col].eqNullSafe(gone["_gone"]) & (F.sha2(ascii_lower(text_or_empty(docs[text_col])), 256) == gone["_sha"])
    return docs.join(gone, same, "left_anti")


def one_exact_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The input's columns and exactly one row of each group of equal texts: that of the preferred id.

    Rows of one id (or all without one) are told apart by text and the other columns, so repeated rows
    and rows without ids shrink to one as well. Another text under the same id is another group and stays.
    Null and empty texts are one group; very long texts are compared whole, by SHA-256; an empty table stays empty. Columns may have any
    names, also those used inside.
    """
    return one_of_each(docs, [F.sha2(ascii_lower(text_or_empty(text_col)), 256)], id_col, text_col, keep)
