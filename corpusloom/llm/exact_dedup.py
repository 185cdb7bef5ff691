"""Exact de-duplication with a heavy-hitter split, in DataFrame functions only.

A third of all rows may carry one text.  A Misra-Gries pass over the digests (``freqItems``) finds every digest that
fills more than ``support`` of the rows, among at most ``1 / support`` candidates whatever the input.  Their true counts
and smallest ids are verified by a pre-aggregated count, and these few winners are broadcast: rows of a frequent digest
are decided where they are read.  All other digests go through an ordinary shuffle, where no group is larger than
``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.session import stage

SUPPORT = 0.001


def normalised(text: Column) -> Column:
    """Every run of ``[\\x20\\x09-\\x0D]`` as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Rows are equal if their normalised texts are; SHA-256 stands for the text.  The smallest id of a group stays.  Null
    and empty texts form one group.  A null id is larger than any other: it stays only in a group of nothing else.  Rows
    that repeat an id and text get the same verdict and all count in ``group_size``.  An empty table gives no rows; other
    columns are not read.
    """
    rows = stage(docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest")), "exact-digests")
    frequent = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    verified = (
        rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = stage(verified, "exact-winners")  # at most 1 / support rows
    hot = rows.join(F.broadcast(winners), "digest")
    group = W.partitionBy("digest")
    cold = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest", "id", F.min("id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size")
    )
    return hot.unionByName(cold).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, whatever these are named.

    Null and empty texts are copies of each other; rows that repeat the id and text that stays all stay; an empty table stays empty.
    """
    gone = exact_groups(docs, id_col, text_col, support).where("not kept").select(
        F.col(id_col).alias("__gone_id"), F.col("text_sha256").alias("__gone_digest")
    )
    same = docs[id_col].eqNullSafe(gone["__gone_id"]) & (F.sha2(normalised(docs[text_col]), 256) == gone["__gone_digest"])
    return docs.join(gone, same, "left_anti")
