"""Exact deduplication by a heavy-hitter split (native).

Texts that are equal after white space is normalised share a SHA-256 digest.
A digest that a large part of the rows carry would send all of them to one
task, so digests are split by frequency:

1. every scan partition feeds a Misra-Gries-family frequent-items sketch
   (Spark's ``approx_top_k`` functions); the sketches are merged in two
   levels, so no task gathers more than about the square root of them;
2. the sketch's candidates are counted exactly, which verifies the winners
   and gives their smallest id; at most ``tracked // 4`` winners exist, so they
   are broadcast and their rows never shuffle;
3. the remaining digests go through an ordinary shuffle, as one sum per
   digest and task.

The sketch only decides the route of a row, never its result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandcast.llm.common import WS_CLASS, numbered, prepare, text_or_empty, written
from bandcast.operators.joins import broadcast_if_small


def digest(text: str = "text"):
    """SHA-256 (hex) of the text with each white-space run as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(text_or_empty(text), WS_CLASS + "+", " "), 256)


def frequent(digests: DataFrame, tracked: int) -> DataFrame:
    """Candidates for heavy digests: one column ``_digest``, at most ``tracked // 4`` rows."""
    fan = max(1, math.isqrt(digests.select(F.spark_partition_id().alias("_p")).distinct().count()))
    part = (digests.groupBy((F.spark_partition_id() % fan).alias("_p"))
            .agg(F.expr(f"approx_top_k_accumulate(_digest, {tracked})").alias("_s")))
    return (part.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(_s, {tracked})").alias("_s"))
            .select(F.explode(F.expr(f"approx_top_k_estimate(_s, {tracked // 4})")).alias("_x"))
            .select(F.col("_x.item").alias("_digest")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tracked: int = 2048) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep_id`` is the smallest id of the rows with an equal text and
    ``group_size`` their number.  Null text counts as empty.  A null id is
    larger than any other: it is kept only where no row of its group has an
    id.  Rows repeating both id and text are one document: each counts in
    ``group_size`` and all get the same flags.  An empty table gives an empty
    result; other columns are neither read nor returned, so none can clash.
    """
    prepare(docs.sparkSession)
    d, winners = split_digests(docs, id_col, text_col, tracked)
    hot = d.join(F.broadcast(winners), "_digest")
    least = rest_groups(d, winners)
    rest = d.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti").join(least, "_digest")
    return hot.unionByName(rest).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_digest").alias("text_sha256"))


def split_digests(docs: DataFrame, id_col: str, text_col: str, tracked: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: (_id, _digest) of every row, and the verified heavy digests with ``_keep`` and ``_size``."""
    d = written(docs.select(F.col(id_col).alias("_id"), digest(text_col).alias("_digest")), "digests")
    total = d.count()
    winners = (d.join(F.broadcast(frequent(d, tracked)), "_digest")
               .groupBy("_digest").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size"))
               .filter(F.col("_size") * tracked >= total))
    return d, written(winners, "heavy")          # at most tracked // 4 rows


def rest_groups(d: DataFrame, winners: DataFrame) -> DataFrame:
    """``_keep`` and ``_size`` of the other digests, summed before the shuffle: no group is ever held as rows."""
    return (d.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
            .groupBy("_digest").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 2048) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; rows repeating
    both id and text stay or go together (see :func:`exact_groups`).

    Texts are not shuffled: rows of heavy digests are judged where they are by the
    broadcast winners; of the others (id, digest) pairs are shuffled, and
    the pairs to drop come back by a broadcast if their measured size allows it (else by a join)."""
    prepare(docs.sparkSession)
    plain = numbered(docs)
    i, t = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    d, winners = split_digests(plain, i, t, tracked)
    groups = rest_groups(d, winners).filter("_size > 1").select(F.col("_digest").alias("_d"), "_keep")
    gone = written(d.join(groups, F.col("_digest") == F.col("_d")).filter(~F.col("_id").eqNullSafe(F.col("_keep")))
                   .select(F.col("_id").alias("_gone"), F.col("_digest").alias("_text")).distinct(), "copies")
    rows = plain.withColumn("_digest", digest(t)).join(F.broadcast(winners.select("_digest", "_keep", F.lit(True).alias("_heavy"))), "_digest", "left")
    rows = rows.filter(F.col("_heavy").isNull() | F.col(i).eqNullSafe(F.col("_keep"))).drop("_keep", "_heavy")
    rows = rows.join(broadcast_if_small(gone, max_rows=1 << 62),
                     F.col(i).eqNullSafe(F.col("_gone")) & (F.col("_digest") == F.col("_text")), "left_anti").drop("_digest")
    return rows.toDF(*docs.columns)
