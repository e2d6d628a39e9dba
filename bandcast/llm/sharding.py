"""Sharding by Karmarkar-Karp differencing: equal texts stay together, bytes come out even.

A *partial partition* is a tuple of ``shards`` bins with byte sums.  Each
group of equal texts starts as the tuple (bytes, 0, ..., 0).  Differencing
repeatedly takes the two tuples with the largest spread (largest minus
smallest sum) and adds them in opposite order: the fullest bin of one meets
the emptiest of the other.

On the cluster, groups are dealt at random into chunks of about ``CHUNK``;
each chunk is differenced by one task into one tuple, written with the bin
of every group.  The tuples, one per chunk, are chunked and differenced in
the same way until one chunk is left, whose tuple is the result; a group's
shard follows from the bins it passed through.  The spread of a tuple is
tiny except where one group outweighs the rest, so the levels lose nothing
against one long differencing.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandcast.llm.common import prepare, text_or_empty, written

CHUNK = 2048
SLOT_ROWS = 1000


def differencing(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine n tuples (n, k) into one: its sums, and for every bin of every tuple the bin it went to (n, k)."""
    n, k = sums.shape
    # bins are chains of (tuple, bin) entries: head, tail and next links, so that joining two bins costs O(1)
    nxt = np.full(n * k, -1, np.int64).tolist()
    heap = []
    for i, row in enumerate(sums.tolist()):
        bins = sorted((s, i * k + j, i * k + j) for j, s in enumerate(row))      # (sum, head, tail)
        heap.append((bins[0][0] - bins[-1][0], i, bins))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        made = []
        for (sa, ha, ta), (sb, hb, tb) in zip(a, reversed(b)):
            nxt[ta] = hb
            made.append((sa + sb, ha, tb))
        made.sort()
        least = made[0][0]
        # only differences matter for the order in the heap; sums stay exact
        heapq.heappush(heap, (least - made[-1][0], i, made))
    to = np.zeros(n * k, np.int64)
    _, _, last = heap[0]
    for j, (_, head, _) in enumerate(last):
        while head != -1:
            to[head] = j
            head = nxt[head]
    return np.array([s for s, _, _ in last], np.int64), to.reshape(n, k)


def _chunk_task(k: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_key")            # row order must not depend on the shuffle
        sums = np.array(group.column("_sums").to_pylist(), np.int64).reshape(-1, k)
        total, to = differencing(sums)
        return pa.table({"_key": group.column("_key"), "_chunk": group.column("_chunk"),
                         "_to": pa.array(to.astype(np.int32).tolist(), pa.list_(pa.int32())),
                         "_total": pa.array([total.tolist()] * 1 + [None] * (len(to) - 1), pa.list_(pa.int64()))})
    return run


def shard_of_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(_key string, _shard int) from (_key string, _bytes long), one row per group."""
    first = [F.col("_bytes")] + [F.lit(0).cast("bigint")] * (shards - 1)
    level = groups.select("_key", F.array(*first).alias("_sums"))
    n, levels = level.count(), []
    while True:
        chunks = max(1, -(-n // CHUNK))
        dealt = level.select("_key", "_sums", F.pmod(F.xxhash64(F.concat(F.lit(f"{len(levels)}:"), "_key")), F.lit(chunks)).alias("_chunk"))
        made = written(dealt.groupBy("_chunk").applyInArrow(
            _chunk_task(shards), "_key string, _chunk bigint, _to array<int>, _total array<bigint>"), "shard-level")
        levels.append(made)
        level = made.filter("_total is not null").select(F.col("_chunk").cast("string").alias("_key"), F.col("_total").alias("_sums"))
        n = level.count()
        if n <= 1:
            break
    # from the top level down: where every bin of a chunk ends up
    final = None
    for made in reversed(levels):
        if final is None:
            here = made.select("_key", "_to")
        else:
            up = final.select(F.col("_key").alias("_c"), F.col("_to").alias("_up"))
            here = made.join(up, F.col("_chunk").cast("string") == F.col("_c")).select(
                "_key", F.transform("_to", lambda j: F.element_at("_up", j + 1)).alias("_to"))
        final = here
    # a group's bytes are in the first bin of its starting tuple
    return final.select("_key", F.element_at("_to", 1).alias("_shard"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot``, ``grown_shard`` (null).

    Size is the UTF-8 bytes of the text (null: none) plus one.  Equal texts
    share a shard (null counts as empty); the byte sums of the shards are as
    near as differencing gets them, so one group larger than an eighth of all
    bytes fills a shard alone.  Slots number the rows of a shard from 0
    without gaps, by a hash block of the id and then by id (nulls first); repeated rows
    take slots of their own in any order.  An empty table gives an empty
    result; other columns are not read.
    """
    prepare(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = written(docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("bigint").alias("_size"),
                               F.crc32(text.cast("binary")).alias("_crc"), F.sha2(text, 256).alias("_key")), "shard-rows")
    groups = written(rows.groupBy("_key").agg(F.sum("_size").alias("_bytes")), "shard-groups")
    where = written(shard_of_groups(groups, shards), "shard-of-group").withColumnRenamed("_key", "_k")
    blocks = max(1, rows.count() // SLOT_ROWS)
    placed = written(rows.join(where, F.col("_key") == F.col("_k")).select(
        "_id", "_size", "_crc", "_shard", F.pmod(F.xxhash64("_id"), F.lit(blocks)).alias("_block")), "shard-placed")
    # gapless slots: block offsets from counts, then numbers within a block
    counts = placed.groupBy("_shard", "_block").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("_shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_shard").alias("_s"), F.col("_block").alias("_b"),
                            F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_from"))
    within = Window.partitionBy("_shard", "_block").orderBy("_id", "_crc")
    numbered = placed.withColumn("_i", F.row_number().over(within) - 1)
    return numbered.join(offsets, (F.col("_shard") == F.col("_s")) & (F.col("_block") == F.col("_b"))).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").cast("bigint").alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("_shard").cast("int").alias("shard"),
        (F.col("_from") + F.col("_i")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
