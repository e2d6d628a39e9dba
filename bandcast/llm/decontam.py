"""Benchmark decontamination as a prefix-filtered set join (native).

A window is a run of ``size`` consecutive item words (all words of a shorter
item).  Finding a window in a document is a containment join with threshold
one, for which one prefix token is necessary and enough: the shingles (runs
of ``SHINGLE`` words) of each window are ordered by rarity and the rarest is the
window's prefix token.  A shingle's rarity is bounded by the corpus count of
its rarest word, so one counting pass over benchmark words orders them all.

Document shingles join the prefix tokens on their hash.  The token's place
in the window and in the document gives the only possible start, bounded by
the document's length; the item-sized run of document words there is compared
with the window exactly.  Only verified windows leave the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandcast.llm.common import LOWER, UPPER, numbered, prepare, text_or_empty, written
from bandcast.operators.joins import broadcast_if_small as measured_broadcast

_BREAKS = "".join(chr(c) for r in ((0, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)) for c in range(r[0], r[1] + 1))
SHINGLE = 4
WINDOW = 13


def words_of(text: str) -> Column:
    """Every break character becomes a space and A-Z a-z in one go; what stands between spaces is a word."""
    clean = F.translate(text_or_empty(text), UPPER + _BREAKS, LOWER + " " * len(_BREAKS))
    return F.array_remove(F.split(clean, " ", -1), "")


def _shingle(words: Column, at: Column, k) -> Column:
    return F.xxhash64(F.slice(words, at + 1, k))


def _shingles(k: int) -> Column:
    """Hashes of all runs of k words of ``_w``, in order."""
    places = F.when(F.size("_w") >= k, F.sequence(F.lit(0), F.size("_w") - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: _shingle(F.col("_w"), i, k))


def windows_of(benchmark: DataFrame, counts: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, window words, length, shingle length, offset of the rarest shingle)."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_item"),
                             words_of(text_col).alias("_w")).filter(F.size("_w") > 0)
    key = F.xxhash64("_item", "_w")
    places = items.select("_item", key.alias("_key"), F.posexplode("_w").alias("_p", "_word")).distinct()
    items = (places.join(counts, "_word", "left").groupBy("_item", "_key")
             .agg(F.sort_array(F.collect_list(F.struct("_p", "_word", F.coalesce("_n", F.lit(0)).alias("_n")))).alias("_x"))
             .select("_item", F.col("_x._word").alias("_w"), F.col("_x._n").alias("_f")))
    m = F.least(F.size("_w"), F.lit(size))
    runs = items.withColumn("_m", m).select(
        "_item", "_m", "_w", "_f", F.explode(F.sequence(F.lit(0), F.size("_w") - F.col("_m"))).alias("_s"))
    runs = runs.select("_item", "_m", F.least("_m", F.lit(SHINGLE)).alias("_k"),
                       F.slice("_w", F.col("_s") + 1, F.col("_m")).alias("_win"),
                       F.slice("_f", F.col("_s") + 1, F.col("_m")).alias("_f"))
    rarest = F.array_min(F.transform(
        F.sequence(F.lit(0), F.col("_m") - F.col("_k")),
        lambda o: F.struct(F.array_min(F.slice(F.col("_f"), o + 1, F.col("_k"))).alias("n"), o.alias("o"))))["o"]
    return runs.select("_item", "_win", "_m", "_k", rarest.alias("_o"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_hit``, ``n_items``,
    ``items_sha256``, ``contaminated`` (``n_hit`` > 0 and 20 ``n_hit`` >= ``n_words``).

    Words are runs of a-z (after lower-casing A-Z), digits and non-ASCII
    characters.  A document word inside any occurrence of a window is hit.
    Null or empty text has no words and is clean; an item without words has
    no window; a null item id counts as the empty string; repeated items
    count once, repeated rows get the same answer.  Empty tables give empty
    or clean results; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    bench = written(benchmark.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_t")).distinct(), "benchmark")
    vocabulary = written(bench.select(F.explode(words_of("_t")).alias("_word")).distinct(), "benchmark-words")
    counts = (docs.select(F.explode(words_of(text_col)).alias("_word"))
              .join(measured_broadcast(vocabulary, max_rows=1 << 62), "_word", "left_semi")
              .groupBy("_word").agg(F.count("*").alias("_n")))
    runs = written(windows_of(bench, written(counts, "benchmark-counts"), "_item", "_t", size), "windows")
    prefix = written(runs.groupBy("_win").agg(F.first("_m").alias("_m"), F.first("_k").alias("_k"), F.min("_o").alias("_o"))
                     .select("*", F.xxhash64("_win").alias("_wid"),
                             _shingle(F.col("_win"), F.col("_o"), F.col("_k")).alias("_h")), "prefix-tokens")
    lengths = sorted(r[0] for r in prefix.select("_k").distinct().collect())     # at most SHINGLE values
    tokens = measured_broadcast(prefix, max_rows=1 << 62)

    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), words_of(text_col).alias("_w"))
    found = None
    for k in lengths:
        shingles = base.select("_id", "_th", "_w", F.posexplode(_shingles(k)).alias("_p", "_dh"))
        of = tokens.filter(F.col("_k") == k)
        start = F.col("_p") - F.col("_o")
        near = (F.col("_dh") == F.col("_h")) & (start >= 0) & (start + F.col("_m") <= F.size("_w")) \
            & (F.slice("_w", F.greatest(start, F.lit(0)) + 1, F.col("_m")) == F.col("_win"))
        part = shingles.join(of, near).select("_id", "_th", start.alias("_s"), "_m", "_wid")
        found = part if found is None else found.unionByName(part)
    if found is None:        # no item has a word
        found = base.select("_id", "_th", F.lit(0).alias("_s"), F.lit(0).alias("_m"), F.lit(0).cast("bigint").alias("_wid")).limit(0)
    found = written(found, "window-hits")

    spans = found.groupBy("_id", "_th", "_s").agg(F.max("_m").alias("_m"))
    before = Window.partitionBy("_id", "_th").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("_s") + F.col("_m")
    fresh = end - F.greatest(F.col("_s"), F.coalesce(F.max(end).over(before), F.lit(0)))
    hit = spans.select("_id", "_th", F.greatest(fresh, F.lit(0)).alias("_n")).groupBy("_id", "_th") \
        .agg(F.sum("_n").cast("bigint").alias("_hit"))
    owners = runs.select(F.xxhash64("_win").alias("_wid"), "_item").distinct()
    items = (found.select("_id", "_th", "_wid").distinct().join(owners, "_wid").select("_id", "_th", "_item").distinct()
             .groupBy("_id", "_th").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
             .select(F.col("_id").alias("_ii"), F.col("_th").alias("_it"), "_items"))
    marks = hit.join(items, F.col("_id").eqNullSafe(F.col("_ii")) & (F.col("_th") == F.col("_it"))) \
        .select(F.col("_id").alias("_mi"), F.col("_th").alias("_mt"), "_hit", "_items")
    n_hit = F.coalesce("_hit", F.lit(0).cast("bigint"))
    n_words = F.col("_n")
    return (base.select("_id", "_th", F.size("_w").cast("bigint").alias("_n"))
            .join(marks, F.col("_id").eqNullSafe(F.col("_mi")) & (F.col("_th") == F.col("_mt")), "left")
            .select(F.col("_id").alias(id_col), n_words.alias("n_words"), n_hit.alias("n_hit"),
                    F.coalesce(F.size("_items"), F.lit(0)).cast("bigint").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
                    ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"), F.col("_th").alias("text_xxhash64")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The clean rows of ``docs`` with all their columns, whatever their names."""
    plain = numbered(docs)
    i, t = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    bad = written(contamination(plain, benchmark, i, t, **kw).filter("contaminated")
                  .select(F.col(i).alias("_bad_id"), F.col("text_xxhash64").alias("_bad_th")).distinct(), "contaminated")
    small = measured_broadcast(bad, max_rows=1 << 62)
    return plain.join(small, F.col(i).eqNullSafe(F.col("_bad_id")) & (F.xxhash64(F.col(t)) == F.col("_bad_th")),
                      "left_anti").toDF(*docs.columns)
