"""Aggregations.

All are aggregates with partial (map-side) combine, so a hot key is
pre-aggregated on every executor before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def time_bounds(df: DataFrame, ts: str = "snapshot_ts") -> DataFrame:
    """A1: one row (min_ts, max_ts)."""
    return df.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def value_counts(df: DataFrame, col: str, by: str = "count") -> DataFrame:
    """A4: rows per value, ordered by count (desc, ties by value) or by value."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if by == "count":
        return out.orderBy(F.desc("count"), F.asc_nulls_last(col))
    return out.orderBy(F.asc_nulls_last(col))


def rate(df: DataFrame, flag: str, by=None, name: str | None = None) -> DataFrame:
    """A5: rate (mean) and count of a 0/1 flag, optionally per group."""
    name = name or flag
    return df.groupBy(*_cols(by)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(flag)).cast("bigint").alias(f"{name}_count"),
        F.avg(F.col(flag).cast("double")).alias(f"{name}_rate"),
    )


def mean_where(df: DataFrame, col: str, cond: Column, by=None, name: str | None = None) -> DataFrame:
    """Mean of a measure over the rows meeting a condition."""
    return df.groupBy(*_cols(by)).agg(
        F.avg(F.when(cond, F.col(col).cast("double"))).alias(name or f"mean_{col}"))


def collect_groups(df: DataFrame, key: str, col: str) -> DataFrame:
    """Adjacency export key -> sorted array.  Each list is bounded by the
    producer (e.g. neighbours within a radius); joins elsewhere never use it."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(col)).alias(f"{col}s"))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence | None = None) -> DataFrame:
    """Counts of row x col, null rows removed, absent cells 0."""
    base = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    p = base.groupBy(row).pivot(col, list(values) if values is not None else None).count()
    return p.fillna(0)


def fanout_stats(pairs: DataFrame, n_sources: Column | int, label: str = "anchors") -> DataFrame:
    """Total pairs and the average per source, divisor at least 1."""
    n = n_sources if isinstance(n_sources, Column) else F.lit(n_sources)
    return pairs.agg(F.count(F.lit(1)).alias(f"total_{label}")).select(
        f"total_{label}",
        (F.col(f"total_{label}") / F.greatest(n.cast("double"), F.lit(1.0))).alias(f"avg_{label}_per_source"))


_FIXED_WIDTH = {"int", "bigint", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp"}


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], desc: bool = False) -> DataFrame:
    """One row per key, the first (or last) by an explicit order.

    An aggregate, not a window: a hot key is reduced on each map task
    (partial combine) before the shuffle.  With one order column and
    fixed-width values it is one ``min_by`` per column (a HashAggregate);
    otherwise ``min_by(struct(rest), struct(order))``, whose struct buffer
    plans as a sort-based aggregate.  ``order`` must be unique within a key
    (add a tie-breaker column) for the result to be deterministic.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if desc else F.min_by
    types = dict(df.dtypes)
    if len(order) == 1 and all(types[c] in _FIXED_WIDTH for c in rest + list(order)):
        # Fixed-width buffers: plans as a HashAggregate (no sort).  Exact
        # because the single order column is unique within a key.
        o = F.col(order[0])
        return df.groupBy(*keys).agg(*[pick(F.col(c), o).alias(c) for c in rest])
    ordering = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*keys).agg(pick(F.struct(*[F.col(c) for c in rest]), ordering).alias("_row"))
    return agg.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def row_count(df: DataFrame, cond: Column | None = None, name: str = "rows") -> DataFrame:
    """Row count of a table, or of the rows meeting ``cond``."""
    if cond is None:
        return df.agg(F.count(F.lit(1)).alias(name))
    return df.agg(F.sum(F.when(cond, 1).otherwise(0)).cast("bigint").alias(name))


def dense_ids(df: DataFrame, order: Sequence[str], out: str = "seq") -> DataFrame:
    """Dense 1..N numbering in a total ``order`` without a global window.

    ``orderBy`` range-partitions and sorts; ``monotonically_increasing_id``
    then increases within each partition; one row per partition (first id
    and row count) comes back to build offsets, which join back by
    broadcast.  No single task sees all rows.  ``order`` must be total.
    """
    s = df.orderBy(*order).withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
    s = s.persist()
    parts = s.groupBy("_pid").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")).collect()
    rows, offset = [], 0
    for pid, first, n in sorted((r["_pid"], r["_first"], r["_n"]) for r in parts):
        rows.append((pid, first, offset))
        offset += n
    offs = df.sparkSession.createDataFrame(rows, "_pid int, _first long, _off long")
    out_df = s.join(F.broadcast(offs), "_pid")          # one row per partition: bounded by the partition count
    return out_df.withColumn(out, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1) \
        .drop("_pid", "_mid", "_first", "_off")
