"""Sampling, ordering and set operators: R1-R6, O1-O4, U1-U2.

Samples are deterministic functions of the row keys (no ``random()``), so a
re-run or a retried task after executor loss selects the same rows.

Two hashes: ``xxhash64`` for any key types, and a portable integer mix
(Lehmer steps modulo 2^31-1) that plain SQL engines compute bit-for-bit,
used where an oracle must reproduce the sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandcast.operators.names import fresh

# Fixed values of the portable hash (the MINSTD Lehmer generator).
MOD = 2147483647      # 2^31 - 1, prime
MULT = 48271


def portable_hash(keys: Sequence[str], seed: int = 42) -> Column:
    """Uniform-ish value in [0, MOD) from integer keys; exact in 64-bit math."""
    h = F.lit(seed % MOD).cast("bigint")
    for k in keys:
        h = F.pmod(h * 31 + F.pmod(F.col(k).cast("bigint"), F.lit(MOD)), F.lit(MOD))
        h = F.pmod(h * MULT, F.lit(MOD))
        h = F.pmod(h * MULT, F.lit(MOD))
    return h


def portable_hash_sql(keys: Sequence[str], seed: int = 42) -> str:
    """The same hash as DuckDB text (operands are non-negative after ``%``)."""
    h = str(seed % MOD)
    for k in keys:
        h = f"(({h}) * 31 + ((CAST({k} AS BIGINT) % {MOD}) + {MOD}) % {MOD}) % {MOD}"
        h = f"(({h}) * {MULT}) % {MOD}"
        h = f"(({h}) * {MULT}) % {MOD}"
    return h


def unit_hash(keys: Sequence[str], seed: int = 42, portable: bool = True) -> Column:
    """Hash mapped to [0, 1)."""
    if portable:
        return portable_hash(keys, seed) / F.lit(float(MOD))
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1 << 30)) / F.lit(float(1 << 30))


def hash_sample(df: DataFrame, keys: Sequence[str], frac: float, seed: int = 42, portable: bool = True) -> DataFrame:
    """Reproducible Bernoulli sample (fraction ``frac``)."""
    return df.filter(unit_hash(keys, seed, portable) < F.lit(float(frac)))


def keep_or_sample(df: DataFrame, cond: Column, keys: Sequence[str], frac: float, seed: int = 42,
                   portable: bool = True) -> DataFrame:
    """R2: keep every row meeting ``cond``, and a sample of the rest."""
    return df.filter(cond | (unit_hash(keys, seed, portable) < F.lit(float(frac))))


def sample_n(df: DataFrame, n: int, keys: Sequence[str], cond: Column | None = None,
             before_filter: bool = True, seed: int = 42, portable: bool = True) -> DataFrame:
    """Fixed-size sample = the ``n`` rows of smallest hash.

    ``before_filter`` reproduces the engine where the sample is drawn first
    and the condition applied after (fewer than ``n`` rows may remain);
    otherwise the condition applies first and exactly ``min(n, rows)`` remain.
    Rows above the hash bucket in which the ``n``-th smallest lies are
    filtered out first (a histogram of the hashes finds it), so the final
    ordering gets little more than ``n`` rows in all.
    """
    base = df if (before_filter or cond is None) else df.filter(cond)
    h, = fresh(df, "_h")
    x = base.withColumn(h, unit_hash(keys, seed, portable))
    s = _smallest(x, n, None, h).orderBy(h, *keys).limit(n).drop(h)
    return s.filter(cond) if (before_filter and cond is not None) else s


BUCKETS = 1 << 16


def _smallest(x: DataFrame, n: int, class_col: str | None, h: str) -> DataFrame:
    """The rows of ``x`` whose hash (column ``h``) lies at or below the bucket of the
    ``n``-th smallest hash (of their class): one partial aggregate into at most
    ``BUCKETS`` rows per class, no loop, null being a class like any other.
    Columns added on the way have names that ``x`` has not."""
    c, b, cnt, before, last = fresh(x, "_c", "_b", "_n", "_before", "_last")
    bucket = F.floor(F.col(h) * BUCKETS)
    klass = F.lit("all") if class_col is None else F.col(class_col)
    hist = x.groupBy(klass.alias(c), bucket.alias(b)).agg(F.count(F.lit(1)).alias(cnt))
    w = Window.partitionBy(c).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    ends = (hist.withColumn(before, F.coalesce(F.sum(cnt).over(w), F.lit(0))).filter(F.col(before) < n)
            .groupBy(c).agg(F.max(b).alias(last)))
    if class_col is None:           # one number
        row = ends.first()
        return x if row is None else x.filter(bucket <= F.lit(row[last]))
    on = F.col(class_col).eqNullSafe(F.col(c)) & (bucket <= F.col(last))
    return x.join(F.broadcast(ends), on).drop(c, last)   # a row per class


def balanced(df: DataFrame, class_col: str, n: int, keys: Sequence[str], seed: int = 42,
             portable: bool = True) -> DataFrame:
    """Exactly ``min(n, class size)`` rows per class (null is a class):
    the smallest hashes.

    A class may hold most rows, so it is never sorted in one task: only the
    rows up to the hash bucket of the class's ``n``-th smallest hash are ranked.
    The frame may have columns of any name.
    """
    h, rn = fresh(df, "_h", "_rn")
    cand = _smallest(df.withColumn(h, unit_hash(keys, seed, portable)), n, class_col, h)
    w = Window.partitionBy(class_col).orderBy(h, *keys)
    return cand.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n).drop(h, rn)


def chrono_split(df: DataFrame, ts: str = "snapshot_ts", frac: float = 0.8) -> int:
    """Split time ``min + int(frac * (max - min))`` from one aggregate."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    return int(lo + int(frac * (hi - lo)))


def tail_split(df: DataFrame, ts: str = "snapshot_ts", seconds: int = 2 * 86400) -> int:
    """Split time ``max - seconds``."""
    return int(df.agg(F.max(ts)).first()[0] - seconds)


def sort_by(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """O1: global sort (range-partitioned by Spark)."""
    return df.orderBy(*cols)


def top_k(df: DataFrame, col: str, k: int, keys: Sequence[str], min_value: float | None = None) -> DataFrame:
    """O2: k largest by ``col`` (key as the tie-breaker)."""
    x = df if min_value is None else df.filter(F.col(col) >= F.lit(min_value))
    return x.orderBy(F.desc(col), *keys).limit(k)


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """O3: first ``n`` rows under an explicit order (deterministic)."""
    return df.orderBy(*order).limit(n)


def hash_take(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42, portable: bool = True) -> DataFrame:
    """``n`` pseudo-random rows."""
    return sample_n(df, n, keys, seed=seed, portable=portable)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """U1."""
    return a.unionByName(b)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """U2."""
    return a.unionByName(b).distinct()
