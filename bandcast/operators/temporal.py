"""Time-series operators: W1-W4, W7, A3, J3, J13.

Skew: every operator here has a time-chunked path so that one key holding a
large share of all rows is split across tasks by time instead of being
processed by a single task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandcast.functions.scalars import flag, minutes_between, time_bucket
from bandcast.operators.names import fresh

TICK = 300
# A key with more rows than this is processed on the time-chunked path.
HOT_KEY_ROWS = 5_000_000
DAY = 86400


def hot_key_rows(df: DataFrame, key: str) -> int:
    """Rows of the largest key (pruned scan + partial aggregate; one row back)."""
    v = df.select(key).groupBy(key).count().agg(F.max("count")).first()[0]
    return int(v or 0)


def chunk_of(ts: str, chunk_seconds: int = DAY) -> Column:
    """Time chunk of a row; rows without a time come first, in a chunk of their own."""
    return F.coalesce(F.floor(F.col(ts) / F.lit(chunk_seconds)).cast("bigint"), F.lit(-(1 << 62)))


# W1-W4 ---------------------------------------------------------------------
def _offset_cols(ts: str, col: str, lags: Mapping[str, int], leads: Mapping[str, int],
                 w, strict_step: int | None):
    out = {}
    for name, n in lags.items():
        v = F.lag(col, n).over(w)
        if strict_step:
            v = F.when(F.col(ts) - F.lag(ts, n).over(w) == F.lit(n * strict_step), v)
        out[name] = v
    for name, n in leads.items():
        v = F.lead(col, n).over(w)
        if strict_step:
            v = F.when(F.lead(ts, n).over(w) - F.col(ts) == F.lit(n * strict_step), v)
        out[name] = v
    return out


def lag_lead(df: DataFrame, key: str, ts: str, col: str,
             lags: Mapping[str, int] | None = None, leads: Mapping[str, int] | None = None,
             strict_step: int | None = None, chunk_seconds: int | str | None = None,
             hot_rows: int = HOT_KEY_ROWS, keep_chunk: str | None = None, null_keys: bool = True,
             chunk_col: str | None = None) -> DataFrame:
    """Row-offset LAG/LEAD per key ordered by time (W1, W2, one shared window W3).

    Offsets are rows, not time: an overnight gap is bridged.  With
    ``strict_step`` (W4) a value is kept only when the offset row is exactly
    ``n * strict_step`` seconds away.

    ``chunk_seconds`` splits each key's series into time chunks so a hot key
    is spread over many tasks.  Offsets are first computed inside each chunk.
    The first and last ``k`` rows of every chunk (k = largest offset) hold every row that an offset
    across an edge can reach: one per-key window over them alone gives
    each chunk its halo, the ``k`` rows before and after it, which joins
    back on (key, chunk).  Exact; the rows are shuffled once, by (key, chunk),
    and stay so partitioned for what follows (``keep_chunk`` names the chunk column then).
    ``"auto"`` chunks by day.  Nothing is measured, so ``hot_rows`` no longer matters.

    ``chunk_col`` names a column that holds ``chunk_of(ts, chunk_seconds)`` already: rows of a table bucketed by
    (key, chunk) are not shuffled at all then, only the halo's rows are.

    Rows without a key form a series of their own, as in a window; ``null_keys=False`` says there are none.
    """
    lags, leads = dict(lags or {}), dict(leads or {})
    chunk_seconds = DAY if chunk_seconds == "auto" else chunk_seconds
    if not chunk_seconds:
        w = Window.partitionBy(key).orderBy(ts)
        return df.withColumns(_offset_cols(ts, col, lags, leads, w, strict_step))
    if null_keys:
        none = lag_lead(df.filter(F.col(key).isNull()), key, ts, col, lags, leads, strict_step)
        some = lag_lead(df.filter(F.col(key).isNotNull()), key, ts, col, lags, leads, strict_step, chunk_seconds,
                        keep_chunk=keep_chunk, null_keys=False, chunk_col=chunk_col)
        if keep_chunk:
            none = none.withColumn(keep_chunk, chunk_of(ts, chunk_seconds))
        return some.unionByName(none)

    k = max([*lags.values(), *leads.values(), 1])
    chunk, halo, before, after = fresh(df, keep_chunk or "_chunk", "_halo", "_before", "_after")
    chunk = chunk_col or chunk
    x = df if chunk_col else df.withColumn(chunk, chunk_of(ts, chunk_seconds))
    w = Window.partitionBy(key, chunk).orderBy(ts)
    there = lambda f: sum((F.when(f(F.lit(1), n).over(w).isNotNull(), 1).otherwise(0) for n in range(1, k + 1)), F.lit(0))
    x = x.withColumns({before: there(F.lag), after: there(F.lead)})           # rows beside it in the chunk, k at most
    row = F.struct(F.col(ts).alias("t"), F.col(col).alias("v"))
    wb = Window.partitionBy(key).orderBy(chunk, ts)
    edge = x.filter((F.col(before) < k) | (F.col(after) < k)).select(key, ts, col, chunk, before, after)
    edge = edge.withColumns({f"p{n}": F.lag(row, n).over(wb) for n in range(1, k + 1)} | {f"n{n}": F.lead(row, n).over(wb) for n in range(1, k + 1)})
    beside = edge.groupBy(F.col(key).alias("_hk"), F.col(chunk).alias("_hc")).agg(F.struct(
        *[F.max(F.when(F.col(before) == 0, F.col(f"p{n}"))).alias(f"p{n}") for n in range(1, k + 1)],
        *[F.max(F.when(F.col(after) == 0, F.col(f"n{n}"))).alias(f"n{n}") for n in range(1, k + 1)]).alias(halo))
    out = {}
    for names, offset, side, count, sign in ((lags, F.lag, "p", before, -1), (leads, F.lead, "n", after, 1)):
        for name, n in names.items():
            v, t = offset(col, n).over(w), offset(ts, n).over(w)
            for have in range(n):               # ``have`` rows of the chunk on that side, the others of the halo
                beyond = F.col(halo)[f"{side}{n - have}"]
                v, t = F.when(F.col(count) == have, beyond["v"]).otherwise(v), F.when(F.col(count) == have, beyond["t"]).otherwise(t)
            out[name] = F.when((t - F.col(ts)) * sign == F.lit(n * strict_step), v) if strict_step else v
    x = x.join(beside, (F.col(key) == F.col("_hk")) & (F.col(chunk) == F.col("_hc")), "left").drop("_hk", "_hc")
    x = x.withColumns(out).drop(halo, before, after)
    return x if keep_chunk or chunk_col else x.drop(chunk)


def lag_features(df: DataFrame, key: str = "link_id", ts: str = "snapshot_ts", col: str = "speed_band",
                 lags: Sequence[int] = (1, 2, 3), names: Sequence[str] = ("sb_tm5", "sb_tm10", "sb_tm15"),
                 strict_step: int | None = None, chunk_seconds: int | str | None = "auto") -> DataFrame:
    return lag_lead(df, key, ts, col, dict(zip(names, lags)), None, strict_step, chunk_seconds)


def lead_target(df: DataFrame, key: str = "link_id", ts: str = "snapshot_ts", col: str = "speed_band",
                n: int = 3, name: str = "y_tp15", strict_step: int | None = None,
                chunk_seconds: int | str | None = "auto") -> DataFrame:
    return lag_lead(df, key, ts, col, None, {name: n}, strict_step, chunk_seconds)


# W7 / A3 -------------------------------------------------------------------
def expand_buckets(intervals: DataFrame, start: str = "start_ts", end: str = "end_ts",
                   step: int = TICK, out: str = "snapshot_ts") -> DataFrame:
    """One row per step bucket touched by [start, end], both end buckets
    included; the first bucket is floored below the start.  An interval
    whose end bucket precedes its start bucket yields no rows (an empty
    range, as in the reference)."""
    sb, eb = time_bucket(start, step), time_bucket(end, step)
    return intervals.filter(eb >= sb).withColumn(out, F.explode(F.sequence(sb, eb, F.lit(step).cast("bigint"))))


# The incident categories that get their own flag.
INCIDENT_FLAGS = {
    "nearby_accident": "Accident",
    "nearby_roadwork": "Roadwork",
    "nearby_breakdown": "Vehicle breakdown",
}


def bucket_rollup(buckets: DataFrame, keys: Sequence[str] = ("link_id", "snapshot_ts"),
                  type_col: str = "type", start: str = "start_ts", parity: bool = True) -> DataFrame:
    """A3: overlapping incidents on one (link, bucket) rolled into flags.

    ``mins_since_nearby_start`` uses the most recent start; in parity mode it
    can be in (-5, 0] for the first bucket (floored below the start), else it
    is clipped at 0.  Flag columns already present are reused instead of re-deriving them.
    """
    keys = list(keys)
    aggs = [F.lit(1).alias("incident_nearby")]
    aggs += [F.max(F.col(n) if n in buckets.columns else flag(F.col(type_col) == v)).cast("int").alias(n)
             for n, v in INCIDENT_FLAGS.items()]
    aggs += [F.max(start).alias("_last_start")]
    out = buckets.groupBy(*keys).agg(*aggs)
    mins = minutes_between(F.col(keys[-1]), F.col("_last_start"))
    if not parity:
        mins = F.greatest(mins, F.lit(0.0))
    return out.withColumn("mins_since_nearby_start", mins).drop("_last_start")


STRETCH_BITS = 7        # a stretch: 128 buckets
_ROLLUP_ROWS = 1 << 11  # entries rolled up at a time: 2**18 buckets at most


def _rolled_up(bits: int):
    """Task: rows (key, stretch, start, first and last bucket within the stretch and flags in one number), sorted by key and
    stretch, to rows (key, bucket, latest start, flags).  A task holds a batch and the buckets of one stretch."""
    size = 1 << bits
    names = ["_key", "_bucket", "_latest", "_flags"]

    def emit(keys: pa.Array, at: np.ndarray, latest: np.ndarray, seen: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
        place = np.flatnonzero(seen)
        which = place >> bits
        return pa.RecordBatch.from_arrays([keys.take(pa.array(which)), pa.array((at.take(which) << bits) + (place & (size - 1))),
                                           pa.array(latest.take(place)), pa.array(flags.take(place))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None             # the last key and stretch, which the next batch can go on with
        for b in (x.slice(i, _ROLLUP_ROWS) for x in batches for i in range(0, x.num_rows, _ROLLUP_ROWS)):
            at, start, word = (c.to_numpy() for c in b.columns[1:])
            code = b.column(0).dictionary_encode("encode").indices.to_numpy()
            new = np.append(True, (code[1:] != code[:-1]) | (at[1:] != at[:-1]))
            group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            cells = len(heads) * size
            least = np.iinfo(start.dtype).min if start.dtype.kind == "i" else -np.inf
            latest, seen, flags = np.full(cells, least, start.dtype), np.zeros(cells, bool), np.zeros(cells, np.int32)
            keys, at = b.column(0).take(pa.array(heads)), at.take(heads)
            if held is not None:
                if held[0][0].as_py() == keys[0].as_py() and held[1][0] == at[0]:
                    latest[:size], seen[:size], flags[:size] = held[2:]
                else:
                    yield emit(*held)
            first, n = word & (size - 1), (word >> bits & (size - 1)) - (word & (size - 1)) + 1
            row = np.repeat(np.arange(len(word)), n)
            cell = np.arange(len(row)) + np.repeat(group * size + first - (np.cumsum(n) - n), n)
            seen[cell] = True
            np.maximum.at(latest, cell, start.take(row))
            for k in range(len(INCIDENT_FLAGS)):
                flags[cell[(word >> (2 * bits + k) & 1).astype(bool).take(row)]] |= 1 << k
            done = cells - size
            if done:
                yield emit(keys[:-1], at[:-1], latest[:done], seen[:done], flags[:done])
            held = keys[-1:], at[-1:], latest[done:].copy(), seen[done:].copy(), flags[done:].copy()
        if held is not None:
            yield emit(*held)

    return run


def interval_bucket_rollup(intervals: DataFrame, key: str = "link_id", start: str = "start_ts",
                           end: str = "end_ts", type_col: str = "type", step: int = TICK,
                           parity: bool = True) -> DataFrame:
    """W7 + A3 fused: as :func:`bucket_rollup` of :func:`expand_buckets`, without a row for each interval and bucket.

    An interval is entered once in each stretch (``2**STRETCH_BITS`` buckets) that it touches, with its
    first and last bucket there and its category flags in one number.  Entries are shuffled by (key, stretch),
    and tasks write the buckets of one stretch after the other, so buckets are neither shuffled, sorted nor hashed."""
    bits, inner = STRETCH_BITS, (1 << STRETCH_BITS) - 1
    flags = [flag(F.col(type_col) == v) * F.lit(1 << k) for k, v in enumerate(INCIDENT_FLAGS.values())]
    x = intervals.select(F.col(key).alias("_key"), F.col(start).alias("_start"), F.floor(F.col(start) / F.lit(step)).cast("bigint").alias("_first"),
                         F.floor(F.col(end) / F.lit(step)).cast("bigint").alias("_last"), sum(flags, F.lit(0)).alias("_flags")).filter("_last >= _first")
    low, high = F.shiftright("_first", bits), F.shiftright("_last", bits)
    x = x.withColumn("_at", F.explode(F.sequence(low, high)))
    word = (F.when(F.col("_at") == low, F.col("_first").bitwiseAND(F.lit(inner))).otherwise(0)
            + F.shiftleft(F.when(F.col("_at") == high, F.col("_last").bitwiseAND(F.lit(inner))).otherwise(inner), bits)
            + F.shiftleft(F.col("_flags").cast("bigint"), 2 * bits))
    x = x.select("_key", "_at", "_start", word.alias("_word")).repartition("_key", "_at").sortWithinPartitions("_key", "_at")
    types = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    out = x.mapInArrow(_rolled_up(bits), f"_key {types['_key']}, _bucket bigint, _latest {types['_start']}, _flags int")
    snapshot = F.col("_bucket") * F.lit(step)
    mins = minutes_between(snapshot, F.col("_latest"))
    return out.select(F.col("_key").alias(key), snapshot.alias("snapshot_ts"), F.lit(1).alias("incident_nearby"),
                      *[F.shiftright("_flags", k).bitwiseAND(F.lit(1)).alias(n) for k, n in enumerate(INCIDENT_FLAGS)],
                      (mins if parity else F.greatest(mins, F.lit(0.0))).alias("mins_since_nearby_start"))


# J3 ------------------------------------------------------------------------
def enter_intervals(intervals: DataFrame, bucket_seconds: int = DAY, start: str = "start_ts", end: str = "end_ts",
                    out: str = "_ib") -> DataFrame:
    """One row per time bucket that an interval touches, numbered in ``out``."""
    first = F.floor(F.col(start) / bucket_seconds).cast("bigint")
    last = F.floor(F.col(end) / bucket_seconds).cast("bigint")
    return intervals.withColumn(out, F.explode(F.sequence(first, F.greatest(first, last))))


DYADIC_LEVELS = 16      # blocks of up to 2**16 buckets; longer intervals take several of the largest


def dyadic_cover(first: Column, last: Column, levels: int = DYADIC_LEVELS) -> Column:
    """Buckets ``first`` to ``last`` (inclusive) as an array of disjoint blocks {level, block}.

    Block ``b`` of level ``l`` holds the buckets from ``b * 2**l`` up to ``(b + 1) * 2**l``.  A level below
    the largest gives at most two blocks, one at either end; ``last < first`` gives none, null gives null.
    """
    stop = last + F.lit(1).cast("bigint")
    up = lambda x, n: -F.call_function("shiftright", -x, n)        # noqa: E731 - rounded up; shiftright rounds down
    down = lambda x, n: F.call_function("shiftright", x, n)        # noqa: E731
    block = lambda n, b: F.struct(n.cast("int").alias("level"), b.cast("bigint").alias("block"))
    odd = lambda x: F.pmod(x, F.lit(2).cast("bigint")) == 1        # noqa: E731

    def ends(n: Column) -> Column:
        a, b = up(first, n), down(stop, n)
        return F.array(F.when((a < b) & odd(a), block(n, a)), F.when((a < b) & odd(b), block(n, b - 1)))

    top = F.lit(levels)
    a, b = up(first, top), down(stop, top)
    whole = F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda x: block(top, x)))
    low = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), ends)) if levels else F.array()
    blocks = F.filter(F.concat(low, F.coalesce(whole, F.array())), lambda x: x.isNotNull())
    return F.when(first.isNotNull() & last.isNotNull(), blocks)


def _dyadic_join(points: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str, how: str,
                 bucket_seconds: int) -> DataFrame:
    """J3 by blocks; rows as from the other strategies."""
    at, cell, opened, ikey, blocks, ikey_of, blocks_of = fresh(
        points, *fresh(intervals, "_at", "_cell", "_opened", "_ikey", "_blocks", "_ikey_of", "_blocks_of"))
    bucket_of = lambda c: F.floor(F.col(c) / bucket_seconds).cast("bigint")      # noqa: E731
    p = points.withColumn(at, bucket_of(ts))
    cells = p.select(F.col(key).alias(ikey), F.col(at).alias(cell)).filter(F.col(cell).isNotNull()).distinct()
    cells = cells.withColumn(blocks, F.explode(F.transform(F.sequence(F.lit(0), F.lit(DYADIC_LEVELS)), lambda n: F.struct(
        n.alias("level"), F.call_function("shiftright", F.col(cell), n).alias("block")))))
    iv = intervals.withColumnRenamed(key, ikey_of).withColumn(blocks_of, F.explode(dyadic_cover(bucket_of(start), bucket_of(end))))
    # the planner's sizes do not count exploded rows, so it would broadcast either side however large it grows
    met = cells.join(iv.hint("merge"), (F.col(ikey) == F.col(ikey_of)) & (F.col(blocks)["level"] == F.col(blocks_of)["level"])
                     & (F.col(blocks)["block"] == F.col(blocks_of)["block"]))
    met = met.withColumnRenamed(cell, opened).drop(ikey_of, blocks, blocks_of)
    cond = (p[key] == met[ikey]) & (p[at] == met[opened]) & p[ts].between(met[start], met[end])
    return p.join(met.hint("merge"), cond, how).drop(at, opened, ikey)


def interval_join(points: DataFrame, intervals: DataFrame, key: str = "link_id", ts: str = "snapshot_ts",
                  start: str = "start_ts", end: str = "end_ts", how: str = "left",
                  strategy: str = "merge", bucket_seconds: int = 3600, bucket: str | None = None,
                  entered: str | None = None) -> DataFrame:
    """Key equality and start <= ts <= end (inclusive).

    ``merge``: equi-join on the key with the range as a residual predicate
    (sort-merge join; AQE splits a skewed key on the points side).
    ``bucket``: every interval is exploded into the fixed time buckets it
    overlaps and points are equi-joined on (key, bucket) with the same
    residual.  A point lies in exactly one bucket, so each match is produced
    once and unmatched points survive the left join once: identical results,
    and a hot key is spread over its time buckets.  ``bucket`` names a column of
    the points that is floor(ts / bucket_seconds) already (points partitioned by (key, bucket) stay so); ``entered``
    names a column of the intervals that holds the bucket, one row for each they touch (``enter_intervals``).
    ``dyadic``: for long intervals.  An interval is entered under the few
    blocks of 1, 2, 4, ... buckets that make it up (``dyadic_cover``), the
    distinct buckets that points lie in meet them through their enclosing blocks, and
    points join the intervals of their bucket as above.  An interval takes at
    most 2 rows a level however long it is, and opens only buckets with points in them;
    points are not multiplied.
    ``auto`` is ``merge``: it keeps the points' partitioning for what follows,
    and AQE splits a skewed key.
    """
    if strategy not in ("auto", "merge", "bucket", "dyadic"):
        raise ValueError(f"unknown interval join strategy {strategy!r}")
    if strategy == "dyadic":
        return _dyadic_join(points, intervals, key, ts, start, end, how, bucket_seconds)
    ikey = "_ikey"
    iv = intervals.withColumnRenamed(key, ikey)
    if strategy != "bucket":
        cond = (points[key] == iv[ikey]) & points[ts].between(iv[start], iv[end])
        return points.join(iv, cond, how).drop(ikey)
    b = bucket_seconds
    ivb = iv.withColumnRenamed(entered, "_ib") if entered else enter_intervals(iv, b, start, end, "_ib")
    pb = points if bucket else points.withColumn("_pb", F.floor(F.col(ts) / b).cast("bigint"))
    cond = (pb[key] == ivb[ikey]) & (pb[bucket or "_pb"] == ivb["_ib"]) & pb[ts].between(ivb[start], ivb[end])
    ivb = ivb if entered else ivb.hint("merge")         # exploded here: the planner's size is short
    return pb.join(ivb, cond, how).drop(ikey, "_ib", *([] if bucket else ["_pb"]))


# J13 -----------------------------------------------------------------------
def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
              right_cols: Sequence[str], tolerance: int | None = None,
              chunk_seconds: int | str | None = None, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Backward as-of join: for each left row, the latest right row of the same
    key with right_ts <= left_ts (and left_ts - right_ts <= tolerance).

    Both sides are unioned and ``last(..., ignorenulls)`` runs over one window
    ordered by time, right rows before left rows at equal times: no pairs
    are formed.  The window is partitioned by (key, time chunk) so a hot key
    is split by time, exactly:
    * with a tolerance, chunk >= tolerance and every right row is also
      copied into the next chunk (the match is at most one chunk back);
    * without one (``chunk_seconds`` given), the last right row of each
      (key, chunk) is found by an aggregate, the latest one before each
      chunk is carried forward by a per-key window over that small chunk
      table, and injected at the start of the chunk.
    With neither, one window per key.  ``"auto"`` chunks by day; nothing is measured.

    The window runs over the distinct (key, time) pairs of the left side, not over its rows:
    many rows share a station's tick.  Matches join back on (key, time), which spreads
    any hot key, and where they are few, the left rows are not shuffled at all.
    """
    k, t = fresh(left, "_asof_key", "_asof_time")
    ticks = left.select(F.col(key).alias(k), F.col(left_ts).alias(t)).filter(F.col(k).isNotNull() & F.col(t).isNotNull()).distinct()
    matched = f"{right_ts}_matched"
    found = _asof_ticks(ticks, right.withColumnRenamed(key, k), k, t, right_ts, right_cols, tolerance,
                        DAY if chunk_seconds == "auto" else chunk_seconds).filter(F.col(matched).isNotNull())
    out = left.join(found, (F.col(key) == F.col(k)) & (F.col(left_ts) == F.col(t)), "left")
    return out.select(*[left[c] for c in left.columns], *[found[c] for c in right_cols], found[matched])


def _asof_ticks(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, right_cols: Sequence[str],
                tolerance: int | None, chunk_seconds: int | None) -> DataFrame:
    right_cols = list(right_cols)
    right = right.filter(F.col(key).isNotNull())        # a null key matches nothing
    lcols = left.columns
    rtypes = dict(right.select(right_cols).dtypes)
    l = left.select(*[F.col(c) for c in lcols],
                    F.col(key).alias("_k"), F.col(left_ts).cast("bigint").alias("_t"),
                    F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_rt"),
                    *[F.lit(None).cast(rtypes[c]).alias(f"_r_{c}") for c in right_cols])
    r = right.select(*[F.lit(None).cast(t).alias(c) for c, t in left.dtypes],
                     F.col(key).alias("_k"), F.col(right_ts).cast("bigint").alias("_t"),
                     F.lit(0).alias("_side"), F.col(right_ts).cast("bigint").alias("_rt"),
                     *[F.col(c).alias(f"_r_{c}") for c in right_cols])
    part = ["_k"]
    if tolerance is not None:
        c = max(int(chunk_seconds or tolerance), int(tolerance), 1)
        l = l.withColumn("_chunk", F.floor(F.col("_t") / c))
        r = r.withColumn("_chunk", F.explode(F.array(F.floor(F.col("_t") / c), F.floor(F.col("_t") / c) + 1)))
        part.append("_chunk")
    elif chunk_seconds:
        c = int(chunk_seconds)
        l = l.withColumn("_chunk", F.floor(F.col("_t") / c))
        r = r.withColumn("_chunk", F.floor(F.col("_t") / c))
        vals = F.struct(F.col("_rt"), *[F.col(f"_r_{x}") for x in right_cols])
        last = r.groupBy("_k", "_chunk").agg(F.max_by(vals, F.col("_rt")).alias("_m"))
        chunks = l.select("_k", "_chunk").distinct().join(last, ["_k", "_chunk"], "full")
        wc = Window.partitionBy("_k").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carry = chunks.withColumn("_carry", F.last("_m", ignorenulls=True).over(wc)) \
            .filter(F.col("_carry").isNotNull())
        injected = carry.select(*[F.lit(None).cast(t).alias(x) for x, t in left.dtypes], "_k",
                                F.col("_carry._rt").alias("_t"), F.lit(0).alias("_side"),
                                F.col("_carry._rt").alias("_rt"),
                                *[F.col(f"_carry._r_{x}").alias(f"_r_{x}") for x in right_cols], "_chunk")
        r = r.unionByName(injected)
        part.append("_chunk")
    u = l.unionByName(r)
    w = Window.partitionBy(*part).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_m", F.when(F.col("_rt").isNotNull(), F.struct(
        F.col("_rt"), *[F.col(f"_r_{c}") for c in right_cols])))
    u = u.withColumn("_best", F.last("_m", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    ok = F.col("_best").isNotNull()
    if tolerance is not None:
        ok = ok & (F.col("_t") - F.col("_best._rt") <= F.lit(int(tolerance)))
    return u.select(*[F.col(c) for c in lcols],
                    *[F.when(ok, F.col("_best")[f"_r_{c}"]).alias(c) for c in right_cols],
                    F.when(ok, F.col("_best._rt")).alias(f"{right_ts}_matched"))
