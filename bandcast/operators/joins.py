"""Equi-joins J1, J2, J4-J7, J14.

Broadcast is used only behind a size check: ``broadcast_if_small`` measures
the dimension's rows and bytes and hints it only when both are small;
otherwise the join is left to the planner and AQE, which
converts it at runtime if the shuffled side proves small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandcast.functions.scalars import fill_defaults
from bandcast.session import cut_lineage

# Dimension size limits for an explicit broadcast hint.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: 8 for each fixed-width value, the measured length of text and binary, 16 an array element
    (24 and the text for elements that are texts)."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.StringType, T.BinaryType)):
            n = F.octet_length(c) + 16
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            n = F.aggregate(c, F.lit(24), lambda s, x: s + 24 + F.coalesce(F.octet_length(x), F.lit(0)))
        elif isinstance(t, T.ArrayType) and not isinstance(t.elementType, (T.ArrayType, T.MapType, T.StructType)):
            n = 16 * F.size(c) + 24
        elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            n = F.octet_length(F.to_json(c)) * 2 + 24
        else:
            n = F.lit(8)
        total = total + F.coalesce(n, F.lit(8))
    return total


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, persist: bool = False,
                       max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint a broadcast only when the side is measured to be small: at most ``max_rows`` rows and ``max_bytes`` bytes.

    The check is one aggregate over the side, in all its partitions.  ``persist`` is for a derived side
    that the caller expects to be small: it is checkpointed first, so the check and the join do not
    compute it twice and nothing stays cached."""
    if persist:
        df = cut_lineage(df)
    n, size = df.agg(F.count("*"), F.sum(row_bytes(df))).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def enrich(df: DataFrame, dim: DataFrame, key="link_id", how: str = "inner",
           max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """J1 (inner: unmatched facts dropped) / J2 (left: kept with nulls)."""
    return df.join(broadcast_if_small(dim, max_broadcast_rows), key, how)


def join_buckets(df: DataFrame, buckets: DataFrame, keys: Sequence[str] = ("link_id", "snapshot_ts"),
                 defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Left join on (key, bucket), then default fill (COALESCE)."""
    out = df.join(buckets, list(keys), "left")
    return fill_defaults(out, defaults) if defaults else out


# The defaults the trainers fill after the bucket join.
BUCKET_DEFAULTS = {
    "incident_nearby": 0,
    "nearby_accident": 0,
    "nearby_roadwork": 0,
    "nearby_breakdown": 0,
    "mins_since_nearby_start": -1,
}


def join_predictions(df: DataFrame, preds: DataFrame, keys: Sequence[str] = ("link_id", "snapshot_ts")) -> DataFrame:
    """Inner join of features with stored predictions on (key, ts)."""
    return df.join(preds, list(keys), "inner")


def merge_predictions(df: DataFrame, preds: DataFrame, keys: Sequence[str] = ("link_id", "snapshot_ts"),
                      keep: Sequence[str] | None = None, defaults: Mapping[str, object] | None = None,
                      order: Sequence[str] | None = None) -> DataFrame:
    """Left merge of predictions; one prediction per key first (A10, so the
    merge cannot fan out), missing -> defaults ("no change")."""
    from bandcast.operators.aggregates import first_per_key
    keys = list(keys)
    cols = [c for c in (keep or preds.columns) if c in preds.columns and c not in keys]
    p = preds.select(*keys, *cols)
    p = first_per_key(p, keys, list(order or cols[:1] or keys))
    out = df.join(p, keys, "left")
    return fill_defaults(out, defaults) if defaults else out


def join_readings(mapping: DataFrame, readings: DataFrame, key_left: str = "nearest_station_id",
                  key_right: str = "station_id") -> DataFrame:
    """Mapping x readings on the station (one-to-many fan-out)."""
    return mapping.join(readings, mapping[key_left] == readings[key_right], "inner").drop(readings[key_right])


def join_choose(left: DataFrame, right: DataFrame, keys: Sequence[str], from_right: Sequence[str] = (),
                how: str = "inner") -> DataFrame:
    """Join two frames sharing column names, with an explicit side per
    column: names in ``from_right`` come from the right, all others from the
    left (no silent ``g.*, f.*`` shadowing)."""
    keys = list(keys)
    fr = set(from_right)
    lcols = [c for c in left.columns if c not in fr or c in keys]
    rcols = [c for c in right.columns if c not in keys and (c in fr or c not in left.columns)]
    return left.select(*lcols).join(right.select(*keys, *rcols), keys, how)
