"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandcast.session import ENGINE_CONF, checkpoint_dir, ship_package

WS_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For ``bytes.translate``: A-Z to a-z, every other byte (UTF-8 parts too) unchanged.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def prepare(spark: SparkSession) -> None:
    """Settings and package shipping that every operator relies on.

    Whole texts travel to Python in Arrow batches, so a batch is kept to few
    rows: its size is then bounded by a few hundred texts."""
    for k, v in ENGINE_CONF.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    checkpoint_dir(spark)
    ship_package(spark)


def give_back() -> None:
    """Return the memory that this Python worker has freed to the system: the C library keeps the holes between
    arrays, and a worker waits for its next task with what the largest one left."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass                # another C library


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    read it back: the lineage is cut, several readers share one computation,
    and a lost executor costs no recomputation of what is already written.
    ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ... so that no name an operator adds can clash."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def id_crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null ids count as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def crc_mod(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def broadcast_if_small(table: DataFrame, row_bytes: int, limit_bytes: int = 64 << 20) -> DataFrame:
    """``table`` (already written, so counting is cheap) with a broadcast hint
    if its measured rows times ``row_bytes`` stay below ``limit_bytes``;
    beyond that it is joined by a shuffle, with the same result."""
    return F.broadcast(table) if table.count() * row_bytes <= limit_bytes else table


def most_frequent(counts: DataFrame, n_col: str, limit: int) -> DataFrame:
    """The rows of ``counts`` (already written) with the largest ``n_col``, at
    most ``limit`` of them, by a threshold: an eighth-of-an-octave histogram of the counts
    gives the lowest bucket down to which the rows fit, and a histogram of row
    hashes the part of the next bucket that fills the rest.  No global sort."""
    bucket = F.floor(F.log2(n_col) * 8)
    hist = sorted(((r["b"], r["n"]) for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()),
                  reverse=True)         # at most 512 rows
    total = 0
    for b, n in hist:
        if total + n > limit:
            part = F.pmod(F.xxhash64(*counts.columns), F.lit(1 << 12))
            last = -1
            for r in sorted(counts.filter(bucket == b).groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
                total += r["n"]                 # at most 4,096 rows
                if total > limit:
                    break
                last = r["p"]
            return counts.filter((bucket > b) | ((bucket == b) & (part <= last)))
        total += n
    return counts
