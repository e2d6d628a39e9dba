"""Table sources and sinks."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(d: str, name: str) -> str:
    """``name`` may be a bare table name in ``d``, a file, or a glob."""
    if any(ch in name for ch in "*?/") or name.endswith(".parquet"):
        return name if os.path.isabs(name) or "://" in name else os.path.join(d, name)
    return os.path.join(d, f"{name}.parquet")


def read_table(spark: SparkSession, d: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan of one file or a glob; optional column list.

    Projection and filters written later still reach the scan (Catalyst
    prunes columns and pushes predicates into the parquet reader).
    """
    df = spark.read.parquet(table_path(d, name))
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, codec: str | None = "zstd", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None, sort_within: Sequence[str] | None = None) -> None:
    """S18 parquet sink.  ``codec`` None keeps Spark's default (snappy).

    brotli needs a codec jar that is not always installed; zstd is the
    equivalent small-file choice that ships with Spark.
    """
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode(mode)
    if codec:
        w = w.option("compression", codec)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def fact_rows(df: DataFrame, ts_col: str = "snapshot_time", entity: str | None = None,
              files_per_date: int | None = None) -> DataFrame:
    """Fact rows with their ``snapshot_date``, dealt into ``files_per_date`` files a date if given
    (a shuffle by date and a hash of the entity); without it every task writes its own file for each date it holds."""
    out = df.withColumn("snapshot_date", F.to_date(F.col(ts_col)))
    return out.repartition("snapshot_date", F.pmod(F.xxhash64(entity or ts_col), F.lit(files_per_date))) if files_per_date else out


def append_fact(df: DataFrame, path: str, ts_col: str = "snapshot_time", entity: str | None = None,
                files_per_date: int | None = None, batch_id: int | None = None) -> None:
    """Append-only fact write, partitioned by date, rows clustered by
    (entity, time) inside each file so an (entity, time range) read prunes
    row groups — the access path the reference indexed.  With a ``batch_id`` the rows go
    to the batch's own folder, so a batch written again replaces its rows; without one, every
    call appends.  ``commits.BatchLog`` makes several tables' batches visible together."""
    out, order = fact_rows(df, ts_col, entity, files_per_date), ([entity] if entity else []) + [ts_col]
    if batch_id is None:
        write_table(out, path, mode="append", partition_by=["snapshot_date"], sort_within=order)
    else:
        write_table(out, f"{path.rstrip('/')}/batch={batch_id}", partition_by=["snapshot_date"], sort_within=order)


def write_bucketed(df: DataFrame, name: str, by: Sequence[str], buckets: int, sort: Sequence[str] = (),
                   path: str | None = None, codec: str = "zstd") -> DataFrame:
    """A catalog table bucketed by ``by``, one sorted file a bucket, and its rows.

    Rows are shuffled once here; windows, joins with equally bucketed tables and aggregates whose keys
    contain ``by`` need no exchange afterwards.  ``buckets`` should leave a bucket at some 100 MB to 1 GB.  ``path`` (shared by
    all executors) makes the table external; without it, it lies in the warehouse.  An existing table is replaced.
    """
    w = (df.repartition(buckets, *by).write.format("parquet").mode("overwrite").option("compression", codec)
         .bucketBy(buckets, *by).sortBy(*(sort or by)))
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def compact(df: DataFrame, path: str, casts: Mapping[str, str], files: int | None = None,
            codec: str = "zstd") -> DataFrame:
    """Keep the listed columns, narrow their types, rewrite compressed.

    ``files`` reduces the output file count without a shuffle (coalesce);
    leave it None on large tables so every task writes its own file.
    """
    slim = df.select([F.col(c).cast(t).alias(c) for c, t in casts.items()])
    if files:
        slim = slim.coalesce(files)
    write_table(slim, path, codec=codec)
    return slim.sparkSession.read.parquet(path)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Named view."""
    df.createOrReplaceTempView(name)
    return df


def replace_table(df: DataFrame, name: str) -> DataFrame:
    """Create or replace ``name`` by a query's result; the query may read what it replaces.

    Every version is a folder of its own under the warehouse, and the catalog
    table ``name`` points at the newest: rows are written first, the pointer
    is changed last (one change of the catalog; a table whose columns change, or that was a plain one, is
    created anew), so a failed write changes nothing.  The version before the
    last is kept for readers that have begun; older ones go."""
    spark = df.sparkSession
    parts = name.replace("`", "").split(".")
    quoted = ".".join(f"`{p}`" for p in parts)
    root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{'.'.join(parts)}.versions"
    new = f"{root}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    write_table(df, new)
    there = spark.catalog.tableExists(name)
    same = there and [(f.name, f.dataType) for f in spark.table(name).schema] == [(f.name, f.dataType) for f in spark.read.parquet(new).schema]
    if same and spark.catalog.getTable(name).tableType == "EXTERNAL":
        spark.sql(f"ALTER TABLE {quoted} SET LOCATION '{new}'")
    else:
        if there:
            spark.sql(f"DROP TABLE {quoted}")
        spark.sql(f"CREATE TABLE {quoted} USING parquet LOCATION '{new}'")
    spark.catalog.refreshTable(name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for old in sorted((f.getPath() for f in files.listStatus(path)), key=lambda p: p.getName())[:-2]:
        files.delete(old, True)
    return spark.table(name)
