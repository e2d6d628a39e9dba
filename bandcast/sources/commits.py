"""Retry-safe sinks: batches of several tables that become visible together.

A batch writes each of its tables into a folder of its own (``batch=<id>``),
overwriting what an earlier attempt left there, and then commits: one small
JSON file in the log names the batch, the tables' schemas and any facts the next
batch needs.  Readers take committed batches only, so they see all tables of
a batch or none, a replayed batch replaces its own rows, and a batch that is
committed already is not run again.

All folders are addressed through Hadoop's file system, so they can lie in any
store that the cluster shares.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandcast.sources.tables import write_table


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


class BatchLog:
    """The commits of one sink, under ``path`` (one small row per batch)."""

    SCHEMA = "batch long, schemas map<string, string>, facts string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> DataFrame:
        """(batch, schemas, facts) of the committed batches."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(f"{self.path}/commit-*")

    def last(self, before: int | None = None) -> tuple[int, dict] | None:
        """The newest committed batch (below ``before``) and its facts."""
        c = self.commits() if before is None else self.commits().filter(F.col("batch") < before)
        row = c.agg(F.max(F.struct("batch", "facts")).alias("x")).first()["x"]
        return None if row is None else (row["batch"], json.loads(row["facts"]))

    def has(self, batch_id: int) -> bool:
        return exists(self.spark, f"{self.path}/commit-{batch_id}/_SUCCESS")

    def write(self, df: DataFrame, table: str, batch_id: int, partition_by: Sequence[str] | None = None,
              sort_within: Sequence[str] | None = None) -> None:
        """This batch's rows of ``table`` (a folder): replaces those of an earlier attempt; not visible before the commit."""
        write_table(df, f"{table.rstrip('/')}/batch={batch_id}", mode="overwrite", partition_by=partition_by, sort_within=sort_within)

    def commit(self, batch_id: int, tables: Mapping[str, T.StructType], **facts) -> None:
        schemas = {t.rstrip("/"): s.json() for t, s in tables.items()}
        row = self.spark.createDataFrame([(batch_id, schemas, json.dumps(facts))], self.SCHEMA)
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/commit-{batch_id}")

    def read(self, table: str, batch_id: int | None = None) -> DataFrame | None:
        """The rows of committed batches (or of one) with their ``batch``; None before the first commit of the table."""
        table = table.rstrip("/")
        c = self.commits().filter(F.element_at("schemas", F.lit(table)).isNotNull())
        c = c if batch_id is None else c.filter(F.col("batch") == batch_id)
        newest = c.agg(F.max_by(F.element_at("schemas", F.lit(table)), "batch").alias("s")).first()["s"]
        if newest is None:
            return None
        schema = T.StructType.fromJson(json.loads(newest))
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(table)
        if batch_id is not None:
            return rows.filter(F.col("batch") == batch_id)
        return rows.join(F.broadcast(c.select("batch")), "batch", "left_semi")     # a row per batch; prunes folders

    def forget(self, table: str, batch_id: int) -> None:
        """Delete a state table's rows of a batch that later ones have replaced."""
        remove(self.spark, f"{table.rstrip('/')}/batch={batch_id}")
