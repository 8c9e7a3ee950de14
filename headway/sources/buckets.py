"""Stored tables cut into hash buckets of their key: a merge reads and rewrites the buckets its batch touches, no others.

A merge first writes the new state of the touched buckets beside the table and only then replaces them. Where a job ends
in between, the next merge puts the written buckets in place before it reads anything, so none is lost and a merge that is
repeated gives the same table (the folds of this library give the same row when they are applied twice).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Choose so that a bucket is a file or a few; it stays fixed for the life of a table.
BUCKETS = 64


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a key; a null key has one, too."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _put(rows: DataFrame, path: str) -> None:
    (rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))


def store(rows: DataFrame, path: str, key: Column, buckets: int = BUCKETS) -> None:
    """Write a table in buckets, in place of an earlier one."""
    (rows.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket")
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path))


def read(spark: SparkSession, path: str, schema: T.StructType, numbers: list[int] | None = None) -> DataFrame:
    """The table, or its rows in some buckets: the bucket is a folder, so others aren't opened."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
    rows = rows if numbers is None else rows.filter(F.col("bucket").isin(numbers))
    return rows.select(*schema.names)


def touched(batch: DataFrame, key: Column, buckets: int = BUCKETS) -> list[int]:
    """The numbers of the buckets that hold the keys of a batch: at most ``buckets`` of them come to the driver."""
    return sorted(r["b"] for r in batch.select(bucket_of(key, buckets).alias("b")).distinct().collect())


def recover(spark: SparkSession, path: str, schema: T.StructType) -> bool:
    """Put the buckets of a merge that was written in full but not put in place where they belong."""
    redo = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-redo")
    files = redo.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = files.exists(spark._jvm.org.apache.hadoop.fs.Path(redo, "_SUCCESS"))
    if whole:
        kind = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        _put(spark.read.schema(kind).parquet(redo.toString()), path)
    files.delete(redo, True)
    return whole


def merge(batch: DataFrame, path: str, schema: T.StructType, batch_key: Column, key: Column,
          fold: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Fold a batch into a stored table by ``fold(batch, stored rows of the touched buckets)``; returns the touched buckets.

    ``key`` is the key of stored rows, ``batch_key`` the same value made from the columns of the batch. The fold
    returns the columns of ``schema`` and more; an empty batch touches nothing.
    """
    spark = batch.sparkSession
    recover(spark, path, schema)
    numbers = touched(batch, batch_key, buckets)
    if not numbers:
        return numbers
    merged = fold(batch, read(spark, path, schema, numbers)).select(*schema.names)
    merged.withColumn("bucket", bucket_of(key, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}-redo")
    recover(spark, path, schema)
    return numbers
