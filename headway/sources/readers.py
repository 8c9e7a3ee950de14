"""Readers. Flat files stay text; typing happens in the operators, so a bad cell never fails a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in (
    "ntd_id", "agency_name", "city", "state", "mode", "report_year", "field", "value")])

AGENCY_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("state", T.StringType()), T.StructField("ntd_id", T.StringType()),
    T.StructField("cig_sponsor", T.StringType()), T.StructField("website", T.StringType()),
    T.StructField("newsroom", T.StringType()), T.StructField("procurement_url", T.StringType()),
    T.StructField("search_enabled", T.BooleanType())])

PROFILE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("place", T.StringType()),
    T.StructField("program", T.StringType()), T.StructField("states", T.ArrayType(T.StringType())),
    T.StructField("key", T.StringType()), T.StructField("mode_field", T.StringType()),
    T.StructField("mode", T.StringType()), T.StructField("mentions_rail", T.BooleanType()),
    T.StructField("mentions_brt", T.BooleanType()), T.StructField("sha256", T.StringType()),
    T.StructField("file", T.StringType())])


def read_flat(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Delimited file with a header; every column is text.

    With ``line_breaks`` quoted values may hold line breaks; each file is then read by one task.
    """
    return spark.read.option("multiLine", line_breaks).option("escape", '"').csv(path, header=True, inferSchema=False)


def known_measures(df: DataFrame, measures, since: int | None = None, field: str = "field",
                   year: str = "report_year") -> DataFrame:
    """Keep known measures and, when asked, years from ``since``; both reach a columnar scan."""
    cond: Column = F.col(field).isin(*measures)
    if since is not None:
        cond = cond & (F.col(year) >= F.lit(since).cast(df.schema[year].dataType))
    return df.filter(cond)


def read_long(spark: SparkSession, path: str, measures, since: int | None = None) -> DataFrame:
    """Landed JSON records in the field/value layout."""
    return known_measures(spark.read.schema(LONG_SCHEMA).json(path), measures, since)


def read_dimension(spark: SparkSession, path: str, key: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON document holding a list of records under ``key``."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(T.StructType([T.StructField(key, T.ArrayType(schema))]))
    return reader.json(path).select(F.inline(F.col(key)))


def read_contact_files(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Contact CSV files as (file, line_no, cells), up to ``width`` cells a row; for ``operators.contacts.parse_contacts``.

    Quoted values may hold line breaks, so a file is read by one task, in order.
    """
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    rows = spark.read.schema(cells).option("multiLine", True).option("escape", '"').csv(path, header=False)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"),
                       F.array(*[F.col(c) for c in cells.names]).alias("cells"))
