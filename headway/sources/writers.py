"""Writers. Plain Parquet/CSV/JSON; replacing a table means writing it again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_mart(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write a mart table, replacing an earlier one."""
    if partition:
        df = df.hint("rebalance", partition)  # whole files per value, a large value split over several tasks
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(partition).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def overwrite_snapshot(df: DataFrame, path: str, key: str = "snapshot_date") -> None:
    """Replace exactly the snapshots present in ``df`` and keep all others."""
    (df.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(key).parquet(path))


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_documents(df: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """Nested JSON documents, one per row, with one metadata document beside them."""
    df.write.mode("overwrite").json(path + "/documents")
    if meta is not None:
        meta.coalesce(1).write.mode("overwrite").json(path + "/meta")


def contact_rows(contacts: DataFrame, status: str | None = None) -> DataFrame:
    """Contact list as text: tags joined with ``;`` and blanks for missing values, oldest first."""
    rows = contacts if status is None else contacts.filter(F.col("status") == status)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(""))
    return rows.orderBy("created_at", "id").select(
        text("email").alias("email"), text("name").alias("name"), text("status").alias("status"),
        text("source").alias("source"), F.concat_ws(";", "tags").alias("tags"),
        iso("created_at").alias("created_at"), iso("confirmed_at").alias("confirmed_at"),
        iso("unsubscribed_at").alias("unsubscribed_at"))


def export_contacts(contacts: DataFrame, path: str, status: str | None = None) -> None:
    contact_rows(contacts, status).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def export_result_csv(df: DataFrame, path: str, title: str, source: str) -> None:
    """Any result as CSV with standard quoting; the source lines go to a sidecar text file."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .csv(path + "/data"))
    notes = df.sparkSession.createDataFrame([(f"# {title}",), (f"# Source: {source}",)], "value string")
    notes.coalesce(1).write.mode("overwrite").text(path + "/notes")


def run_log(results: DataFrame, trigger: str, at) -> DataFrame:
    """One row describing a run: files and how each ended, from (file, status, message)."""
    n = lambda s: F.count_if(F.col("status") == s)
    notes = F.concat_ws(": ", "file", F.coalesce("message", F.lit("")))
    bad = results.filter(F.col("status").isin("unmatched", "unreadable"))
    return results.agg(
        F.count(F.lit(1)).alias("files"), (n("new") + n("changed")).alias("new_versions"),
        n("changed").alias("changed"), n("unchanged").alias("unchanged"),
    ).select(F.lit(trigger).alias("trigger"), F.lit(at).alias("ran_at"), "*"), bad.select(notes.alias("note"))


def log_run(results: DataFrame, path: str, trigger: str, at) -> None:
    """Append the run row; the notes on unreadable files are appended as their own rows."""
    head, notes = run_log(results, trigger, at)
    append_rows(head, path + "/runs")
    append_rows(notes.withColumn("ran_at", F.lit(at)), path + "/notes")
