"""Ad-hoc read-only SQL over registered tables. Spark parses and plans; only the guard is here."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

READ = re.compile(r"^\s*(SELECT|WITH)\b", re.I)
# fixed values: words that may not occur in a mart query
REFUSED = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "ATTACH", "COPY", "PRAGMA", "REPLACE")
# fixed values: words that may not occur in a snapshot query
REFUSED_STRICT = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "GRANT", "REVOKE", "TRUNCATE", "COPY", "MERGE", "SET",
                  "RESET", "DO", "CALL", "EXECUTE", "PREPARE", "LISTEN", "NOTIFY", "VACUUM", "LOCK", "set_config",
                  r"pg_read\w*", "pg_ls_dir", r"pg_sleep\w*", r"lo_\w+", r"dblink\w*")


def _refuse(sql: str, words) -> None:
    if not READ.match(sql) or re.search(r"\b(" + "|".join(words) + r")\b", sql, re.I):
        raise ValueError("only read-only SELECT queries are allowed")


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One read-only query over the mart tables."""
    _refuse(sql, REFUSED)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def check_snapshot_sql(sql: str) -> str:
    """The statement without its closing semicolon, or an error when it is not one read-only query."""
    text = sql.strip().removesuffix(";").rstrip()
    if ";" in re.sub(r"'(?:[^']|'')*'", "''", text):
        raise ValueError("only a single query is allowed")
    _refuse(text, REFUSED_STRICT)
    return text


def run_snapshot_sql(path: str, sql: str, spark: SparkSession, name: str = "cig_projects") -> DataFrame:
    """One query in a fresh session that knows only the snapshot table stored at ``path``."""
    text = check_snapshot_sql(sql)
    alone = spark.newSession()
    alone.conf.set("spark.sql.runSQLOnFiles", "false")
    alone.read.parquet(path).createOrReplaceTempView(name)
    return alone.sql(text)
