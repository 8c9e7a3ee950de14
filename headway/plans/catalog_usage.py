"""Queries over usage, file round trips, ad-hoc SQL and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from headway.operators import adhoc, grants, mart, usage
from headway.plans import catalog_contacts, catalog_grants, catalog_mart, catalog_review  # noqa: F401  (shared WITH entries)
from headway.plans.agency_pages import agency_documents, build_mart, document_meta
from headway.plans.catalog import common, query
from headway.plans.stand_ins import LABELS
from headway.session import scratch
from headway.sources import readers, writers
from headway.streaming import jobs

NOW = datetime(2024, 1, 25)

common("usage_log", """
  SELECT event_id AS id, ['ask_ntd', 'ask_cig', 'card_export', 'data_export', 'subscribe'][event_id % 5 + 1] AS event_type, user_id AS contact_id,
    CASE WHEN event_id % 4 <> 0 THEN (['Bus ridership since 2019', 'compare fare recovery', 'rail cost per trip', 'CIG new starts funding'])[event_id % 4 + 1] || ' ' || coalesce(text, '') END AS query_text,
    CASE WHEN event_id % 3 <> 0 THEN 'shape' || (event_id % 3) END AS result_shape, CASE event_id % 7 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'unknown' END AS surface, ts
  FROM events LEFT JOIN benchmark ON item_id = event_id % 40""")
common("last_days", "SELECT * FROM usage_log WHERE ts > TIMESTAMP '2024-01-15'", "usage_log")


@query("clean_usage_events", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'ask_ntd' ELSE 'page_tool_view' END AS event_type, CASE WHEN event_type <> 'click' THEN event_type END AS unknown_event, "
       "'v' || (event_id % 2) AS kept FROM events")
def clean_usage_events(t):
    meta = F.create_map(F.lit("a"), F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")), F.lit("gone"), F.lit(None).cast("string"))
    rows = t.events.select("event_id", F.when(F.col("event_type") == "click", "ask_ntd").otherwise(F.col("event_type")).alias("event_type"),
                           F.lit("s").alias("session_id"), F.col("props").alias("query_text"), F.lit("").alias("result_shape"), meta.alias("meta"))
    out = usage.clean_events(rows)
    return out.select("event_id", "event_type", F.col("meta")["unknown_event"].alias("unknown_event"), F.col("meta")["a"].alias("kept"))


def _recent(t):
    return usage.recent(t.usage, 10, NOW)


@query("usage_by_type", "SELECT event_type, count(*) AS n FROM last_days GROUP BY 1", ("last_days",))
def usage_by_type(t):
    return usage.by_type(_recent(t))


@query("usage_by_day", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM last_days GROUP BY 1, 2", ("last_days",))
def usage_by_day(t):
    return usage.by_day(_recent(t))


@query("usage_by_shape", "SELECT result_shape, count(*) AS n FROM last_days WHERE result_shape IS NOT NULL GROUP BY 1", ("last_days",))
def usage_by_shape(t):
    return usage.by_shape(_recent(t))


@query("usage_by_surface", "SELECT surface, count(*) AS n FROM last_days GROUP BY 1", ("last_days",))
def usage_by_surface(t):
    return usage.by_surface(_recent(t))


@query("recent_questions", "SELECT id, query_text FROM last_days WHERE query_text IS NOT NULL ORDER BY ts DESC, id DESC LIMIT 40", ("last_days",))
def recent_questions(t):
    return usage.recent_queries(_recent(t), 40).select("id", "query_text")


@query("theme_counts", "SELECT theme, n FROM (" + " UNION ALL ".join(
    f"SELECT '{theme}' AS theme, count(*) FILTER (WHERE " + " OR ".join(f"contains(lower(query_text), '{w}')" for w in ws) + ") AS n FROM last_days" for theme, ws in usage.THEMES.items()) + ") WHERE n > 0", ("last_days",))
def theme_counts(t):
    return usage.theme_counts(_recent(t))


@query("plan_mix", "SELECT plan, count(*) AS n FROM contacts GROUP BY 1", ("contacts",))
def plan_mix(t):
    return usage.plan_mix(t.contacts)


@query("usage_totals", "SELECT count(*) AS total_events, min(ts) AS first_event, max(ts) AS last_event FROM events")
def usage_totals(t):
    out = usage.usage_totals(t.usage)
    return out.select("total_events", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_event", "last_event")])


common("limits", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{f}', {'NULL' if n is None else n})" for p, fs in usage.LIMITS.items() for f, n in fs.items()) + ") t(plan, feature, allowance)")


@query("allowance_report", """
  SELECT u.contact_id, u.feature, u.plan, used, allowance, coalesce(used >= allowance, false) AS over FROM
    (SELECT contact_id, event_type AS feature, CASE WHEN lower(plan) IN ('free', 'pro', 'founding', 'team') THEN lower(plan) ELSE 'free' END AS plan, count(*) AS used
     FROM usage_log l LEFT JOIN contacts c ON c.id = l.contact_id WHERE ts > TIMESTAMP '2023-12-26' GROUP BY 1, 2, 3) u JOIN limits m ON m.plan = u.plan AND m.feature = u.feature""", ("usage_log", "contacts", "limits"))
def allowance_report(t):
    return usage.allowance_report(t.usage, t.contacts, usage.limits_frame(t.spark), NOW).select("contact_id", "feature", "plan", "used", "allowance", "over")


@query("ask_rates", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS asks_last_hour FROM events")
def ask_rates(t):
    return usage.ask_rates(t.events).select("event_id", "asks_last_hour")


@query("asks_per_day", "SELECT ts::DATE AS day, count(*) AS asks FROM events GROUP BY 1")
def asks_per_day(t):
    return usage.asks_per_day(t.events)


# ---- files --------------------------------------------------------------------------------------

@query("flat_file_round_trip", "SELECT ntd_id, mode_code, report_year, upt, operating_expense, fares FROM (SELECT ntd_id, mode_code, report_year, upt, operating_expense, NULL::DOUBLE AS fares FROM base_history)", ("base_history",))
def flat_file_round_trip(t):
    """Facts written as a delimited file, read back as text, unpivoted, cleaned and pivoted."""
    path = scratch(t.spark, "flat")
    flat = t.facts.join(t.places, "l_suppkey").select(
        F.col("ntd_id").alias("NTD ID"), F.col("agency").alias("Agency"), F.col("city").alias("City"), F.col("state").alias("State"), F.col("mode_code").alias("Mode"),
        F.col("tos").alias("Type of Service"), F.col("report_year").alias("Report Year"), F.col("upt").alias("Unlinked Passenger Trips"), F.col("operating_expense").alias("Operating Expenses"))
    flat.write.csv(path, header=True)
    hist = mart.pivot_history(mart.clean_keys(mart.melt(readers.read_flat(t.spark, path))), LABELS)
    return hist.select("ntd_id", "mode_code", "report_year", "upt", "operating_expense", "fares")


@query("long_file_round_trip", "SELECT report_year, count(*) AS rows, sum(upt) AS upt FROM base_history WHERE report_year >= 1998 GROUP BY 1", ("base_history",))
def long_file_round_trip(t):
    """Long records written as JSON, read back with the measure and year filter, built into the mart."""
    path = scratch(t.spark, "long")
    t.long_facts.drop("tos").write.json(path)
    rows = readers.read_long(t.spark, path, list(mart.MEASURES), since=1998)
    history, _, _ = build_mart(mart.long_keys(rows), t.index, LABELS)
    return history.groupBy("report_year").agg(F.count(F.lit(1)).alias("rows"), F.sum("upt").alias("upt"))


@query("mart_files", "SELECT report_year, count(*) AS rows, sum(operating_expense_real) AS opex_real FROM history WHERE report_year >= 1999 GROUP BY 1", ("history",))
def mart_files(t):
    """Mart written by year and read back with partition pruning."""
    path = scratch(t.spark, "mart")
    writers.write_mart(t.history, path, "report_year")
    stored = t.spark.read.parquet(path).filter("report_year >= 1999")
    return stored.groupBy("report_year").agg(F.count(F.lit(1)).alias("rows"), F.sum("operating_expense_real").alias("opex_real"))


@query("snapshot_overwrite", "SELECT snapshot_date, count(*) FILTER (WHERE snapshot_date <> (SELECT max(snapshot_date) FROM snaps) OR phase = 'PD') AS projects FROM snaps GROUP BY 1", ("snaps",))
def snapshot_overwrite(t):
    """All snapshots stored, then the newest replaced by its PD rows only; the others must stay."""
    path = scratch(t.spark, "snapshots")
    writers.overwrite_snapshot(t.snapshots, path)
    writers.overwrite_snapshot(grants.latest_rows(t.snapshots).filter("phase = 'PD'"), path)
    return t.spark.read.parquet(path).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("projects"))


@query("document_export", "SELECT p.ntd_id, count(*) AS years FROM picked p JOIN trend t ON t.ntd_id = p.ntd_id GROUP BY 1", ("picked", "trend"))
def document_export(t):
    """Agency documents exported as JSON and read back."""
    path = scratch(t.spark, "documents")
    docs = agency_documents(t.service, t.stored, 1000, 3)
    writers.export_documents(docs, path, document_meta(t.service, t.stored, 1000, 3))
    back = t.spark.read.schema(docs.schema).json(path + "/documents")
    return back.select("ntd_id", F.size("trend").cast("bigint").alias("years"))


@query("result_csv", "SELECT doc_id, text FROM documents")
def result_csv(t):
    """Whole texts with quotes, commas and line breaks survive a CSV export."""
    path = scratch(t.spark, "csv")
    writers.export_result_csv(t.documents.select("doc_id", "text"), path, "Documents", "driver tables")
    back = readers.read_flat(t.spark, path + "/data", line_breaks=True)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


@query("dimension_file", "SELECT n_name AS name, 'R' || n_regionkey AS state, n_nationkey % 2 = 0 AS search_enabled FROM nation")
def dimension_file(t):
    """A reference document (a fixed 25 rows under one key) written as JSON and read back as rows."""
    path = scratch(t.spark, "dimension")
    row = F.struct(F.col("n_name").alias("name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("state"),
                   (F.col("n_nationkey") % 2 == 0).alias("search_enabled"))
    t.nation.agg(F.collect_list(row).alias("agencies")).write.json(path)
    return readers.read_dimension(t.spark, path, "agencies", readers.AGENCY_SCHEMA).select("name", "state", "search_enabled")


# ---- ad-hoc SQL ---------------------------------------------------------------------------------

def _mart(t):
    return {"ntd_history": t.stored, "ntd_service": t.service, "cpi": t.cpi}


@query("sql_ratio_of_sums", "SELECT report_year, sum(upt) AS upt, round(sum(operating_expense_real) / sum(upt) * 100.0) / 100.0 AS cost_per_rider_real FROM history WHERE upt > 0 GROUP BY 1", ("history",))
def sql_ratio_of_sums(t):
    return adhoc.run_sql(t.spark, "WITH y AS (SELECT * FROM ntd_history WHERE upt > 0) SELECT report_year, SUM(upt) AS upt, ROUND(SUM(operating_expense_real) / SUM(upt) * 100.0D) / 100.0D "
                         "AS cost_per_rider_real FROM y GROUP BY report_year ORDER BY report_year", _mart(t))


@query("sql_name_search", "SELECT DISTINCT ntd_id, agency FROM service WHERE lower(agency) LIKE '%000001%'", ("service",))
def sql_name_search(t):
    return adhoc.run_sql(t.spark, "SELECT DISTINCT ntd_id, agency FROM ntd_service WHERE agency ILIKE '%000001%'", _mart(t))


@query("sql_rollup", "SELECT mode, state, sum(upt) AS upt FROM service GROUP BY ROLLUP (mode, state)", ("service",))
def sql_rollup(t):
    return adhoc.run_sql(t.spark, "SELECT mode, state, SUM(upt) AS upt FROM ntd_service GROUP BY ROLLUP (mode, state)", _mart(t))


@query("sql_snapshot_query", "SELECT project_name, rating FROM latest WHERE rating IN ('1-URGENT', '2-HIGH')", ("latest",))
def sql_snapshot_query(t):
    """A guarded snapshot query in a session of its own."""
    path = scratch(t.spark, "snapshots")
    writers.overwrite_snapshot(t.snapshots, path)
    return adhoc.run_snapshot_sql(path, "SELECT project_name, rating FROM cig_projects WHERE snapshot_date = (SELECT max(snapshot_date) FROM cig_projects) "
                                  "AND rating IN ('1-URGENT', '2-HIGH') ORDER BY project_name;", t.spark)


@query("sql_month_match", "SELECT phase, count(*) AS n FROM snaps WHERE date_trunc('month', snapshot_date) = DATE '2000-07-01' GROUP BY 1", ("snaps",))
def sql_month_match(t):
    return adhoc.run_sql(t.spark, "SELECT phase, count(*) AS n FROM cig_projects WHERE date_trunc('month', snapshot_date) = '2000-07-01' GROUP BY phase", {"cig_projects": t.snapshots})


# ---- streams ------------------------------------------------------------------------------------

FILES = 4


def _landed(t, df, label):
    """``df`` landed as three times ``FILES`` files and read as a stream, ``FILES`` of them per batch.

    Rows are dealt by a hash, so later files hold earlier times and keys return; each write uses ``FILES`` tasks.
    """
    path = scratch(t.spark, label)
    number = F.pmod(F.xxhash64(*df.columns), F.lit(3))
    for n in range(3):
        df.filter(number == n).repartition(FILES).write.mode("append").parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


@query("stream_usage", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_usage(t):
    path = scratch(t.spark, "usage")
    jobs.stream_usage(_landed(t, t.events, "events"), path, scratch(t.spark, "checkpoint"))
    return jobs.usage_table(t.spark, path)


@query("stream_ask_rates", """
  SELECT user_id, from_time, count(*) AS asks FROM (SELECT user_id, ts, unnest(generate_series(0, 11)) AS i, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes((i * 5)::INTEGER) AS from_time FROM events)
  GROUP BY 1, 2""")
def stream_ask_rates(t):
    path = scratch(t.spark, "rates")
    jobs.stream_ask_rates(_landed(t, t.events, "events"), path, scratch(t.spark, "checkpoint"))
    return jobs.ask_rate_table(t.spark, path).select("user_id", F.col("from_time").cast("timestamp_ntz").alias("from_time"), "asks")


@query("stream_feedback", "SELECT email, min_by(reason, (ts, reason)) AS reason FROM feedback WHERE reason IS NOT NULL GROUP BY 1", ("feedback",))
def stream_feedback(t):
    path = scratch(t.spark, "stops")
    jobs.stream_feedback(_landed(t, t.feedback, "feedback"), path, scratch(t.spark, "checkpoint"))
    return jobs.stop_table(t.spark, path).select("email", "reason")


@query("stream_intake", "SELECT DISTINCT 'https://x.example/' || (event_id % 5000) AS link FROM events WHERE event_id % 5000 NOT IN (SELECT item_id FROM benchmark)")
def stream_intake(t):
    feed = t.events.select(F.concat(F.lit("https://x.example/"), (F.col("event_id") % 5000).cast("string")).alias("link"), F.col("ts").cast("timestamp").alias("at"))
    known = t.benchmark.select(F.concat(F.lit("https://x.example/"), F.col("item_id").cast("string")).alias("link"))
    sink = scratch(t.spark, "intake")
    jobs.stream_intake(_landed(t, feed, "feed"), known, sink, scratch(t.spark, "checkpoint"))
    return jobs.intake_table(t.spark, sink).select("link")


@query("stream_health", "SELECT f.source_id, count(*) FILTER (WHERE error IS NOT NULL AND (ok_at IS NULL OR ts > ok_at)) AS fail_streak, max_by(entries, ts) FILTER (WHERE error IS NULL) AS last_entries "
       "FROM fetches f JOIN last_ok o USING (source_id) GROUP BY 1", ("fetches", "last_ok"))
def stream_health(t):
    path = scratch(t.spark, "health")
    jobs.stream_health(_landed(t, t.fetches, "fetches"), path, scratch(t.spark, "checkpoint"))
    return jobs.health_table(t.spark, path).select("source_id", "fail_streak", "last_entries")


@query("queue_tick", "SELECT id, 'publish' AS step FROM items WHERE status = 'approved' AND publish_at <= TIMESTAMP '2024-01-25' UNION ALL SELECT id, 'expire' FROM items "
       "WHERE status = 'pending' AND collected_at < TIMESTAMP '2024-01-04' AND (deadline IS NULL OR deadline < DATE '2024-01-25')", ("items",))
def queue_tick(t):
    path = scratch(t.spark, "ticks")
    rows = t.items.select("id", F.lit(1).alias("version"), "status", "publish_at", "collected_at", "deadline")
    jobs.stream_queue_tick(_landed(t, rows, "items"), NOW, 21, path, scratch(t.spark, "checkpoint"))
    return jobs.step_table(t.spark, path)
