"""Usage log: cleaning and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.columns import any_of, blank_to_null

# fixed values
EVENT_TYPES = ("ask_ntd", "ask_cig", "card_export", "data_export", "subscribe", "page_tool_view")
FALLBACK_TYPE = "page_tool_view"
PLANS = ("free", "pro", "founding", "team")
PERIOD_DAYS = 30
# fixed values: plan -> feature -> calls per period, None = unlimited
LIMITS = {
    "free": {"ask_ntd": 25, "ask_cig": 25, "card_export": 10, "data_export": 0},
    "pro": {"ask_ntd": None, "ask_cig": None, "card_export": None, "data_export": 100},
    "founding": {"ask_ntd": None, "ask_cig": None, "card_export": None, "data_export": None},
    "team": {"ask_ntd": None, "ask_cig": None, "card_export": None, "data_export": None},
}
# fixed values: theme -> words that bring it up
THEMES = {
    "Ridership": ("ridership", "upt", "passenger", "riders"),
    "Cost & efficiency": ("cost per", "cost_per", "operating expense", "efficiency", "subsidy"),
    "Fares & recovery": ("fare", "recovery", "farebox"),
    "CIG pipeline": ("cig", "new starts", "small starts", "core capacity", "capital investment"),
    "Funding & grants": ("grant", "funding", "federal", "appropriation", "nofo"),
    "Bus": ("bus", "brt"),
    "Rail": ("rail", "subway", "streetcar", "metro", "light rail"),
    "Agency comparison": ("compare", "versus", " vs ", "highest", "lowest", "top ", "rank"),
    "Trends over time": ("since", "trend", "over time", "each year", "by year", "growth"),
    "Service & fleet": ("vehicle", "fleet", "voms", "service hours", "revenue miles"),
}


def clean_events(events: DataFrame) -> DataFrame:
    """Known types only (an unknown one is remembered in meta), blank texts to NULL, empty meta entries dropped.

    ``events(event_type, session_id, query_text, result_shape, meta)`` with meta as map<string,string>.
    """
    known = F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))
    filled = lambda c: F.nullif(c, F.lit(""))
    meta = F.coalesce("meta", F.expr("map()").cast("map<string,string>"))
    noted = F.when(known, meta).otherwise(F.map_concat(
        F.map_filter(meta, lambda k, v: k != "unknown_event"), F.create_map(F.lit("unknown_event"), F.col("event_type"))))
    return events.withColumns({
        "meta": F.map_filter(noted, lambda k, v: v.isNotNull()), "event_type": F.when(known, F.col("event_type")).otherwise(FALLBACK_TYPE),
        "session_id": filled("session_id"), "query_text": filled("query_text"), "result_shape": filled("result_shape")})


def recent(events: DataFrame, days: int, now: datetime, at: str = "created_at") -> DataFrame:
    """Events of the last ``days`` days."""
    return events.filter(F.col(at) > F.lit(now) - F.make_dt_interval(F.lit(days)))


def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


def by_day(events: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "created_at").cast("date").alias("day")
    return events.groupBy(day, "event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("day", "event_type")


def by_shape(events: DataFrame) -> DataFrame:
    return (events.filter("result_shape IS NOT NULL").groupBy("result_shape").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "result_shape"))


def by_surface(events: DataFrame, meta: str = "meta") -> DataFrame:
    surface = F.coalesce(F.get_json_object(meta, "$.surface"), F.lit("unknown")).alias("surface")
    return events.groupBy(surface).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "surface")


def recent_queries(events: DataFrame, n: int) -> DataFrame:
    return (events.filter("query_text IS NOT NULL").orderBy(F.desc("created_at"), F.desc("id")).limit(n)
            .select("id", "event_type", "query_text", "result_shape", "created_at"))


def theme_counts(events: DataFrame, text: str = "query_text") -> DataFrame:
    """How many texts bring up each theme; a text counts once per theme. One pass, ten counters."""
    low = F.lower(text)
    hits = [F.count_if(any_of(F.contains(low, F.lit(w)) for w in ws)).alias(f"_{i}") for i, ws in enumerate(THEMES.values())]
    pairs = F.array(*[F.struct(F.lit(t).alias("theme"), F.col(f"_{i}").alias("n")) for i, t in enumerate(THEMES)])
    return events.filter(F.col(text).isNotNull()).agg(*hits).select(F.inline(pairs)).filter("n > 0").orderBy(F.desc("n"), "theme")


def plan_mix(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("plan").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "plan")


def usage_totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total_events"), F.min("created_at").alias("first_event"), F.max("created_at").alias("last_event"))


def limits_frame(spark) -> DataFrame:
    rows = [(p, f, n) for p, fs in LIMITS.items() for f, n in fs.items()]
    return spark.createDataFrame(rows, "plan string, feature string, allowance int")


def allowance_report(events: DataFrame, contacts: DataFrame, limits: DataFrame, now: datetime) -> DataFrame:
    """Use of each metered feature per contact in the current period against the plan's allowance.

    An unknown plan counts as free and a NULL allowance is unlimited.
    """
    plan = F.lower(F.coalesce(blank_to_null("plan"), F.lit("free")))
    who = contacts.select(F.col("id").alias("contact_id"), F.when(plan.isin(*PLANS), plan).otherwise("free").alias("plan"))
    used = (recent(events, PERIOD_DAYS, now).groupBy("contact_id", F.col("event_type").alias("feature"))
            .agg(F.count(F.lit(1)).alias("used")))
    rows = used.join(who, "contact_id", "left").withColumn("plan", F.coalesce("plan", F.lit("free")))
    rows = rows.join(limits, ["plan", "feature"])
    return rows.withColumn("over", F.coalesce(F.col("used") >= F.col("allowance"), F.lit(False)))


def ask_rates(events: DataFrame, visitor: str = "user_id", at: str = "ts", seconds: int = 3600) -> DataFrame:
    """Each event with its visitor's events in the trailing hour (itself included).

    Counted as running events minus those that had left the hour, both read off one ordered pass over
    arrivals and departures, so a visitor with a third of all events spans many tasks.
    """
    from headway.functions.ordered import running_total
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    base = events.select(F.col(visitor).alias("visitor"), micros.alias("t"))
    arrive = base.groupBy("visitor", "t").agg(F.count(F.lit(1)).alias("n"))
    leave = arrive.select("visitor", (F.col("t") + seconds * 1_000_000 + 1).alias("t"), (-F.col("n")).alias("n"))
    steps = arrive.unionByName(leave).groupBy("visitor", "t").agg(F.sum("n").alias("n"))
    run = running_total(steps, ["visitor"], [F.asc("t")], F.col("n"), "asks_last_hour")
    rows = events.withColumns({"_v": F.col(visitor), "_t": micros})
    return (rows.join(run.select(F.col("visitor").alias("_v"), F.col("t").alias("_t"), "asks_last_hour"), ["_v", "_t"])
            .drop("_v", "_t"))


def asks_per_day(events: DataFrame, at: str = "ts") -> DataFrame:
    return events.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("asks"))
