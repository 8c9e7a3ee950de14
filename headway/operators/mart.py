"""The annual mart: shaping, enrichment and the analytics read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.columns import guarded, lookup, round_half_up, round_to, slug, to_number
from headway.functions.ordered import exact_median, running_total, standings

KEYS = ["ntd_id", "agency", "city", "state", "mode_code", "report_year"]

# fixed values: reported measure name -> mart column
MEASURES = {
    "Unlinked Passenger Trips": "upt",
    "Operating Expenses": "operating_expense",
    "Fares": "fares",
    "Passenger Miles Traveled": "passenger_miles",
    "Vehicle Revenue Miles": "vehicle_revenue_miles",
    "Vehicle Revenue Hours": "vehicle_revenue_hours",
    "Vehicles Operated in Maximum Service": "voms",
    "Operating Expenses - Vehicle Operations": "opex_vehicle_operations",
    "Operating Expenses - Vehicle Maintenance": "opex_vehicle_maintenance",
    "Operating Expenses - Facility Maintenance": "opex_facility_maintenance",
    "Operating Expenses - General Administration": "opex_general_admin",
}
MEASURE_COLUMNS = list(MEASURES.values())

# fixed values: mode code -> label
MODE_LABELS = {
    "MB": "Bus", "CB": "Commuter Bus", "RB": "Bus Rapid Transit", "TB": "Trolleybus",
    "HR": "Heavy Rail", "LR": "Light Rail", "CR": "Commuter Rail", "YR": "Hybrid Rail",
    "SR": "Streetcar", "MG": "Monorail/Automated Guideway", "CC": "Cable Car",
    "IP": "Inclined Plane", "DR": "Demand Response", "DT": "Demand Response - Taxi",
    "VP": "Vanpool", "FB": "Ferryboat", "AR": "Alaska Railroad", "PB": "Publico",
    "TR": "Aerial Tramway", "OR": "Other Rail", "MO": "Other",
}

# fixed values: consumer price index, annual averages
PRICE_INDEX = {
    2015: 237.017, 2016: 240.007, 2017: 245.120, 2018: 251.107, 2019: 255.657,
    2020: 258.811, 2021: 270.970, 2022: 292.655, 2023: 304.702, 2024: 313.689,
}

METRICS = ("cost_per_rider", "upt", "fare_recovery")

# fixed values: curated rankings as (slug, mode, metric, order, floor)
RANKINGS = [
    ("cheapest-heavy-rail-cost-per-rider", "Heavy Rail", "cost_per_rider", "asc", 1_000_000),
    ("most-expensive-heavy-rail-cost-per-rider", "Heavy Rail", "cost_per_rider", "desc", 1_000_000),
    ("highest-ridership-heavy-rail", "Heavy Rail", "upt", "desc", 0),
    ("best-farebox-recovery-heavy-rail", "Heavy Rail", "fare_recovery", "desc", 1_000_000),
    ("cheapest-light-rail-cost-per-rider", "Light Rail", "cost_per_rider", "asc", 500_000),
    ("most-expensive-light-rail-cost-per-rider", "Light Rail", "cost_per_rider", "desc", 500_000),
    ("highest-ridership-light-rail", "Light Rail", "upt", "desc", 0),
    ("cheapest-commuter-rail-cost-per-rider", "Commuter Rail", "cost_per_rider", "asc", 500_000),
    ("most-expensive-commuter-rail-cost-per-rider", "Commuter Rail", "cost_per_rider", "desc", 500_000),
    ("highest-ridership-commuter-rail", "Commuter Rail", "upt", "desc", 0),
    ("best-farebox-recovery-commuter-rail", "Commuter Rail", "fare_recovery", "desc", 500_000),
    ("cheapest-bus-systems-cost-per-rider", "Bus", "cost_per_rider", "asc", 5_000_000),
    ("most-expensive-bus-systems-cost-per-rider", "Bus", "cost_per_rider", "desc", 5_000_000),
    ("highest-ridership-bus-agencies", "Bus", "upt", "desc", 0),
    ("best-farebox-recovery-bus", "Bus", "fare_recovery", "desc", 5_000_000),
    ("highest-ridership-bus-rapid-transit", "Bus Rapid Transit", "upt", "desc", 0),
    ("highest-ridership-streetcar", "Streetcar", "upt", "desc", 0),
    ("highest-ridership-ferry", "Ferryboat", "upt", "desc", 0),
    ("most-expensive-demand-response-cost-per-rider", "Demand Response", "cost_per_rider", "desc", 500_000),
    ("highest-ridership-demand-response", "Demand Response", "upt", "desc", 0),
]


# ---- shaping ------------------------------------------------------------------------------------

def _resolve(columns, *keywords) -> str | None:
    """The column holding all keywords; a lone keyword prefers a column with exactly that name."""
    exact = [c for c in columns if len(keywords) == 1 and c.lower() == keywords[0]]
    holding = [c for c in columns if all(k in c.lower() for k in keywords)]
    return next(iter(exact + holding), None)


def melt(df: DataFrame, year: int | None = None) -> DataFrame:
    """Flat file (one column per measure) to (keys, measure, value) rows of text."""
    cols = df.columns
    found = {
        "ntd_id": _resolve(cols, "ntd", "id") or _resolve(cols, "id"),
        "agency": _resolve(cols, "agency"), "city": _resolve(cols, "city"), "state": _resolve(cols, "state"),
        "mode_code": _resolve(cols, "mode"), "report_year": _resolve(cols, "report", "year"),
        "upt": _resolve(cols, "unlinked", "passenger", "trips") or _resolve(cols, "upt"),
        "operating_expense": _resolve(cols, "operating", "expense"),
    }
    absent = [k for k in ("mode_code", "upt", "operating_expense") if found[k] is None]
    if absent:
        raise ValueError(f"no column found for {', '.join(absent)} among {cols}")
    missing = {k: F.lit("") for k in KEYS} | {"report_year": F.lit(year)}
    flat = df.select(*[(F.col(f"`{src}`") if src else missing[k]).cast("string").alias(k)
                       for k, src in found.items()])
    return flat.unpivot(KEYS, ["upt", "operating_expense"], "measure", "value")


def map_measures(df: DataFrame, field: str = "field", names: dict | None = None) -> DataFrame:
    """Rename reported measures to mart columns and drop unknown ones."""
    names = MEASURES if names is None else names
    return df.filter(F.col(field).isin(*names)).withColumn("measure", lookup(names, F.col(field)))


def long_keys(df: DataFrame) -> DataFrame:
    """Field/value records to (keys, measure, value)."""
    return map_measures(df).select(
        "ntd_id", F.col("agency_name").alias("agency"), "city", "state",
        F.col("mode").alias("mode_code"), "report_year", "measure", "value")


def clean_keys(df: DataFrame) -> DataFrame:
    """Trim text keys (missing -> ''), upper-case the mode, type year and value, drop empty values."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return (df.withColumns({k: text(k) for k in ("ntd_id", "agency", "city", "state")} | {
                "mode_code": F.upper(F.trim(F.col("mode_code").cast("string"))),
                "report_year": to_number("report_year").cast("int"),
                "value": to_number("value")})
            .filter(F.col("value").isNotNull()))


def label_mode(df: DataFrame, labels: dict | None = None) -> DataFrame:
    """Friendly mode label; an unknown code is its own label."""
    label = lookup(MODE_LABELS if labels is None else labels, F.col("mode_code"))
    return df.withColumn("mode", F.coalesce(label, F.col("mode_code")))


def _history_columns(df: DataFrame) -> DataFrame:
    lead = KEYS[:5] + ["mode"] + KEYS[5:]
    return df.select(*lead, *MEASURE_COLUMNS)


def pivot_history(long: DataFrame, labels: dict | None = None) -> DataFrame:
    """One row per agency, mode and year with one column per measure, summed over types of service.

    The measure list is fixed, so the pivot is a single partial aggregation and one shuffle.
    """
    wide = long.groupBy(*KEYS).pivot("measure", MEASURE_COLUMNS).agg(F.sum("value"))
    return _history_columns(label_mode(wide, labels))


def roll_up_history(df: DataFrame, labels: dict | None = None) -> DataFrame:
    """The same rows from input that already has measure columns (absent measures become NULL)."""
    have = [m for m in MEASURE_COLUMNS if m in df.columns]
    wide = df.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in have])
    wide = wide.withColumns({m: F.lit(None).cast("double") for m in MEASURE_COLUMNS if m not in have})
    return _history_columns(label_mode(wide, labels))


def deflator(history: DataFrame, index: DataFrame) -> DataFrame:
    """Factor turning each index year's money into money of the latest year both sides know."""
    base = (index.join(history.select(F.col("report_year").alias("year")).distinct(), "year", "left_semi")
            .agg(F.max_by(F.struct("year", "cpi_u"), "year").alias("b")))
    return (index.crossJoin(F.broadcast(base)).filter(F.col("b").isNotNull())
            .select("year", "cpi_u", F.col("b.year").alias("base_year"),
                    F.round(F.col("b.cpi_u") / F.col("cpi_u"), 6).alias("factor_to_base")))


def missing_index_years(history: DataFrame, index: DataFrame) -> DataFrame:
    """Report years the index does not cover; their real-money columns stay NULL."""
    return (history.select("report_year").filter("report_year IS NOT NULL").distinct()
            .join(index, F.col("report_year") == F.col("year"), "left_anti"))


def index_frame(spark, index: dict | None = None) -> DataFrame:
    """The price index as a table of at most a few dozen rows."""
    rows = [(int(y), float(v)) for y, v in (PRICE_INDEX if index is None else index).items()]
    return spark.createDataFrame(rows, "year int, cpi_u double")


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "cost_per_rider": round_to(guarded("operating_expense", "upt"), 2),
        "fare_recovery": round_to(guarded("fares", "operating_expense"), 4),
        "cost_per_revenue_hour": round_to(guarded("operating_expense", "vehicle_revenue_hours"), 2),
        "avg_trip_miles": round_to(guarded("passenger_miles", "upt"), 2)})


def with_real(df: DataFrame, cpi: DataFrame) -> DataFrame:
    """Inflation-adjusted columns; the deflator has one row per index year."""
    dim = cpi.select("year", F.col("base_year").alias("real_dollar_year"), F.col("factor_to_base").alias("cpi_factor"))
    real = F.col("operating_expense") * F.col("cpi_factor")
    return (df.join(dim, F.col("report_year") == F.col("year"), "left").drop("year")
            .withColumns({
                "operating_expense_real": F.round(real, 0),
                "fares_real": F.round(F.col("fares") * F.col("cpi_factor"), 0),
                "cost_per_rider_real": round_to(guarded(real, "upt"), 2),
                "cost_per_revenue_hour_real": round_to(guarded(real, "vehicle_revenue_hours"), 2)}))


SERVICE_LEAD = ["ntd_id", "agency", "city", "state", "mode_code", "mode", "upt", "operating_expense",
                "cost_per_rider"]


def latest_service(history: DataFrame) -> DataFrame:
    """Latest report year only; rows with trips and a reported expense."""
    latest = history.agg(F.max("report_year").alias("_latest"))
    kept = (history.filter((F.col("upt") > 0) & F.col("operating_expense").isNotNull())
            .join(F.broadcast(latest), F.col("report_year").eqNullSafe(F.col("_latest"))))
    return kept.select(*SERVICE_LEAD, *[c for c in history.columns if c not in SERVICE_LEAD])


def order_history(history: DataFrame) -> DataFrame:
    return history.orderBy(F.col("report_year").asc_nulls_last(), "ntd_id", F.col("mode_code").asc_nulls_last())


# ---- analytics ----------------------------------------------------------------------------------

def _operating(df: DataFrame) -> DataFrame:
    return df.filter((F.col("upt") > 0) & (F.col("operating_expense") > 0))


def by_mode(service: DataFrame) -> DataFrame:
    return (service.groupBy("mode")
            .agg(F.count(F.lit(1)).alias("agencies"), round_to(F.avg("cost_per_rider"), 2).alias("avg_cost_per_rider"))
            .orderBy(F.desc("agencies"), "mode"))


def national_trend(history: DataFrame) -> DataFrame:
    """Totals per year; ratios are ratios of sums."""
    rows = history.filter((F.col("upt") > 0) & F.col("operating_expense").isNotNull())
    return (rows.groupBy("report_year").agg(
        F.count(F.lit(1)).alias("agency_modes"),
        round_to(F.sum("upt") / 1e6, 1).alias("upt_millions"),
        round_to(F.sum("operating_expense") / 1e9, 2).alias("opex_billions"),
        round_to(F.sum("operating_expense_real") / 1e9, 2).alias("opex_billions_real"),
        round_to(F.sum("operating_expense") / F.sum("upt"), 2).alias("cost_per_rider"),
        round_to(F.sum("operating_expense_real") / F.sum("upt"), 2).alias("cost_per_rider_real"))
        .orderBy(F.col("report_year").asc_nulls_last()))


def mart_health(history: DataFrame, service: DataFrame) -> DataFrame:
    years = history.agg(F.count(F.lit(1)).alias("history_rows"), F.min("report_year").alias("first_year"),
                        F.max("report_year").alias("last_year"))
    return years.crossJoin(service.agg(F.count(F.lit(1)).alias("service_rows")))


CONTEXT_RATIOS = ("cost_per_rider", "fare_recovery", "cost_per_revenue_hour")


def mode_context(service: DataFrame) -> DataFrame:
    """Per mode: number of agencies, exact medians of three ratios, total trips."""
    rows = _operating(service)
    totals = rows.groupBy("mode").agg(F.count(F.lit(1)).alias("agencies"), F.sum("upt").alias("total_upt"))
    tall = rows.select("mode", *CONTEXT_RATIOS).unpivot(["mode"], list(CONTEXT_RATIOS), "ratio", "v")
    medians = (exact_median(tall, ["mode", "ratio"], "v", "m").groupBy("mode")
               .pivot("ratio", list(CONTEXT_RATIOS)).agg(F.first("m")))
    medians = medians.select(F.col("mode").alias("_m"), *[F.col(r).alias(f"median_{r}") for r in CONTEXT_RATIOS])
    return totals.join(medians, F.col("mode").eqNullSafe(F.col("_m")), "left").drop("_m")


def qualifying(service: DataFrame, history: DataFrame, min_upt: float, min_years: int,
               top: int | None = None) -> DataFrame:
    """Agencies with enough trips this year and enough report years, largest first."""
    totals = _operating(service).groupBy("ntd_id").agg(F.sum("upt").alias("upt")).filter(F.col("upt") >= min_upt)
    years = (_operating(history).select("ntd_id", "report_year").distinct()
             .groupBy("ntd_id").agg(F.count("report_year").alias("years")).filter(F.col("years") >= min_years))
    out = totals.join(years, "ntd_id").orderBy(F.desc("upt"), "ntd_id")
    return out.limit(top) if top else out


def national_rank(picked: DataFrame) -> DataFrame:
    """Position of each qualifying agency, largest first, ties by id."""
    return running_total(picked.select("ntd_id", "upt"), [], [F.desc("upt"), F.asc("ntd_id")],
                         name="national_rank_by_upt")


def agency_head(service: DataFrame) -> DataFrame:
    """One repeatable name, city and state per agency."""
    return service.groupBy("ntd_id").agg(*[F.min(c).alias(c) for c in ("agency", "city", "state")])


MODE_DETAIL = ["mode", "upt", "operating_expense", "cost_per_rider", "fare_recovery", "cost_per_revenue_hour",
               "passenger_miles", "avg_trip_miles", "voms", "vehicle_revenue_hours", "fares"]


def agency_modes(service: DataFrame) -> DataFrame:
    """Modes with both trips and expense, one row per agency and mode."""
    return _operating(service).select("ntd_id", *MODE_DETAIL)


def agency_mode_list(modes: DataFrame) -> DataFrame:
    """Modes nested per agency, busiest first; an agency has at most as many as there are mode codes."""
    entry = F.struct((-F.col("upt")).alias("_k"), *[c for c in modes.columns if c != "ntd_id"])
    ordered = F.sort_array(F.collect_list(entry))
    return modes.groupBy("ntd_id").agg(
        F.transform(ordered, lambda m: m.dropFields("_k")).alias("modes"))


def agency_trend(history: DataFrame) -> DataFrame:
    return (_operating(history).groupBy("ntd_id", F.col("report_year").alias("year"))
            .agg(F.sum("upt").alias("upt"), F.sum("operating_expense_real").alias("opex_real"))
            .withColumn("cost_per_rider_real", guarded("opex_real", "upt")))


def agency_totals(modes: DataFrame) -> DataFrame:
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)))
    return (modes.groupBy("ntd_id")
            .agg(total("upt").alias("total_upt"), total("operating_expense").alias("total_opex"),
                 F.nullif(total("fares"), F.lit(0.0)).alias("total_fares"))
            .withColumn("cost_per_rider", F.col("total_opex") / F.nullif(F.col("total_upt"), F.lit(0.0)))
            .withColumn("fare_recovery", F.col("total_fares") / F.nullif(F.col("total_opex"), F.lit(0.0))))


def vs_median(modes: DataFrame, context: DataFrame) -> DataFrame:
    """Each mode's cost against the mode's national median, in whole percent (half to even)."""
    ctx = context.select(F.col("mode").alias("_m"), F.col("median_cost_per_rider").alias("mode_median_cost_per_rider"),
                         F.col("agencies").alias("mode_agencies"))
    med = F.nullif(F.col("mode_median_cost_per_rider"), F.lit(0.0))
    cost = F.nullif(F.col("cost_per_rider"), F.lit(0.0))
    return (modes.join(ctx, F.col("mode").eqNullSafe(F.col("_m")), "left").drop("_m")
            .withColumn("vs_mode_median_pct", F.rint((cost - med) / med * 100).cast("bigint")))


def mode_rank(service: DataFrame) -> DataFrame:
    """1 + rows of the same mode with more trips, among all rows with trips (expense not needed)."""
    rows = service.filter(F.col("upt") > 0).select("ntd_id", "mode", "report_year", "upt")
    return standings(rows, ["report_year", "mode"], "upt", "mode_rank_by_upt")


def state_rank(service: DataFrame) -> DataFrame:
    """1 + agencies of the state whose trips over all rows exceed this agency's trips over its
    operating rows (trips and expense). The two totals differ, so an agency may outrank itself.

    Both totals are laid on one line per state, largest first; the running count of all-row totals at
    an agency's own operating total is the answer, so no pair of agencies is ever compared.
    """
    all_rows = (service.filter(F.col("upt") > 0).groupBy("ntd_id", "state").agg(F.sum("upt").alias("v"))
                .select("state", "v", F.lit(None).cast("string").alias("ntd_id"), F.lit(1).alias("counts")))
    own = (_operating(service).groupBy("ntd_id").agg(F.sum("upt").alias("v"))
           .join(agency_head(service).select("ntd_id", "state"), "ntd_id")
           .select("state", "v", "ntd_id", F.lit(0).alias("counts")))
    line = running_total(all_rows.unionByName(own), ["state"],
                         [F.desc("v"), F.asc("counts"), F.asc("ntd_id")], F.col("counts"), "above")
    return line.filter("counts = 0").select(
        "ntd_id", "state", F.col("v").alias("total_upt"), (F.col("above") + 1).alias("state_rank_by_upt"))


def spec_frame(spark, specs=None) -> DataFrame:
    rows = [(s, m, k, o, float(f)) for s, m, k, o, f in (RANKINGS if specs is None else specs)]
    return spark.createDataFrame(rows, "ranking string, mode string, metric string, direction string, floor double")


def rankings(service: DataFrame, specs: DataFrame, top: int, least: int) -> DataFrame:
    """All curated rankings in one pass: each row meets the specs of its mode, and the ``top`` rows are cut
    per spec before the shuffle; rankings of fewer than ``least`` rows are left out."""
    metric = F.expr("CASE metric " + " ".join(f"WHEN '{m}' THEN {m}" for m in METRICS) + " END")
    rows = _operating(service).join(specs, "mode").withColumn("metric_value", metric)
    rows = rows.filter((F.col("upt") >= F.col("floor")) & F.col("metric_value").isNotNull())
    sign = F.when(F.col("direction") == "asc", F.col("metric_value")).otherwise(-F.col("metric_value"))
    line = Window.partitionBy("ranking").orderBy(sign, "ntd_id")
    cut = rows.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= top)
    sized = cut.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("ranking"))).filter(F.col("of") >= least)
    return sized.select("ranking", "mode", "metric", "direction", "rank", "of", "ntd_id", "agency", "city", "state",
                        "upt", "cost_per_rider", "fare_recovery", "metric_value",
                        slug("agency", "ntd_id").alias("slug"))


def rankings_for(ranked: DataFrame) -> DataFrame:
    """Which rankings an agency is in; bounded by the number of rankings."""
    entry = F.struct("ranking", "rank", "of")
    return ranked.groupBy("slug").agg(F.sort_array(F.collect_list(entry)).alias("rankings"))


def recovery(trend: DataFrame, base_year: int) -> DataFrame:
    """Latest year against a fixed year and against the prior reported year, whole percent."""
    per = Window.partitionBy("ntd_id")
    by_year = per.orderBy("year")
    pct = lambda now, then: round_half_up((now / F.nullif(then, F.lit(0.0)) - 1) * 100).cast("bigint")
    rows = trend.withColumns({
        "prior_year": F.lag("year").over(by_year), "prior_upt": F.lag("upt").over(by_year),
        "base_upt": F.max(F.when(F.col("year") == base_year, F.col("upt"))).over(per),
        "_last": F.max("year").over(per), "years": F.count(F.lit(1)).over(per)})
    return rows.filter(F.col("year") == F.col("_last")).select(
        "ntd_id", "year", "years", pct(F.col("upt"), F.col("base_upt")).alias("vs_base_pct"),
        "prior_year", pct(F.col("upt"), F.col("prior_upt")).alias("vs_prior_pct"))


def trend_extent(trend: DataFrame, measure: str, group: str = "ntd_id", at: str = "year") -> DataFrame:
    """First, last, lowest and highest point of a series with at least three points."""
    return (trend.filter(F.col(measure).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("points"), F.min(at).alias("first_year"),
        F.min_by(measure, at).alias("first_value"), F.max(at).alias("last_year"),
        F.max_by(measure, at).alias("last_value"), F.min(measure).alias("low"), F.max(measure).alias("high"))
        .filter(F.col("points") >= 3))


def ranking_spread(ranked: DataFrame) -> DataFrame:
    """Ends of each cost ranking and how far apart they are."""
    cost = ranked.filter(F.col("metric") == "cost_per_rider")
    key = F.struct("metric_value", "rank")
    ends = cost.groupBy("ranking").agg(
        F.min_by("agency", key).alias("cheapest"), F.min("metric_value").alias("low"),
        F.max_by("agency", key).alias("dearest"), F.max("metric_value").alias("high"))
    return ends.withColumn("spread", round_to(F.col("high") / F.nullif(F.col("low"), F.lit(0.0)), 1))


def state_index(pages: DataFrame) -> DataFrame:
    """Agencies with their place inside their state, most trips first."""
    rows = pages.select("ntd_id", F.coalesce(F.nullif("state", F.lit("")), F.lit("—")).alias("state"),
                        "total_upt", "total_opex")
    return running_total(rows, ["state"], [F.desc("total_upt"), F.asc("ntd_id")], name="place_in_state")


def index_totals(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count(F.lit(1)).alias("agencies"), F.countDistinct("state").alias("states"),
                     F.sum("total_upt").alias("total_trips"), F.sum("total_opex").alias("total_opex"))


def rankings_by_mode(ranked: DataFrame) -> DataFrame:
    """Rankings grouped by mode with the leading agency of each."""
    lead = ranked.filter("rank = 1").select("mode", "ranking", F.col("agency").alias("leader"), "of")
    return lead.withColumn("rankings_in_mode", F.count(F.lit(1)).over(Window.partitionBy("mode")))


def agency_series(history: DataFrame, since: int | None = None, ntd_id: str | None = None) -> DataFrame:
    """Agency-wide yearly series over all modes; real cost per rider is a ratio of sums."""
    rows = history.filter(F.col("upt") > 0)
    if ntd_id is not None:
        rows = rows.filter(F.col("ntd_id") == ntd_id)
    if since is not None:
        rows = rows.filter(F.col("report_year") >= since)
    return (rows.groupBy("ntd_id", "report_year")
            .agg(F.sum("upt").alias("upt"),
                 round_to(F.sum("operating_expense_real") / F.sum("upt"), 2).alias("cost_per_rider_real")))


def agency_mode_series(history: DataFrame, since: int | None = None, ntd_id: str | None = None) -> DataFrame:
    rows = history
    if ntd_id is not None:
        rows = rows.filter(F.col("ntd_id") == ntd_id)
    if since is not None:
        rows = rows.filter(F.col("report_year") >= since)
    return rows.select("ntd_id", "report_year", "mode", "cost_per_rider_real").orderBy("ntd_id", "mode", "report_year")


def balanced_panel(history: DataFrame, years: list[int]) -> DataFrame:
    """Only agencies present in every compared year."""
    rows = history.filter(F.col("report_year").isin(*years) & (F.col("upt") > 0))
    full = (rows.select("ntd_id", "report_year").distinct().groupBy("ntd_id")
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(set(years))))
    return rows.join(full, "ntd_id", "left_semi")


# fixed values: public brand -> reporter id
BRAND_IDS = {
    "MTA New York City Transit": "20008", "NYC subway": "20008", "MTA Bus": "20188", "LIRR": "20100",
    "Metro-North": "20078", "PATH": "20098", "NJ Transit": "20080", "CTA Chicago": "50066", "Metra": "50118",
    "LA Metro": "90154", "WMATA": "30030", "DC Metro": "30030", "MBTA Boston": "10003", "SEPTA": "30019",
    "SFMTA": "90015", "Muni": "90015", "BART": "90003", "AC Transit": "90014", "VTA San Jose": "90013",
    "King County Metro": "00001", "Sound Transit": "00040", "Washington State Ferries": "00035",
    "Miami-Dade Transit": "40034", "Broward County Transit": "40029", "LYNX Orlando": "40035",
    "Houston METRO": "60008", "DART Dallas": "60056", "VIA San Antonio": "60011", "CapMetro Austin": "60048",
    "San Diego MTS": "90026", "OCTA": "90036", "Long Beach Transit": "90023", "Valley Metro": "90032",
    "Phoenix": "90032", "RTC Las Vegas": "90045", "MARTA Atlanta": "40022", "TriMet Portland": "00008",
    "RTD Denver": "80006", "UTA Utah": "80001", "MTA Maryland": "30034", "Baltimore": "30034",
    "Ride On Montgomery County": "30051", "Metro Transit Minneapolis": "50027", "TheBus Honolulu": "90002",
    "Pittsburgh Regional Transit": "30022", "PRT": "30022", "Milwaukee County Transit": "50008",
    "Cleveland RTA": "50015", "Metro St. Louis": "70006", "Bee-Line Westchester": "20076", "NICE Nassau": "20206",
}


def resolve_agency(asked: DataFrame, agencies: DataFrame, brands: DataFrame) -> DataFrame:
    """Asked-for names to reporter ids: brand names by equi-join, the rest by full-name substring.

    ``asked(text)``, ``agencies(ntd_id, agency, city, state)``, ``brands(brand, ntd_id)``. A name can
    only hold a text that shares its rarest three-letter run, so the substring test runs on those
    pairs alone.
    """
    ask = asked.select("text").distinct().withColumn("_k", F.lower(F.trim("text"))).filter("_k <> ''")
    known = brands.select(F.lower("brand").alias("_k"), F.col("ntd_id"))
    hit = ask.join(known, "_k").select("text", "ntd_id", F.lit("brand").alias("matched_by"))
    rest = ask.join(known, "_k", "left_anti")
    names = agencies.select("ntd_id", F.lower("agency").alias("_n")).distinct()
    grams = names.select("ntd_id", "_n", F.explode(F.array_distinct(F.flatten(F.array(
        *[_runs("_n", n) for n in (1, 2, 3)])))).alias("_g"))
    spread = grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    probes = rest.select("text", "_k", F.explode(F.when(F.length("_k") < 3, F.array("_k"))
                                                 .otherwise(_runs("_k", 3))).alias("_g"))
    rarest = (probes.join(spread, "_g", "left").groupBy("text", "_k")
              .agg(F.min_by("_g", F.struct(F.coalesce("_df", F.lit(0)), "_g")).alias("_g")))
    near = (rarest.join(grams, "_g").filter(F.contains("_n", "_k"))
            .select("text", "ntd_id", F.lit("name").alias("matched_by")))
    return hit.unionByName(near)


def _runs(text: str, n: int) -> Column:
    """All n-letter runs of a text."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(
        F.expr("array()").cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(n)))


def cheapest(service: DataFrame, mode: str, n: int) -> DataFrame:
    rows = service.filter((F.col("mode") == mode) & F.col("cost_per_rider").isNotNull())
    return rows.select("ntd_id", "agency", "upt", "cost_per_rider").orderBy("cost_per_rider", "ntd_id").limit(n)


def benchmark_context(df: DataFrame, label: str, measure: str, group: list[str] | None = None) -> DataFrame:
    """Top value of each answer set against the set's exact median: percent, or a multiple from 3x on."""
    group = group or []
    rows = df.filter(F.col(measure).isNotNull()).select(*group, F.col(label).alias("_l"), F.col(measure).alias("_v"))
    top = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("members"),
                                   F.max_by("_l", F.struct("_v", "_l")).alias("top_label"),
                                   F.max("_v").alias("top_value"))
    med = exact_median(rows, group, "_v", "median")
    out = top.join(med, group) if group else top.crossJoin(med)
    ratio = F.col("top_value") / F.nullif(F.abs("median"), F.lit(0.0))
    return out.withColumns({
        "times_median": F.when(ratio >= 3, round_half_up(ratio * 10) / 10),
        "pct_vs_median": F.when(ratio < 3, round_half_up((ratio - 1) * 100).cast("bigint"))}).filter("members > 2")


def series_change(df: DataFrame, measure: str, at: str, group: list[str]) -> DataFrame:
    """First-to-last change of a series in whole percent."""
    ends = df.filter(F.col(measure).isNotNull()).groupBy(*group).agg(
        F.min(at).alias("since"), F.min_by(measure, at).alias("_a"), F.max_by(measure, at).alias("_b"))
    change = round_half_up((F.col("_b") - F.col("_a")) / F.nullif(F.abs("_a"), F.lit(0.0)) * 100).cast("bigint")
    return ends.select(*group, "since", change.alias("change_pct"))
