"""Queries over the annual mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions.columns import round_to
from headway.operators import mart
from headway.plans.catalog import common, query
from headway.plans.stand_ins import INDEX, LABELS, specs
from headway.sources import readers

_case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())


def rnd(expr: str, places: int) -> str:
    """SQL text of the binary rounding used by the operators."""
    scale = float(10 ** places)
    return f"(round(({expr}) * {scale}) / {scale})"


common("facts", """
  SELECT l_suppkey, upper(p_type) AS mode_code, year(l_shipdate)::INTEGER AS report_year, l_returnflag AS tos,
         sum(l_quantity) AS upt, sum(round(l_extendedprice)) AS operating_expense,
         sum(round(l_extendedprice * l_discount)) AS fares, sum(l_quantity * l_linenumber) AS passenger_miles,
         sum(l_linenumber::DOUBLE) AS vehicle_revenue_hours
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4""")
common("base_history", f"""
  SELECT s_suppkey::VARCHAR AS ntd_id, s_name AS agency, r_name AS city, n_name AS state, mode_code,
         CASE mode_code {_case} ELSE mode_code END AS mode, report_year,
         sum(upt) AS upt, sum(operating_expense) AS operating_expense, sum(fares) AS fares,
         sum(passenger_miles) AS passenger_miles, sum(vehicle_revenue_hours) AS vehicle_revenue_hours
  FROM facts JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
       JOIN region ON r_regionkey = n_regionkey
  GROUP BY 1, 2, 3, 4, 5, 6, 7""", "facts")
common("idx", "SELECT * FROM (VALUES " + ", ".join(f"({y}, {v}::DOUBLE)" for y, v in INDEX.items())
       + ") t(year, cpi_u)")
common("cpi", """
  SELECT year, cpi_u, (SELECT max(report_year) FROM base_history WHERE report_year IN (SELECT year FROM idx)) AS base_year,
         round((SELECT max_by(cpi_u, year) FROM idx WHERE year IN (SELECT report_year FROM base_history)) / cpi_u, 6)
           AS factor_to_base
  FROM idx""", "base_history", "idx")
common("history", f"""
  SELECT h.*, {rnd('CASE WHEN upt > 0 THEN operating_expense / upt END', 2)} AS cost_per_rider,
         {rnd('CASE WHEN operating_expense > 0 THEN fares / operating_expense END', 4)} AS fare_recovery,
         {rnd('CASE WHEN vehicle_revenue_hours > 0 THEN operating_expense / vehicle_revenue_hours END', 2)}
           AS cost_per_revenue_hour,
         {rnd('CASE WHEN upt > 0 THEN passenger_miles / upt END', 2)} AS avg_trip_miles,
         base_year AS real_dollar_year, factor_to_base AS cpi_factor,
         round(operating_expense * factor_to_base) AS operating_expense_real,
         round(fares * factor_to_base) AS fares_real,
         {rnd('CASE WHEN upt > 0 THEN operating_expense * factor_to_base / upt END', 2)} AS cost_per_rider_real,
         {rnd('CASE WHEN vehicle_revenue_hours > 0 THEN operating_expense * factor_to_base / vehicle_revenue_hours END', 2)}
           AS cost_per_revenue_hour_real
  FROM base_history h LEFT JOIN cpi ON year = report_year""", "base_history", "cpi")
common("service", """
  SELECT * FROM history WHERE report_year IS NOT DISTINCT FROM (SELECT max(report_year) FROM history)
    AND upt > 0 AND operating_expense IS NOT NULL""", "history")
common("specs", "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', '{m}', '{k}', '{o}', {f}::DOUBLE)" for s, m, k, o, f in specs())
    + ") t(ranking, mode, metric, direction, floor)")
common("candidates", """
  SELECT ranking, mode, metric, direction, ntd_id, agency, city, state, upt, cost_per_rider, fare_recovery,
         CASE metric WHEN 'cost_per_rider' THEN cost_per_rider WHEN 'upt' THEN upt ELSE fare_recovery END AS metric_value,
         row_number() OVER (PARTITION BY ranking ORDER BY CASE WHEN direction = 'asc' THEN 1 ELSE -1 END *
           CASE metric WHEN 'cost_per_rider' THEN cost_per_rider WHEN 'upt' THEN upt ELSE fare_recovery END, ntd_id) AS rank
  FROM service JOIN specs USING (mode)
  WHERE upt >= floor AND upt > 0 AND operating_expense > 0
    AND CASE metric WHEN 'cost_per_rider' THEN cost_per_rider WHEN 'upt' THEN upt ELSE fare_recovery END IS NOT NULL
  """, "service", "specs")
_slug = """coalesce(nullif(substr(regexp_replace(regexp_replace(lower(agency), '[^\\p{L}\\p{N}]+', '-', 'g'),
  '^-|-$', '', 'g'), 1, 60), ''), 'agency') || '-' || ntd_id"""
common("ranked", f"""
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ranking) AS of, {_slug} AS slug FROM candidates WHERE rank <= 40)
  WHERE of >= 5""", "candidates")
common("trend", """
  SELECT ntd_id, report_year AS year, sum(upt) AS upt, sum(operating_expense_real) AS opex_real,
         CASE WHEN sum(upt) > 0 THEN sum(operating_expense_real) / sum(upt) END AS cost_per_rider_real
  FROM history WHERE upt > 0 AND operating_expense > 0 GROUP BY 1, 2""", "history")
common("context", """
  SELECT mode, count(*) AS agencies, median(cost_per_rider) AS median_cost_per_rider,
         median(fare_recovery) AS median_fare_recovery, median(cost_per_revenue_hour) AS median_cost_per_revenue_hour,
         sum(upt) AS total_upt
  FROM service WHERE upt > 0 AND operating_expense > 0 GROUP BY mode""", "service")
common("totals", """
  SELECT ntd_id, sum(coalesce(upt, 0)) AS total_upt, sum(coalesce(operating_expense, 0)) AS total_opex,
         nullif(sum(coalesce(fares, 0)), 0) AS total_fares
  FROM service WHERE upt > 0 AND operating_expense > 0 GROUP BY 1""", "service")
common("long_rows", """
  SELECT s_suppkey::VARCHAR AS ntd_id, s_name AS agency, r_name AS city, n_name AS state, mode_code, report_year, tos,
         unnest(['upt', 'operating_expense', 'fares', 'passenger_miles', 'vehicle_revenue_hours']) AS measure,
         unnest([upt, operating_expense, fares, passenger_miles, vehicle_revenue_hours]) AS value
  FROM facts JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
       JOIN region ON r_regionkey = n_regionkey""", "facts")

HIST = ["ntd_id", "agency", "city", "state", "mode_code", "mode", "report_year", "upt", "operating_expense", "fares",
        "passenger_miles", "vehicle_revenue_hours"]


# ---- shaping ------------------------------------------------------------------------------------

@query("long_records", "SELECT measure, count(*) AS records, sum(value) AS total FROM long_rows WHERE report_year >= 1997 "
       "GROUP BY measure", ("long_rows",))
def long_records(t):
    """Known measures since a year, renamed and typed from text."""
    rows = readers.known_measures(t.long_facts, list(mart.MEASURES), since=1997)
    return (mart.clean_keys(mart.long_keys(rows)).groupBy("measure")
            .agg(F.count(F.lit(1)).alias("records"), F.sum("value").alias("total")))


@query("lenient_numbers", "SELECT l_orderkey, l_linenumber, l_quantity AS plain, "
       "round(l_extendedprice) AS money, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_tax END AS coded FROM lineitem")
def lenient_numbers(t):
    from headway.functions.columns import to_number
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("a"),
        F.concat(F.lit("$ "), F.format_number(F.round("l_extendedprice"), 0)).alias("b"),
        F.when(F.col("l_returnflag") == "A", "n/a").otherwise(F.col("l_tax").cast("string")).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", to_number("a").alias("plain"), to_number("b").alias("money"),
                       to_number("c").alias("coded"))


@query("unpivot_flat", "SELECT mode_code, measure, count(*) AS n, sum(value) AS total FROM long_rows "
       "WHERE measure IN ('upt', 'operating_expense') GROUP BY 1, 2", ("long_rows",))
def unpivot_flat(t):
    """Flat columns found by keyword, unpivoted, then summed."""
    flat = t.facts.join(t.places, "l_suppkey").select(
        F.col("ntd_id").alias("NTD ID"), F.col("agency").alias("Agency"), F.col("city").alias("City"),
        F.col("state").alias("State"), F.col("mode_code").alias("Mode"), F.col("report_year").alias("Report Year"),
        F.col("upt").alias("Unlinked Passenger Trips"), F.col("operating_expense").alias("Total Operating Expenses"))
    tall = mart.clean_keys(mart.melt(flat))
    return tall.groupBy("mode_code", "measure").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("measure_names", "SELECT measure, mode_code, count(*) AS n FROM long_rows GROUP BY 1, 2", ("long_rows",))
def measure_names(t):
    return (mart.map_measures(t.long_facts).groupBy("measure", F.upper("mode").alias("mode_code"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("clean_keys", "SELECT ntd_id, agency, city, state, mode_code, report_year, tos, measure, value FROM long_rows",
       ("long_rows",))
def clean_keys(t):
    long = mart.map_measures(t.long_facts).select(
        "ntd_id", F.col("agency_name").alias("agency"), "city", "state", F.col("mode").alias("mode_code"),
        "report_year", "tos", "measure", "value")
    return mart.clean_keys(long)


@query("pivot_history", f"SELECT {', '.join(HIST)} FROM base_history", ("base_history",))
def pivot_history(t):
    long = mart.clean_keys(mart.long_keys(t.long_facts))
    return mart.pivot_history(long, LABELS).select(*HIST)


@query("label_mode", "SELECT mode_code, mode, count(*) AS n FROM base_history GROUP BY 1, 2", ("base_history",))
def label_mode(t):
    return t.base_history.groupBy("mode_code", "mode").agg(F.count(F.lit(1)).alias("n"))


@query("deflator", "SELECT year, cpi_u, base_year, factor_to_base FROM cpi", ("cpi",))
def deflator(t):
    return t.cpi


@query("missing_index_years", "SELECT DISTINCT report_year FROM base_history WHERE report_year NOT IN "
       "(SELECT year FROM idx)", ("base_history", "idx"))
def missing_index_years(t):
    return mart.missing_index_years(t.base_history, t.index)


@query("guarded_ratios", "SELECT ntd_id, mode_code, report_year, cost_per_rider, fare_recovery, cost_per_revenue_hour, "
       "avg_trip_miles FROM history", ("history",))
def guarded_ratios(t):
    return mart.with_ratios(t.base_history).select("ntd_id", "mode_code", "report_year", "cost_per_rider",
                                                   "fare_recovery", "cost_per_revenue_hour", "avg_trip_miles")


_real = ("ntd_id, mode_code, report_year, real_dollar_year, cpi_factor, operating_expense_real, fares_real, "
         "cost_per_rider_real, cost_per_revenue_hour_real")


@query("real_dollars", f"SELECT {_real} FROM history", ("history",))
def real_dollars(t):
    return t.history.select(*_real.split(", "))


@query("latest_service", "SELECT ntd_id, agency, mode, report_year, upt, operating_expense, cost_per_rider FROM service",
       ("service",))
def latest_service(t):
    return t.service.select("ntd_id", "agency", "mode", "report_year", "upt", "operating_expense", "cost_per_rider")


@query("ordered_history", "SELECT report_year, ntd_id, mode_code, upt FROM history ORDER BY 1, 2, 3", ("history",))
def ordered_history(t):
    return mart.order_history(t.history).select("report_year", "ntd_id", "mode_code", "upt")


# ---- analytics ----------------------------------------------------------------------------------

@query("by_mode", f"SELECT mode, count(*) AS agencies, {rnd('avg(cost_per_rider)', 2)} AS avg_cost_per_rider "
       "FROM service GROUP BY mode", ("service",))
def by_mode(t):
    return mart.by_mode(t.service)


@query("national_trend", f"""
  SELECT report_year, count(*) AS agency_modes, {rnd('sum(upt) / 1e6', 1)} AS upt_millions,
         {rnd('sum(operating_expense) / 1e9', 2)} AS opex_billions,
         {rnd('sum(operating_expense_real) / 1e9', 2)} AS opex_billions_real,
         {rnd('sum(operating_expense) / sum(upt)', 2)} AS cost_per_rider,
         {rnd('sum(operating_expense_real) / sum(upt)', 2)} AS cost_per_rider_real
  FROM history WHERE upt > 0 AND operating_expense IS NOT NULL GROUP BY report_year""", ("history",))
def national_trend(t):
    return mart.national_trend(t.history)


@query("mart_health", "SELECT count(*) AS history_rows, min(report_year) AS first_year, max(report_year) AS last_year, "
       "(SELECT count(*) FROM service) AS service_rows FROM history", ("history", "service"))
def mart_health(t):
    return mart.mart_health(t.stored, t.service)


@query("mode_context", f"""
  SELECT mode, agencies, total_upt, {rnd('median_cost_per_rider', 6)} AS median_cost_per_rider,
         {rnd('median_fare_recovery', 6)} AS median_fare_recovery,
         {rnd('median_cost_per_revenue_hour', 6)} AS median_cost_per_revenue_hour FROM context""", ("context",))
def mode_context(t):
    ctx = mart.mode_context(t.service)
    return ctx.select("mode", "agencies", "total_upt",
                      *[round_to(f"median_{r}", 6).alias(f"median_{r}") for r in mart.CONTEXT_RATIOS])


common("picked", """
  SELECT t.ntd_id, t.upt, h.years FROM
    (SELECT ntd_id, sum(upt) AS upt FROM service WHERE upt > 0 AND operating_expense > 0 GROUP BY 1) t
    JOIN (SELECT ntd_id, count(DISTINCT report_year) AS years FROM history
          WHERE upt > 0 AND operating_expense > 0 GROUP BY 1) h USING (ntd_id)
  WHERE t.upt >= 1000 AND h.years >= 3""", "service", "history")


@query("qualifying_agencies", "SELECT * FROM picked", ("picked",))
def qualifying_agencies(t):
    return mart.qualifying(t.service, t.stored, 1000, 3)


@query("qualifying_top", "SELECT * FROM picked ORDER BY upt DESC, ntd_id LIMIT 20", ("picked",))
def qualifying_top(t):
    return mart.qualifying(t.service, t.stored, 1000, 3, top=20)


@query("national_rank", "SELECT ntd_id, upt, row_number() OVER (ORDER BY upt DESC, ntd_id) AS national_rank_by_upt "
       "FROM picked", ("picked",))
def national_rank(t):
    return mart.national_rank(mart.qualifying(t.service, t.stored, 1000, 3))


@query("agency_head", "SELECT ntd_id, min(agency) AS agency, min(city) AS city, min(state) AS state FROM service "
       "GROUP BY 1", ("service",))
def agency_head(t):
    return mart.agency_head(t.service)


@query("agency_mode_list", """
  SELECT ntd_id, string_agg(mode || ':' || upt::BIGINT::VARCHAR, '|' ORDER BY upt DESC, mode) AS modes
  FROM service WHERE upt > 0 AND operating_expense > 0 GROUP BY 1""", ("service",))
def agency_mode_list(t):
    nested = mart.agency_mode_list(mart.agency_modes(t.service))
    text = F.transform("modes", lambda m: F.concat_ws(":", m["mode"], m["upt"].cast("bigint").cast("string")))
    return nested.select("ntd_id", F.array_join(text, "|").alias("modes"))


@query("agency_trend", f"SELECT ntd_id, year, upt, opex_real, {rnd('cost_per_rider_real', 6)} AS cost_per_rider_real "
       "FROM trend", ("trend",))
def agency_trend(t):
    return mart.agency_trend(t.history).withColumn("cost_per_rider_real", round_to("cost_per_rider_real", 6))


@query("agency_totals", f"""
  SELECT ntd_id, total_upt, total_opex, total_fares, {rnd('total_opex / nullif(total_upt, 0)', 6)} AS cost_per_rider,
         {rnd('total_fares / nullif(total_opex, 0)', 6)} AS fare_recovery FROM totals""", ("totals",))
def agency_totals(t):
    rows = mart.agency_totals(mart.agency_modes(t.service))
    return rows.withColumns({c: round_to(c, 6) for c in ("cost_per_rider", "fare_recovery")})


@query("vs_median", f"""
  SELECT ntd_id, mode, cost_per_rider, {rnd('median_cost_per_rider', 6)} AS mode_median_cost_per_rider,
         agencies AS mode_agencies,
         round_even((cost_per_rider - median_cost_per_rider) / median_cost_per_rider * 100, 0)::BIGINT AS vs_mode_median_pct
  FROM service JOIN context USING (mode) WHERE upt > 0 AND operating_expense > 0""", ("service", "context"))
def vs_median(t):
    rows = mart.vs_median(mart.agency_modes(t.service), mart.mode_context(t.service))
    return rows.select("ntd_id", "mode", "cost_per_rider",
                       round_to("mode_median_cost_per_rider", 6).alias("mode_median_cost_per_rider"),
                       "mode_agencies", "vs_mode_median_pct")


@query("mode_rank", "SELECT ntd_id, mode, report_year, upt, rank() OVER (PARTITION BY report_year, mode ORDER BY upt DESC) "
       "AS mode_rank_by_upt FROM service WHERE upt > 0", ("service",))
def mode_rank(t):
    return mart.mode_rank(t.service)


@query("state_rank", """
  SELECT o.ntd_id, o.state, o.v AS total_upt, 1 + count(a.v) AS state_rank_by_upt FROM
   (SELECT ntd_id, min(state) AS state, sum(upt) AS v FROM service WHERE upt > 0 AND operating_expense > 0 GROUP BY 1) o
   LEFT JOIN (SELECT ntd_id, state, sum(upt) AS v FROM service WHERE upt > 0 GROUP BY 1, 2) a
     ON a.state = o.state AND a.v > o.v
  GROUP BY 1, 2, 3""", ("service",))
def state_rank(t):
    return mart.state_rank(t.service)


@query("agency_slugs", f"SELECT ntd_id, {_slug} AS slug FROM (SELECT DISTINCT ntd_id, agency FROM history)", ("history",))
def agency_slugs(t):
    from headway.functions.columns import slug
    return t.history.select("ntd_id", "agency").distinct().select("ntd_id", slug("agency", "ntd_id").alias("slug"))


_ranked = ("ranking, mode, metric, direction, rank, of, ntd_id, agency, city, state, upt, cost_per_rider, fare_recovery, "
           "metric_value, slug")


@query("curated_rankings", f"SELECT {_ranked} FROM ranked", ("ranked",))
def curated_rankings(t):
    return t.ranked


@query("rankings_for_agency", "SELECT slug, string_agg(ranking || ' ' || rank || '/' || of, '|' ORDER BY ranking) "
       "AS rankings FROM ranked GROUP BY 1", ("ranked",))
def rankings_for_agency(t):
    text = F.transform("rankings", lambda r: F.format_string("%s %d/%d", r["ranking"], r["rank"], r["of"]))
    return mart.rankings_for(t.ranked).select("slug", F.array_join(text, "|").alias("rankings"))


@query("recovery", """
  SELECT t.ntd_id, t.year, n.years, floor((t.upt / b.upt - 1) * 100 + 0.5)::BIGINT AS vs_base_pct,
         p.year AS prior_year, floor((t.upt / p.upt - 1) * 100 + 0.5)::BIGINT AS vs_prior_pct
  FROM trend t JOIN (SELECT ntd_id, max(year) AS y, count(*) AS years FROM trend GROUP BY 1) n
         ON n.ntd_id = t.ntd_id AND n.y = t.year
       LEFT JOIN trend b ON b.ntd_id = t.ntd_id AND b.year = 1998
       LEFT JOIN (SELECT a.ntd_id, max(a.year) AS y FROM trend a JOIN (SELECT ntd_id, max(year) AS m FROM trend GROUP BY 1) q
                    ON q.ntd_id = a.ntd_id AND a.year < q.m GROUP BY 1) py ON py.ntd_id = t.ntd_id
       LEFT JOIN trend p ON p.ntd_id = t.ntd_id AND p.year = py.y""", ("trend",))
def recovery(t):
    return mart.recovery(mart.agency_trend(t.history), 1998)


@query("trend_extent", """
  SELECT ntd_id, count(*) AS points, min(year) AS first_year, min_by(upt, year) AS first_value, max(year) AS last_year,
         max_by(upt, year) AS last_value, min(upt) AS low, max(upt) AS high
  FROM trend GROUP BY 1 HAVING count(*) >= 3""", ("trend",))
def trend_extent(t):
    return mart.trend_extent(mart.agency_trend(t.history), "upt")


@query("ranking_spread", f"""
  SELECT ranking, max(CASE WHEN lo = 1 THEN agency END) AS cheapest, min(metric_value) AS low,
         max(CASE WHEN hi = 1 THEN agency END) AS dearest, max(metric_value) AS high,
         {rnd('max(metric_value) / nullif(min(metric_value), 0)', 1)} AS spread
  FROM (SELECT *, row_number() OVER (PARTITION BY ranking ORDER BY metric_value, rank) AS lo,
               row_number() OVER (PARTITION BY ranking ORDER BY metric_value DESC, rank DESC) AS hi
        FROM ranked WHERE metric = 'cost_per_rider') GROUP BY 1""", ("ranked",))
def ranking_spread(t):
    return mart.ranking_spread(t.ranked)


common("pages_by_state", "SELECT ntd_id, state, total_upt, total_opex FROM totals JOIN "
       "(SELECT ntd_id, min(state) AS state FROM service GROUP BY 1) USING (ntd_id)", "totals", "service")


def _state_pages(t):
    return mart.agency_totals(mart.agency_modes(t.service)).join(mart.agency_head(t.service), "ntd_id")


@query("state_index", "SELECT ntd_id, state, total_upt, total_opex, row_number() OVER (PARTITION BY state ORDER BY "
       "total_upt DESC, ntd_id) AS place_in_state FROM pages_by_state", ("pages_by_state",))
def state_index(t):
    return mart.state_index(_state_pages(t))


@query("index_totals", "SELECT count(*) AS agencies, count(DISTINCT state) AS states, sum(total_upt) AS total_trips, "
       "sum(total_opex) AS total_opex FROM pages_by_state", ("pages_by_state",))
def index_totals(t):
    return mart.index_totals(_state_pages(t))


@query("rankings_by_mode", "SELECT mode, ranking, agency AS leader, of, count(*) OVER (PARTITION BY mode) AS rankings_in_mode "
       "FROM ranked WHERE rank = 1", ("ranked",))
def rankings_by_mode(t):
    return mart.rankings_by_mode(t.ranked)


@query("agency_series", f"SELECT ntd_id, report_year, sum(upt) AS upt, "
       f"{rnd('sum(operating_expense_real) / sum(upt)', 2)} AS cost_per_rider_real "
       "FROM history WHERE upt > 0 AND report_year >= 1996 GROUP BY 1, 2", ("history",))
def agency_series(t):
    return mart.agency_series(t.history, since=1996)


@query("agency_mode_series", "SELECT ntd_id, report_year, mode, cost_per_rider_real FROM history WHERE report_year >= 1996",
       ("history",))
def agency_mode_series(t):
    return mart.agency_mode_series(t.history, since=1996)


@query("balanced_panel", """
  SELECT report_year, count(DISTINCT ntd_id) AS agencies, sum(upt) AS upt FROM history
  WHERE upt > 0 AND report_year IN (1996, 1998, 2000) AND ntd_id IN
    (SELECT ntd_id FROM history WHERE upt > 0 AND report_year IN (1996, 1998, 2000)
     GROUP BY 1 HAVING count(DISTINCT report_year) = 3) GROUP BY 1""", ("history",))
def balanced_panel(t):
    return (mart.balanced_panel(t.history, [1996, 1998, 2000]).groupBy("report_year")
            .agg(F.countDistinct("ntd_id").alias("agencies"), F.sum("upt").alias("upt")))


@query("resolve_agency", """
  SELECT a.text, s_suppkey::VARCHAR AS ntd_id, CASE WHEN lower(s_name) = lower(trim(a.text)) THEN 'brand' ELSE 'name' END
           AS matched_by
  FROM (SELECT DISTINCT replace(c_name, 'Customer', 'Supplier') AS text FROM customer
        UNION SELECT DISTINCT right(c_name, 4) FROM customer) a
  JOIN supplier ON CASE WHEN lower(trim(a.text)) IN (SELECT lower(s_name) FROM supplier)
                        THEN lower(s_name) = lower(trim(a.text)) ELSE contains(lower(s_name), lower(trim(a.text))) END""")
def resolve_agency(t):
    asked = (t.customer.select(F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supplier")).alias("text"))
             .union(t.customer.select(F.right("c_name", F.lit(4)))))
    brands = t.supplier.select(F.col("s_name").alias("brand"), F.col("s_suppkey").cast("string").alias("ntd_id"))
    return mart.resolve_agency(asked, t.places, brands)


@query("cheapest_in_mode", "SELECT ntd_id, agency, upt, cost_per_rider FROM service WHERE mode = 'Bus' "
       "ORDER BY cost_per_rider, ntd_id LIMIT 10", ("service",))
def cheapest_in_mode(t):
    return mart.cheapest(t.service, "Bus", 10)


@query("benchmark_context", f"""
  SELECT mode, members, top_label, top_value, {rnd('med', 6)} AS median,
         CASE WHEN top_value / abs(med) >= 3 THEN floor(top_value / abs(med) * 10 + 0.5) / 10 END AS times_median,
         CASE WHEN top_value / abs(med) < 3 THEN floor((top_value / abs(med) - 1) * 100 + 0.5)::BIGINT END AS pct_vs_median
  FROM (SELECT mode, count(*) AS members, max_by(ntd_id, upt) AS top_label0, max(upt) AS top_value, median(upt) AS med
        FROM service GROUP BY 1)
       JOIN (SELECT mode, ntd_id AS top_label FROM (SELECT mode, ntd_id, row_number() OVER (PARTITION BY mode
             ORDER BY upt DESC, ntd_id DESC) AS r FROM service) WHERE r = 1) USING (mode) WHERE members > 2""",
       ("service",))
def benchmark_context(t):
    out = mart.benchmark_context(t.service, "ntd_id", "upt", ["mode"])
    return out.withColumn("median", round_to("median", 6))


@query("series_change", """
  SELECT ntd_id, min(year) AS since,
         floor((max_by(upt, year) - min_by(upt, year)) / abs(min_by(upt, year)) * 100 + 0.5)::BIGINT AS change_pct
  FROM trend GROUP BY 1""", ("trend",))
def series_change(t):
    return mart.series_change(mart.agency_trend(t.history), "upt", "year", ["ntd_id"])


@query("agency_documents", f"""
  SELECT ntd_id, {rnd('total_opex / total_upt', 6)} AS cost_per_rider, modes, years, top_mode FROM totals
  JOIN (SELECT ntd_id, count(*) AS modes, max_by(mode, upt) AS top_mode FROM service
        WHERE upt > 0 AND operating_expense > 0 GROUP BY 1) USING (ntd_id)
  JOIN (SELECT ntd_id, count(*) AS years FROM trend GROUP BY 1) USING (ntd_id)
  WHERE ntd_id IN (SELECT ntd_id FROM picked)""", ("totals", "service", "trend", "picked"))
def agency_documents(t):
    from headway.plans.agency_pages import agency_documents as build
    docs = build(t.service, t.stored, 1000, 3)
    return docs.select("ntd_id", round_to("cost_per_rider", 6).alias("cost_per_rider"),
                       F.size("modes").cast("bigint").alias("modes"), F.size("trend").cast("bigint").alias("years"),
                       F.col("modes")[0]["mode"].alias("top_mode"))
