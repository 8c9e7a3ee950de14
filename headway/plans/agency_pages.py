"""All agency documents from one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.columns import slug
from headway.operators import mart


def agency_documents(service: DataFrame, history: DataFrame, min_upt: float, min_years: int) -> DataFrame:
    """One nested document per qualifying agency: head, totals, ranks, modes and yearly trend."""
    picked = mart.qualifying(service, history, min_upt, min_years)
    modes = mart.agency_modes(service)
    ranks = mart.mode_rank(service).select("ntd_id", "mode", "mode_rank_by_upt")
    compared = mart.vs_median(modes, mart.mode_context(service)).join(ranks, ["ntd_id", "mode"])
    trend = mart.agency_trend(history)
    years = trend.groupBy("ntd_id").agg(F.sort_array(F.collect_list(F.struct(
        "year", "upt", "opex_real", "cost_per_rider_real"))).alias("trend"))
    return (mart.national_rank(picked).drop("upt")
            .join(mart.agency_head(service).filter("agency <> ''"), "ntd_id")
            .join(mart.agency_totals(modes), "ntd_id")
            .join(mart.state_rank(service).select("ntd_id", "state_rank_by_upt"), "ntd_id")
            .join(mart.agency_mode_list(compared), "ntd_id")
            .join(years, "ntd_id")
            .withColumn("slug", slug("agency", "ntd_id")))


def document_meta(service: DataFrame, history: DataFrame, min_upt: float, min_years: int) -> DataFrame:
    """Scalar metadata of the export."""
    count = mart.qualifying(service, history, min_upt, min_years).agg(F.count(F.lit(1)).alias("agencies_qualifying"))
    return count.crossJoin(service.agg(F.max("report_year").alias("year"))).select(
        "year", F.lit(min_upt).alias("min_upt"), F.lit(min_years).alias("min_years"), "agencies_qualifying")


def build_mart(long: DataFrame, index: DataFrame, labels: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long rows of text to (history, latest service, deflator)."""
    history = mart.pivot_history(mart.clean_keys(long), labels)
    cpi = mart.deflator(history, index)
    full = mart.with_real(mart.with_ratios(history), cpi)
    return full, mart.latest_service(full), cpi
