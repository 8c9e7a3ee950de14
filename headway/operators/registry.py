"""Source and agency registries: merges, health, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.sources import buckets

# fixed values: shape of a keyword-search feed address
SEARCH_BASE = "https://news.google.com/rss/search?q="
SEARCH_TAIL = "&hl=en-US&gl=US&ceid=US:en"
DEFAULT_DAYS = 30
AGENCY_DAYS = 2


def health_fold(fetches: DataFrame) -> DataFrame:
    """Per source: failures since the last success, and the last good figures.

    ``fetches(source_id, at, error, entries, new, queued)``. Both steps are partial aggregates, so a
    source with most of the events is folded map-side.
    """
    ok = F.col("error").isNull()
    good = lambda c: F.max_by(c, F.when(ok & F.col(c).isNotNull(), F.col("at")))
    base = fetches.groupBy("source_id").agg(
        F.max("at").alias("last_fetched_at"), F.max(F.when(ok, F.col("at"))).alias("last_ok_at"),
        F.max(F.when(~ok, F.col("at"))).alias("last_error_at"),
        F.max_by("error", F.when(~ok, F.col("at"))).alias("_error"),
        F.max_by("entries", F.when(ok, F.col("at"))).alias("last_entries"),
        good("new").alias("last_new"), good("queued").alias("last_queued"))
    failed = fetches.filter(~ok).groupBy("source_id", "at").agg(F.count(F.lit(1)).alias("_n"))
    streak = (failed.join(base.select("source_id", "last_ok_at"), "source_id")
              .filter(F.col("last_ok_at").isNull() | (F.col("at") > F.col("last_ok_at")))
              .groupBy("source_id").agg(F.sum("_n").alias("fail_streak")))
    out = base.join(streak, "source_id", "left").withColumn("fail_streak", F.coalesce("fail_streak", F.lit(0)))
    return (out.withColumn("last_error", F.when(F.col("fail_streak") > 0, F.col("_error")))
            .drop("_error"))


def source_stats(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Items, pending, kept, published and newest item per source; sources without items stay."""
    per = items.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status").isin("approved", "published")).alias("kept"),
        F.count_if(F.col("status") == "published").alias("published"), F.max("collected_at").alias("last_item_at"))
    live = sources.filter("deleted_at IS NULL")
    out = live.join(per, live["name"] == per["source_name"], "left").drop("source_name")
    return out.fillna(0, ["items", "pending", "kept", "published"])


def active_sources(sources: DataFrame) -> DataFrame:
    keep = (F.col("method") == "RSS") & F.col("enabled") & F.col("deleted_at").isNull()
    return sources.filter(keep).orderBy("id")


REGISTRY_FIELDS = ("url", "pillar", "type", "method", "trust", "notes", "query", "search_days")
RETIRED_NOTE = "No longer in SEARCH_QUERIES."


def merge_registry(new: DataFrame, old: DataFrame) -> DataFrame:
    """Outcome of syncing the registry into the stored sources, by lower-cased name: added, updated,
    kept (made, edited or deleted by a person), retired (a vanished search) or untouched."""
    n = new.select(F.lower("name").alias("_k"), F.struct("name", *REGISTRY_FIELDS).alias("n"))
    o = old.select(F.lower("name").alias("_k"), F.struct(*old.columns).alias("o"))
    both = n.join(o, "_k", "full_outer")
    mine = (F.col("o.origin") != "registry") | F.col("o.edited_at").isNotNull() | F.col("o.deleted_at").isNotNull()
    gone = (F.col("n").isNull() & (F.col("o.type") == "Search") & ~mine & (F.col("o.method") != "Retired"))
    outcome = (F.when(F.col("o").isNull(), "added").when(F.col("n").isNotNull() & mine, "kept")
               .when(F.col("n").isNotNull(), "updated").when(gone, "retired").otherwise("untouched"))
    take = outcome.isin("added", "updated")
    fields = [F.when(take, F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in REGISTRY_FIELDS]
    rows = both.select(F.col("o.id").alias("id"), F.coalesce("o.name", "n.name").alias("name"), *fields,
                       F.coalesce("o.origin", F.lit("registry")).alias("origin"),
                       F.coalesce("o.enabled", F.lit(True)).alias("enabled"), F.col("o.edited_at").alias("edited_at"),
                       F.col("o.deleted_at").alias("deleted_at"), outcome.alias("outcome"))
    retired = F.col("outcome") == "retired"
    return rows.withColumns({"method": F.when(retired, "Retired").otherwise(F.col("method")),
                             "notes": F.when(retired, RETIRED_NOTE).otherwise(F.col("notes"))})


def outcome_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


AGENCY_FIELDS = ("name", "state", "ntd_id", "cig_sponsor", "website", "newsroom", "procurement_url")


def merge_agencies(new: DataFrame, old: DataFrame) -> DataFrame:
    """Upsert by lower-cased name. The reference wins on its own fields; ``search_enabled`` is taken
    from the reference only when the row is new."""
    empty = F.expr("array()").cast("array<string>")
    n = new.select(F.lower("name").alias("_k"), *[F.nullif(F.col(f), F.lit("")).alias(f"n_{f}") for f in AGENCY_FIELDS],
                   F.coalesce("aliases", empty).alias("n_aliases"),
                   F.coalesce("search_enabled", F.lit(False)).alias("n_search"), F.lit(True).alias("_n"))
    o = old.withColumn("_k", F.lower("name")).withColumn("_o", F.lit(True))
    both = n.join(o, "_k", "full_outer")
    pick = lambda f: F.when(F.col("_n"), F.col(f"n_{f}")).otherwise(F.col(f)).alias(f)
    outcome = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "untouched").otherwise("updated")
    return both.select(*[pick(f) for f in (*AGENCY_FIELDS, "aliases")],
                       F.coalesce("search_enabled", "n_search").alias("search_enabled"), outcome.alias("outcome"))


def merge_stored_agencies(path: str, schema: T.StructType, new: DataFrame, count: int = buckets.BUCKETS) -> list[int]:
    """``merge_agencies`` into an agency table stored in buckets of the lower-cased name."""
    return buckets.merge(new, path, schema, F.lower("name"), F.lower("name"), merge_agencies, count)


def agency_query(name: Column, days: int = AGENCY_DAYS) -> Column:
    return F.format_string(f'"%s" transit when:{days}d', name)


def search_url(query: Column) -> Column:
    return F.concat(F.lit(SEARCH_BASE), F.url_encode(query), F.lit(SEARCH_TAIL))


def agency_searches(agencies: DataFrame, sources: DataFrame, days: int = AGENCY_DAYS, activate: bool = False) -> DataFrame:
    """One search row per search-enabled agency, kept in step with stored rows nobody has edited."""
    want = agencies.select(F.concat(F.lit("Agency: "), "name").alias("name"), agency_query(F.col("name"), days).alias("query"),
                           "search_enabled").withColumn("url", search_url(F.col("query"))).withColumn("_k", F.lower("name"))
    have = sources.select(F.lower("name").alias("_k"), F.col("enabled").alias("was_enabled"), F.col("query").alias("_q"),
                          F.col("url").alias("_u"), F.col("edited_at").isNotNull().alias("edited"), F.lit(True).alias("_h"))
    both = want.join(have, "_k", "left").filter(F.col("_h").isNotNull() | F.col("search_enabled"))
    edited = F.coalesce("edited", F.lit(False))
    switch_off = F.col("was_enabled") & ~F.col("search_enabled") & ~edited
    outcome = F.when(F.col("_h").isNull(), "added").when(edited, "kept").otherwise("updated")
    enabled = (F.when(F.col("_h").isNull(), F.col("search_enabled") & F.lit(activate)).when(switch_off, False)
               .otherwise(F.col("was_enabled")))
    return both.select("name", F.when(edited, F.col("_q")).otherwise(F.col("query")).alias("query"),
                       F.when(edited, F.col("_u")).otherwise(F.col("url")).alias("url"), enabled.alias("enabled"),
                       outcome.alias("outcome"), F.coalesce(switch_off, F.lit(False)).alias("disabled"))


def split_search(text: Column | str) -> Column:
    """'words when:21d' -> struct(text, days); 30 days when nothing is said."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    days = F.regexp_extract(t, r"^.*?\s+when:(\d+)d\s*$", 1)
    words = F.when(days != "", F.regexp_extract(t, r"^(.*?)\s+when:\d+d\s*$", 1)).otherwise(t)
    return F.struct(words.alias("text"), F.coalesce(F.nullif(days, F.lit("")).try_cast("int"), F.lit(DEFAULT_DAYS)).alias("days"))


def search_text(text: Column | str, days: Column) -> Column:
    """struct(name, url) of a keyword search."""
    words = split_search(text)["text"]
    return F.struct(F.concat(F.lit("Google News: "), words).alias("name"),
                    search_url(F.concat(words, F.lit(" when:"), days.cast("string"), F.lit("d"))).alias("url"))


def search_of_url(url: Column | str) -> Column:
    """The search a feed address stands for."""
    # a plus stands for a blank inside a query value
    q = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("q")))
    return split_search(F.coalesce(q, F.lit("")))


def match_agency(names: DataFrame, agencies: DataFrame) -> DataFrame:
    """Each name to its reference agency by name, alias or sponsor; the first by name order."""
    keys = agencies.select(F.col("name").alias("agency"), F.explode(F.concat(
        F.array("name", F.coalesce("cig_sponsor", F.lit(""))),
        F.coalesce("aliases", F.expr("array()").cast("array<string>")))).alias("_a"))
    dim = keys.select(F.lower("_a").alias("_k"), "agency").filter("_k <> ''").groupBy("_k").agg(F.min("agency").alias("agency"))
    return (names.withColumn("_k", F.lower(F.trim("text"))).join(dim, "_k", "left").drop("_k"))
