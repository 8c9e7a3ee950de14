"""Snapshot history of capital-grant projects: intake, comparison and listings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.columns import clean_money, date_from_name, first_rule

KEY = ["project_name", "sponsor"]

# fixed values
PHASES = ("PD", "Eng", "Const", "FFGA", "CGA")
PHASE_ORDER = {"PD": 1, "Eng": 2, "FFGA": 3, "CGA": 3, "Const": 4}
STATE_PAIR = "^[A-Z]{2}(-[A-Z]{2})?$"
# fixed values: compared field -> (label, place in the report)
CHANGE_FIELDS = {
    "phase": ("phase", 2), "rating": ("rating", 3), "cost_musd": ("cost", 6),
    "cig_request_musd": ("CIG request", 5), "cig_share": ("CIG share", 7),
    "est_grant": ("est. grant", 4), "noncig_status": ("local match", 8),
}
MONEY = ("cost_musd", "cig_request_musd")
# fixed values: sort ranks
RATING_RANK = {"H": 5, "MH": 4, "M": 3, "ML": 2, "L": 1}
PHASE_RANK = {"PD": 1, "Eng": 2, "Const": 3, "FFGA": 4, "CGA": 5}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december")
SEASONS = {"early": 0.15, "winter": 0.1, "spring": 0.3, "mid": 0.5, "summer": 0.55, "fall": 0.75,
           "autumn": 0.75, "late": 0.9}


# ---- intake -------------------------------------------------------------------------------------

def valid_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("state").rlike(STATE_PAIR) & F.col("phase").isin(*PHASES))


def with_money(parsed: DataFrame) -> DataFrame:
    """Numeric money beside the raw text; blanks become NULL."""
    raw = lambda c: F.nullif(F.col(c), F.lit(""))
    return parsed.withColumns({
        "cost_musd": clean_money("cost").cast("decimal(18,3)"), "cost_raw": raw("cost"),
        "cig_request_musd": clean_money("cig_request").cast("decimal(18,3)"), "cig_request_raw": raw("cig_request")})


def snapshot_date(file_name: Column | str, today: date) -> Column:
    return F.coalesce(date_from_name(file_name).try_cast("date"), F.lit(today))


def latest_file(files: DataFrame, url: str = "url") -> DataFrame:
    """The newest file by the date in its name; undated ones come last."""
    name = F.col(url)
    return files.agg(F.max_by(name, F.struct(F.coalesce(date_from_name(name), F.lit("")), name)).alias(url))


def dedupe_first(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """First row of each key by input line; a partial aggregate, so repeated keys never pile up."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), line).alias("_r"))
    return first.select(*[c if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def guard_min_rows(df: DataFrame, least: int) -> bool:
    """True when a load is large enough to be believed; reads no more than ``least`` rows."""
    return df.limit(least).count() >= least


def load_outcomes(rows: DataFrame, snapshot: str = "snapshot_date", *, least: int) -> DataFrame:
    """Per snapshot: how many projects came in and whether the load is accepted."""
    n = F.count(F.lit(1))
    return rows.groupBy(snapshot).agg(n.alias("projects")).withColumn(
        "status", F.when(F.col("projects") >= least, "loaded").otherwise("refused"))


def backfill_attr(rows: DataFrame, attr: str, kept: DataFrame | None = None, keys: list[str] | None = None,
                  snapshot: str = "snapshot_date") -> DataFrame:
    """Fill a missing attribute: first from the kept file of the same snapshot, then the newest value
    the same project has in any snapshot. Stored values stay."""
    keys = keys or KEY
    cols = rows.columns
    if kept is not None:
        same = (kept.filter(F.col(attr).isNotNull()).groupBy(snapshot, *keys)
                .agg(F.min(attr).alias("_kept")))
        rows = rows.join(same, [snapshot, *keys], "left").withColumn(attr, F.coalesce(attr, "_kept"))
    newest = (rows.filter(F.col(attr).isNotNull()).groupBy(*keys)
              .agg(F.max_by(attr, snapshot).alias("_newest")))
    return rows.join(newest, keys, "left").withColumn(attr, F.coalesce(attr, "_newest")).select(*cols)


# ---- comparison ---------------------------------------------------------------------------------

def snapshots(rows: DataFrame) -> DataFrame:
    return (rows.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("projects"))
            .orderBy(F.desc("snapshot_date")))


def pick_pair(snaps: DataFrame, to: date | None = None, since: date | None = None) -> DataFrame:
    """The snapshots to compare: the requested newer one if present else the latest, and the requested
    older one if it is older, else the next older."""
    wanted = F.lit(to).cast("date")
    newer = snaps.agg(F.coalesce(F.max(F.when(F.col("snapshot_date") == wanted, F.col("snapshot_date"))),
                                 F.max("snapshot_date")).alias("to_date"))
    older = snaps.crossJoin(F.broadcast(newer)).filter(F.col("snapshot_date") < F.col("to_date"))
    asked = F.lit(since).cast("date")
    return older.groupBy("to_date").agg(
        F.coalesce(F.max(F.when(F.col("snapshot_date") == asked, F.col("snapshot_date"))),
                   F.max("snapshot_date")).alias("from_date"))


def at_snapshot(rows: DataFrame, pick: DataFrame, column: str) -> DataFrame:
    """Rows of the picked snapshot; ``pick`` is one row, so this prunes partitions at run time."""
    one = F.broadcast(pick.select(F.col(column).alias("_at")))
    return rows.join(one, F.col("snapshot_date") == F.col("_at"), "left_semi")


def latest_rows(rows: DataFrame) -> DataFrame:
    return at_snapshot(rows, rows.agg(F.max("snapshot_date").alias("latest")), "latest")


def _text(c: str) -> Column:
    return F.col(c).cast("decimal(18,3)").cast("string") if c.split(".")[-1] in MONEY else F.col(c).cast("string")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """New and dropped projects, and one row per changed field, between two snapshots."""
    cols = KEY + ["state", "mode"] + list(CHANGE_FIELDS)
    a, b = old.select(*cols).alias("a"), new.select(*cols).alias("b")
    on = F.col("a.project_name").eqNullSafe(F.col("b.project_name")) & F.col("a.sponsor").eqNullSafe(F.col("b.sponsor"))
    a = a.withColumn("_in", F.lit(True)).alias("a")
    b = b.withColumn("_in", F.lit(True)).alias("b")
    both = a.join(b, on, "full_outer")
    had, has = F.col("a._in").isNotNull(), F.col("b._in").isNotNull()
    ident = [F.when(has, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in KEY + ["state", "mode"]]
    shown = F.when(has, F.col("b.phase")).otherwise(F.col("a.phase"))
    asked = F.when(has, F.col("b.cig_request_musd")).otherwise(F.col("a.cig_request_musd")).cast("double")

    none_text, none_num = F.lit(None).cast("string"), F.lit(None).cast("double")
    entries = [F.struct(
        F.when(had, "dropped").otherwise("new").alias("type"), none_text.alias("label"), none_text.alias("before"),
        none_text.alias("after"), none_text.alias("direction"), none_num.alias("delta"), none_num.alias("pct"),
        shown.alias("phase"), asked.alias("cig_request_musd"), (~(had & has)).alias("keep"))]
    for field, (label, _) in CHANGE_FIELDS.items():
        before, after = F.col(f"a.{field}"), F.col(f"b.{field}")
        direction, delta, pct = none_text, none_num, none_num
        if field == "phase":
            rank = lambda c: first_rule([(c == p, F.lit(n)) for p, n in PHASE_ORDER.items()])
            direction = F.when(rank(after) > rank(before), "advanced").when(rank(after) < rank(before), "back")
        if field in MONEY:
            x, y = before.cast("double"), after.cast("double")
            delta = F.rint((y - x) * 10) / 10
            pct = F.rint((y - x) / F.nullif(x, F.lit(0.0)) * 100 * 10) / 10
        entries.append(F.struct(
            F.lit(field).alias("type"), F.lit(label).alias("label"), _text(f"a.{field}").alias("before"),
            _text(f"b.{field}").alias("after"), direction.alias("direction"), delta.alias("delta"), pct.alias("pct"),
            none_text.alias("phase"), none_num.alias("cig_request_musd"),
            (had & has & ~before.eqNullSafe(after)).alias("keep")))
    rows = both.select(*ident, F.inline(F.array(*entries))).filter("keep").drop("keep")
    return rows


def order_changes(changes: DataFrame) -> DataFrame:
    place = {"new": 0, "dropped": 1} | {f: p for f, (_, p) in CHANGE_FIELDS.items()}
    rank = first_rule([(F.col("type") == k, F.lit(v)) for k, v in place.items()], F.lit(9))
    return changes.orderBy(rank, F.lower(F.coalesce("project_name", F.lit(""))), "sponsor")


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def project_history(rows: DataFrame, name: str | None = None, sponsor: str | None = None) -> DataFrame:
    """Projects across snapshots, oldest first."""
    if name is not None:
        rows = rows.filter(F.col("project_name") == name)
    if sponsor:
        rows = rows.filter(F.col("sponsor") == sponsor)
    return rows.select(*KEY, "snapshot_date", "phase", "rating", "cost_musd", "cig_request_musd", "est_grant",
                       "noncig_status").orderBy("project_name", "sponsor", "snapshot_date")


def timeline(rows: DataFrame) -> DataFrame:
    """What moved at each snapshot of a project: first seen, no change, or the list of changes.

    A project has at most one row per snapshot, so a window per project stays small.
    """
    line = Window.partitionBy(*KEY).orderBy("snapshot_date")
    fields = {"phase": "phase", "rating": "rating", "est_grant": "est. grant", "cig_request_musd": "CIG",
              "cost_musd": "cost"}
    rows = rows.withColumn("_p", F.lag(F.struct(*fields)).over(line))
    steps = []
    for field, label in fields.items():
        was = F.col("_p")[field]
        show = (lambda c: c.cast("decimal(18,3)").cast("string")) if field in MONEY else (lambda c: c)
        steps.append(F.when(~was.eqNullSafe(F.col(field)), F.concat(
            F.lit(label + " "), F.coalesce(show(was), F.lit("?")), F.lit(" → "),
            F.coalesce(show(F.col(field)), F.lit("?")))))
    changed = F.array_compact(F.array(*steps))
    step = (F.when(F.col("_p").isNull(), "first seen").when(F.size(changed) == 0, "no change")
            .otherwise(F.array_join(changed, " · ")))
    return rows.select(*KEY, "snapshot_date", step.alias("step"))


# ---- listings -----------------------------------------------------------------------------------

UNSPECIFIED = "Unspecified"


def version_rollup(versions: DataFrame) -> DataFrame:
    """Archived versions per project and the day its text last changed."""
    return versions.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("profile_versions"),
        F.date_format(F.max(F.when(F.col("changed"), F.col("captured_at"))), "yyyy-MM-dd").alias("profile_changed_at"))


def grant_listing(rows: DataFrame, pages: DataFrame, versions: DataFrame, *, phase=None, mode=None, rating=None,
                  state=None, sponsor=None) -> DataFrame:
    """Latest snapshot with filters, page link and version counts; largest request first."""
    out = latest_rows(rows)
    if mode == UNSPECIFIED:
        out, mode = out.filter("mode IS NULL"), None
    for column, value in (("phase", phase), ("mode", mode), ("rating", rating), ("state", state)):
        if value:
            out = out.filter(F.col(column) == value)
    if sponsor:
        out = out.filter(F.contains(F.lower("sponsor"), F.lit(sponsor.lower())))
    key = F.coalesce("sponsor", F.lit(""))
    links = pages.select(F.col("project_name").alias("_gn"), F.col("sponsor").alias("_gs"), "profile_url")
    roll = version_rollup(versions).withColumnsRenamed({"project_name": "_vn", "sponsor": "_vs"})
    out = (out.join(links, (F.col("project_name") == F.col("_gn")) & (key == F.col("_gs")), "left")
           .join(roll, (F.col("project_name") == F.col("_vn")) & (key == F.col("_vs")), "left")
           .drop("_gn", "_gs", "_vn", "_vs"))
    return out.orderBy(F.desc_nulls_last("cig_request_musd"), "project_name")


def grant_summary(rows: DataFrame) -> DataFrame:
    """Latest snapshot: total, by phase and by mode, all from one pass."""
    latest = latest_rows(rows).withColumn("_mode", F.coalesce("mode", F.lit(UNSPECIFIED)))
    sets = latest.groupingSets([["phase"], ["_mode"], []], "phase", "_mode").agg(
        F.grouping_id("phase", "_mode").alias("_g"), F.count(F.lit(1)).alias("projects"),
        F.sum("cig_request_musd").alias("cig_musd"))
    return sets.select(
        F.when(F.col("_g") == 1, "phase").when(F.col("_g") == 2, "mode").otherwise("all").alias("facet"),
        F.coalesce("phase", "_mode").alias("value"), "projects", F.col("cig_musd").cast("double").alias("cig_musd"))


def percent_of(c: Column | str) -> Column:
    return F.regexp_extract(c, r"(\d+(\.\d+)?)\s*%", 1).try_cast("double")


def grant_when(c: Column | str) -> Column:
    """'Season or month, year' text as a decimal year; NULL without a year."""
    text = F.lower(F.col(c) if isinstance(c, str) else c)
    year = F.regexp_extract(text, r"(20\d\d)", 1).try_cast("double")
    part = first_rule([(text.contains(m), F.lit((i + 0.5) / 12)) for i, m in enumerate(MONTHS)]
                      + [(text.contains(s), F.lit(v)) for s, v in SEASONS.items()], F.lit(0.5))
    return year + part


def sort_key(key: str) -> Column:
    rank = lambda col, table: first_rule([(F.col(col) == k, F.lit(v)) for k, v in table.items()])
    blank = lambda c: F.nullif(c, F.lit(""))
    return {
        "project_name": lambda: blank(F.lower("project_name")),
        "sponsor": lambda: blank(F.lower("sponsor")),
        "location": lambda: blank(F.trim(F.lower(F.concat_ws(" ", F.coalesce("state", F.lit("")),
                                                             F.coalesce("city", F.lit("")))))),
        "mode": lambda: F.lower("mode"),
        "phase": lambda: rank("phase", PHASE_RANK),
        "rating": lambda: rank("rating", RATING_RANK),
        "cost_musd": lambda: F.col("cost_musd"),
        "cig_request_musd": lambda: F.col("cig_request_musd"),
        "cig_share": lambda: percent_of("cig_share"),
        "est_grant": lambda: grant_when("est_grant"),
    }[key]()


def sort_projects(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Order by a domain key, blanks last both ways; ties keep the default order."""
    k = sort_key(key)
    default = [F.desc_nulls_last("cig_request_musd"), F.asc("project_name")]
    if descending:  # a descending click also turns the order of ties around
        return rows.orderBy(F.desc_nulls_last(k), F.asc_nulls_first("cig_request_musd"), F.desc("project_name"))
    return rows.orderBy(F.asc_nulls_last(k), *default)


def grant_stat(rows: DataFrame) -> DataFrame:
    """Headline figure of the latest snapshot: requested money in billions or millions, and counts."""
    total = F.coalesce(F.sum("cig_request_musd"), F.lit(0)).cast("double")
    figures = latest_rows(rows).agg(F.count(F.lit(1)).alias("projects"), total.alias("total_musd"),
                                    F.count_if(F.col("phase") == "Eng").alias("engineering")).filter("projects > 0")
    return figures.withColumn("figure", F.when(
        F.col("total_musd") >= 1000, F.format_string("$%.1fB", F.col("total_musd") / 1000))
        .otherwise(F.format_string("$%.0fM", F.col("total_musd"))))


def load_history(loads: DataFrame, at: str = "loaded_at", ident: str = "id", *, top: int) -> DataFrame:
    from headway.functions.columns import eastern_minute
    return loads.orderBy(F.desc(at), F.desc(ident)).limit(top).withColumn(at, eastern_minute(at))


def stale_snapshot(rows: DataFrame, asof: date, days: int = 45) -> DataFrame:
    age = F.datediff(F.lit(asof), F.max("snapshot_date"))
    return rows.agg(F.max("snapshot_date").alias("snapshot"), age.alias("age_days"), (age > days).alias("stale"))


def projects_for_agency(rows: DataFrame, agencies: DataFrame) -> DataFrame:
    """Projects of each agency: the sponsor equals its sponsor name, its name or any alias."""
    names = agencies.select("name", F.explode(F.concat(
        F.array("cig_sponsor", "name"), F.coalesce("aliases", F.expr("array()").cast("array<string>")))).alias("_n"))
    names = names.filter("_n <> ''").select(F.col("name").alias("agency"), F.lower("_n").alias("_n")).distinct()
    return rows.join(names, F.lower("sponsor") == F.col("_n")).drop("_n")
