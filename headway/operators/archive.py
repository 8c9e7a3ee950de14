"""Revision archive: document versions, their differences, and the listing page that points to them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.functions.columns import date_in_name_last, norm_name, squeeze  # noqa: F401
from headway.functions.ordered import previous_row
from headway.operators.grants import latest_rows
from headway.operators.linkage import link_profiles
from headway.session import settle

LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
PAGE_NUMBER = r"(?i)^(page\s*)?\d{1,3}(\s*of\s*\d{1,3})?$"


@F.pandas_udf(T.StringType())
def compatibility_form(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no built-in for."""
    return texts.str.normalize("NFKC")


def canonical_text(c: Column | str) -> Column:
    """Text for hashing: compatibility form, whitespace squeezed, blank lines and page numbers dropped."""
    text = compatibility_form(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    lines = F.transform(F.split(text, LINE_BREAKS), lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda s: (s != "") & ~s.rlike(PAGE_NUMBER)), "\n")


def text_hash(c: Column | str) -> Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def admit_versions(incoming: DataFrame, archive: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Decide each arrival: unchanged (text seen before for its key), new or changed.

    ``short`` marks texts of fewer than ``least`` characters, which may be unreadable; they are archived.

    ``incoming(keys, id, captured_at, text)`` with canonical text; ``archive(keys, id, captured_at,
    text_sha256)``. Arrivals of one key in a batch count in order of capture. The previous version
    comes from an ordered pass that spreads a busy key over many tasks.
    """
    rows = incoming.withColumn("text_sha256", text_hash("text"))
    known = archive.select(*keys, "text_sha256").distinct()
    fresh = rows.join(known, [*keys, "text_sha256"], "left_anti")
    first = (fresh.groupBy(*keys, "text_sha256").agg(F.min(F.struct("captured_at", "id")).alias("_f"))
             .select(*keys, F.col("_f.id").alias("id"), F.col("_f.captured_at").alias("captured_at"),
                     F.lit(True).alias("_admitted")))
    line = archive.select(*keys, "id", "captured_at", F.lit(False).alias("_admitted")).unionByName(first)
    chained = previous_row(line, keys, [F.asc("captured_at"), F.asc("id")], {"prev_version_id": "id"})
    admitted = chained.filter("_admitted").select("id", "_admitted", "prev_version_id")
    out = rows.join(admitted, "id", "left")
    status = (F.when(F.col("_admitted").isNull(), "unchanged")
              .when(F.col("prev_version_id").isNull(), "new").otherwise("changed"))
    return out.withColumns({"status": status, "short": F.length("text") < least}).drop("_admitted")


def line_changes(versions: DataFrame) -> DataFrame:
    """Lines added, removed and kept between each version and the one before it.

    Lines are counted as a multiset, so a line that moves is kept. ``versions(id, prev_version_id, text)``;
    only ids travel to find the pairs, and a version's lines are folded to counts before they meet.
    """
    lines = versions.select("id", F.explode(F.split("text", LINE_BREAKS)).alias("line")).groupBy("id", "line").agg(F.count(F.lit(1)).alias("n"))
    pairs = versions.filter("prev_version_id IS NOT NULL").select("id", "prev_version_id")
    new = lines.join(pairs.select("id"), "id").select("id", "line", F.col("n").alias("new"), F.lit(0).cast("bigint").alias("old"))
    old = (lines.withColumnRenamed("id", "prev_version_id").join(pairs, "prev_version_id")
           .select("id", "line", F.lit(0).cast("bigint").alias("new"), F.col("n").alias("old")))
    both = new.unionByName(old).groupBy("id", "line").agg(F.sum("new").alias("new"), F.sum("old").alias("old"))
    counts = both.groupBy("id").agg(
        F.sum(F.greatest(F.col("new") - F.col("old"), F.lit(0))).alias("lines_added"),
        F.sum(F.greatest(F.col("old") - F.col("new"), F.lit(0))).alias("lines_removed"),
        F.sum(F.least("new", "old")).alias("lines_kept"))
    zero = {"lines_added": 0, "lines_removed": 0, "lines_kept": 0}
    return pairs.join(counts, "id", "left").fillna(zero)


def _longest_run(positions: Column) -> Column:
    """Length of the longest strictly increasing subsequence of an array of numbers.

    The n-th pile top is the smallest number that ends an increasing subsequence of length n; each number goes on
    the first pile whose top is not smaller.
    """
    def place(tops: Column, x: Column) -> Column:
        below = F.size(F.filter(tops, lambda t: t < x))
        return F.concat(F.slice(tops, F.lit(1), below), F.array(x), F.slice(tops, below + 2, F.size(tops)))

    return F.size(F.aggregate(positions, F.array().cast("array<int>"), place))


def _leading(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) == F.element_at(b, i))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1)


def ordered_changes(versions: DataFrame) -> DataFrame:
    """Lines added, removed, kept and moved between each version and the one before it, with their order.

    Kept lines are a longest common subsequence, so no other choice of kept lines leaves fewer changes. A line that both
    versions hold but not in that order counts as added and removed, and once as moved. Lines shared at the
    beginning and end are set aside; each other line of the new version meets the places where the old one holds it, last
    place first, and the longest increasing run of these places is the common subsequence. ``versions(id,
    prev_version_id, text)``; a version whose predecessor is missing has only added lines, a null text has no line.
    """
    lines = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", LINE_BREAKS))
    held = versions.select("id", "prev_version_id", lines.alias("new"))
    before = held.select(F.col("id").alias("prev_version_id"), F.col("new").alias("old"))
    both = (held.filter("prev_version_id IS NOT NULL").join(before, "prev_version_id", "left")
            .withColumn("old", F.coalesce("old", F.array().cast("array<string>"))))
    both = both.withColumn("head", _leading(F.col("new"), F.col("old")))
    rest = {c: F.slice(c, F.col("head") + 1, F.greatest(F.size(c) - F.col("head"), F.lit(0))) for c in ("new", "old")}
    both = both.withColumns({"n_new": F.size("new"), "n_old": F.size("old")}).withColumns(rest)
    both = both.withColumn("tail", _leading(F.reverse("new"), F.reverse("old")))
    both = settle(both.withColumns({c: F.slice(c, F.lit(1), F.size(c) - F.col("tail")) for c in ("new", "old")}))
    places = both.select("id", F.posexplode("old").alias("at", "line")).groupBy("id", "line").agg(F.sort_array(F.collect_list("at"), asc=False).alias("places"))
    met = both.select("id", F.posexplode("new").alias("at", "line")).join(places, ["id", "line"])
    runs = met.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("at", "places"))).alias("met")).select("id", _longest_run(F.flatten(F.col("met.places"))).alias("middle"))
    # lines that both middles hold, whatever their order
    new = met.groupBy("id", "line").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("places")).alias("m"))
    common = new.groupBy("id").agg(F.sum(F.least("n", "m")).alias("common"))
    out = both.select("id", "prev_version_id", "n_new", "n_old", "head", "tail").join(runs, "id", "left").join(common, "id", "left")
    middle = F.coalesce("middle", F.lit(0))
    kept = F.col("head") + F.col("tail") + middle
    whole = lambda c: c.cast("bigint")
    return out.select("id", "prev_version_id", whole(F.col("n_new") - kept).alias("lines_added"), whole(F.col("n_old") - kept).alias("lines_removed"),
                      whole(kept).alias("lines_kept"), whole(F.coalesce("common", F.lit(0)) - middle).alias("lines_moved"))


# ---- listing page -------------------------------------------------------------------------------

def _cell(c: Column) -> Column:
    text = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&amp;", "&"), (" ", " ")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return squeeze(text)


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def html_table_rows(pages: DataFrame, html: str = "html", page_id: str = "page_id",
                    site: str = "https://www.transit.dot.gov") -> DataFrame:
    """Rows of the project table of each page, chosen and read by its header names."""
    tables = pages.select(page_id, F.posexplode(_all(F.col(html), r"(?is)(<table\b.*?</table>)")).alias("table_no", "t"))
    heads = F.transform(_all(F.col("t"), r"(?is)<th[^>]*>(.*?)</th>"), lambda h: F.lower(_cell(h)))
    tables = tables.withColumn("heads", heads)
    profile = F.filter("heads", lambda h: h.contains("profile"))
    stage = F.filter("heads", lambda h: h.startswith("stage"))
    tables = tables.filter(F.array_contains("heads", "project name") & (F.size(profile) > 0))
    at = lambda h, default: F.coalesce(F.nullif(F.array_position("heads", h), F.lit(0)), F.lit(default)).cast("int")
    tables = tables.select(
        page_id, "table_no", at(F.lit("state"), 1).alias("i_state"), at(F.lit("city"), 2).alias("i_city"),
        at(F.lit("project name"), 1).alias("i_name"), at(profile[0], 1).alias("i_prof"),
        F.when(F.size(stage) > 0, F.array_position("heads", F.get(stage, F.lit(0))).cast("int")).alias("i_stage"),
        F.posexplode(_all(F.col("t"), r"(?is)<tr[^>]*>(.*?)</tr>")).alias("row_no", "tr"))
    rows = tables.withColumn("td", _all(F.col("tr"), r"(?is)<td[^>]*>(.*?)</td>"))
    rows = rows.filter(F.size("td") >= F.greatest("i_name", "i_prof"))
    cell = lambda i: _cell(F.try_element_at("td", F.col(i)))
    href = F.nullif(F.trim(F.replace(F.regexp_extract(F.element_at("td", F.col("i_prof")), 'href="([^"]+)"', 1),
                                     F.lit("&amp;"), F.lit("&"))), F.lit(""))
    return rows.select(page_id, "table_no", "row_no", cell("i_state").alias("state"), cell("i_city").alias("city"),
                       cell("i_name").alias("name"), cell("i_stage").alias("stage"),
                       F.when(href.startswith("/"), F.concat(F.lit(site), href)).otherwise(href).alias("profile_url"))


def as_profiles(listing: DataFrame, ident: str = "row_no") -> DataFrame:
    """Listing rows in the shape the linker compares with."""
    return listing.select(
        F.col(ident).cast("bigint").alias("profile_id"), norm_name("name").alias("key"),
        F.filter(F.split(F.coalesce("state", F.lit("")), "-"), lambda s: s != "").alias("states"))


def match_listing(listing: DataFrame, projects: DataFrame, ident: str = "row_no", order: str = "order_no") -> DataFrame:
    """Pair projects with listing rows one to one; the first project in order keeps a contested row.

    Returns one row per project and per unused listing row, with ``outcome`` matched, not_listed or
    not_a_project, and ``renamed`` where the two names differ.
    """
    links = link_profiles(projects.select(F.col("project_name").alias("name"), "state"), as_profiles(listing, ident))
    linked = projects.join(
        links.select(F.col("name").alias("_n"), F.col("state").alias("_s"), F.col("profile_id").alias("_row")),
        F.col("project_name").eqNullSafe(F.col("_n")) & F.col("state").eqNullSafe(F.col("_s")), "left").drop("_n", "_s")
    winner = linked.filter("_row IS NOT NULL").groupBy("_row").agg(F.min(order).alias("_win")).withColumnRenamed("_row", "_r")
    kept = linked.join(winner, (F.col("_row") == F.col("_r")) & (F.col(order) == F.col("_win")), "left")
    row = listing.select(F.col(ident).cast("bigint").alias("_lr"), F.col("name").alias("listing_name"),
                         F.col("stage").alias("listing_stage"), "profile_url", F.col("state").alias("_lstate"))
    both = kept.join(row, F.col("_r") == F.col("_lr"), "full_outer")
    outcome = (F.when(F.col("project_name").isNull(), "not_a_project").when(F.col("_lr").isNull(), "not_listed")
               .otherwise("matched"))
    return both.select(
        "project_name", "sponsor", F.coalesce("state", "_lstate").alias("state"), "listing_name", "listing_stage",
        "profile_url", outcome.alias("outcome"),
        (F.col("project_name").isNotNull() & F.col("_lr").isNotNull()
         & (norm_name("project_name") != norm_name("listing_name"))).alias("renamed"))


def listing_diff(old: DataFrame, new: DataFrame, order: str = "row_no") -> DataFrame:
    """Added, removed, stage and link changes between two listings, by state and canonical name."""
    def keyed(df: DataFrame, side: str) -> DataFrame:
        fields = F.struct("name", "stage", "profile_url")
        return (df.groupBy(F.coalesce("state", F.lit("")).alias("state"), norm_name("name").alias("key"))
                .agg(F.max_by(fields, order).alias(side)))
    both = keyed(old, "o").join(keyed(new, "n"), ["state", "key"], "full_outer")
    text = lambda c: F.coalesce(c, F.lit(""))
    shown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    added, removed = F.col("o").isNull(), F.col("n").isNull()
    stays = ~added & ~removed
    kinds = F.array_compact(F.array(
        F.when(added, F.struct(F.lit("added").alias("kind"), F.concat(
            F.lit("new on FTA's page ("), F.coalesce(F.nullif("n.stage", F.lit("")), F.lit("stage ?")), F.lit(")")).alias("detail"))),
        F.when(removed, F.struct(F.lit("removed").alias("kind"), F.lit("no longer on FTA's page").alias("detail"))),
        F.when(stays & (text(F.col("o.stage")) != text(F.col("n.stage"))), F.struct(
            F.lit("stage").alias("kind"),
            F.concat(F.lit("stage "), shown(F.col("o.stage")), F.lit(" → "), shown(F.col("n.stage"))).alias("detail"))),
        F.when(stays & (text(F.col("o.profile_url")) != text(F.col("n.profile_url"))), F.struct(
            F.lit("link").alias("kind"), F.lit("profile link changed").alias("detail")))))
    row = F.coalesce("n", "o")
    return both.select("state", "key", row["name"].alias("name"), row["profile_url"].alias("profile_url"),
                       F.inline(kinds))


def fingerprint(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Order-free fingerprint of the rows of a group: count and two independent hash sums.

    A partial aggregate; no task ever holds a whole snapshot.
    """
    doc = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), doc).cast("decimal(20,0)"))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), wide(1).alias("h1"), wide(2).alias("h2"))


def skip_same_snapshot(rows: DataFrame, snapshot: str, columns: list[str]) -> DataFrame:
    """Per snapshot: stored, or skipped because it repeats the one before it."""
    prints = fingerprint(rows, [snapshot], columns)
    line = Window.orderBy(snapshot)  # one row per snapshot
    same = F.struct("n", "h1", "h2").eqNullSafe(F.lag(F.struct("n", "h1", "h2")).over(line))
    return prints.select(snapshot, F.col("n").alias("rows"),
                         F.when(F.coalesce(same, F.lit(False)), "skipped").otherwise("stored").alias("outcome"))


def to_download(pages: DataFrame, versions: DataFrame, projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Current projects whose profile should be fetched, and why."""
    key = ["project_name", "sponsor"]
    now = projects.select("project_name", F.coalesce("sponsor", F.lit("")).alias("sponsor")).distinct()
    changed = (changes.filter("kind <> 'removed'")
               .groupBy("state", norm_name("name").alias("_k")).agg(F.max("detail").alias("_why")))
    link_name = F.try_url_decode(F.regexp_extract("pdf_url", "([^/]*)$", 1))
    linked = pages.join(now, key, "left_semi").withColumn("_k", norm_name("listing_name")).join(changed, ["state", "_k"], "left")
    held = versions.select(*key, F.col("pdf_url").alias("_vurl"), F.col("file_name").alias("_vfile"), F.lit(1).alias("_held"))
    # one flag per project: does any archived version carry the linked file?
    found = (linked.select(*key, "pdf_url", link_name.alias("_file")).join(held, key, "left")
             .groupBy(*key).agg(F.count("_held").alias("_n"),
                                F.max((F.col("_vurl") == F.col("pdf_url")) | (F.col("_vfile") == F.col("_file"))).alias("_have")))
    why = F.array_compact(F.array(
        F.col("_why"),
        F.when(F.col("pdf_url").isNotNull() & ~F.coalesce("_have", F.lit(False)), F.concat(
            F.lit("FTA's page links a file not yet archived: "), F.regexp_extract("pdf_url", "([^/]*)$", 1))),
        F.when(F.coalesce("_n", F.lit(0)) == 0, F.lit("no archived version"))))
    return (linked.join(found, key, "left").withColumn("_reasons", why).filter(F.size("_reasons") > 0)
            .select(*key, "profile_url", "pdf_url", F.array_join("_reasons", "; ").alias("why")))


def find_unique(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """The single project each document belongs to, else a reason.

    Every (document, project) pair is judged alone, so a document is compared only with projects the
    linker can reach from it; ``hits`` counts them and the reason names them. ``documents(profile_id, title, key, states)``.
    """
    from headway.operators.linkage import pair_links, project_of
    hits = pair_links(projects.select(F.col("project_name").alias("name"), "state"), documents)
    names = F.sort_array(F.array_compact(F.transform("links", lambda x: project_of(x)[0])))
    name, state = project_of(F.col("links")[0])
    per = hits.select("profile_id", F.size("links").cast("bigint").alias("hits"), name.alias("_name"), F.when(name.isNotNull(), state).alias("_state"),
                      F.array_join(names, ", ").alias("_names"))
    out = documents.join(per, "profile_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    one = F.col("hits") == 1
    reason = (F.when(F.col("hits") > 1, F.concat(F.lit("matches several projects: "), "_names"))
              .when(F.col("hits") == 0, F.concat(F.lit("no current project matches “"), "title", F.lit("”"))))
    return out.select("profile_id", "title", "hits", F.when(one, F.col("_name")).alias("project_name"),
                      F.when(one, F.col("_state")).alias("state"), reason.alias("reason"))


def current_projects(rows: DataFrame) -> DataFrame:
    return latest_rows(rows).select("project_name", F.coalesce("sponsor", F.lit("")).alias("sponsor"), "state")


def archive_coverage(rows: DataFrame, pages: DataFrame, versions: DataFrame) -> DataFrame:
    """Current projects in total, with a page link, with an archived version; versions and changes."""
    key = ["project_name", "sponsor"]
    now = current_projects(rows)
    held = versions.select(*key).distinct().withColumn("_v", F.lit(1))
    per = now.join(pages.select(*key, "profile_url"), key, "left").join(held, key, "left").agg(
        F.count(F.lit(1)).alias("projects"), F.count("profile_url").alias("linked"), F.count("_v").alias("archived"))
    return per.crossJoin(versions.agg(F.count(F.lit(1)).alias("versions"), F.count_if("changed").alias("changed")))


def version_list(versions: DataFrame, name: str | None = None, sponsor: str | None = None) -> DataFrame:
    """Versions newest first, optionally of one project."""
    if name is not None:
        versions = versions.filter((F.col("project_name") == name) & (F.col("sponsor") == (sponsor or "")))
    return versions.orderBy("project_name", "sponsor", F.desc("captured_at"), F.desc("id"))


def merge_pages(pages: DataFrame, pairs: DataFrame, links: DataFrame, hosts: list[str]) -> DataFrame:
    """Fold new listing pairs (by project) and page-to-file links (by page URL) into the page table.
    Links to files on other hosts are ignored."""
    key = ["project_name", "sponsor"]
    fields = ["state", "profile_url", "listing_name", "listing_stage"]
    new = pairs.select(*key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_new"))
    merged = pages.join(new, key, "full_outer")
    merged = merged.select(*key, *[F.when(F.col("_new"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
                           "pdf_url")
    host = F.lower(F.try_parse_url("_pdf", F.lit("HOST")))
    ok = links.select("page_url", F.col("pdf_url").alias("_pdf")).filter(F.col("_pdf").isNull() | host.isin(*hosts))
    ok = ok.groupBy("page_url").agg(F.max("_pdf").alias("_pdf"), F.lit(True).alias("_hit"))
    return (merged.join(ok, merged["profile_url"] == ok["page_url"], "left")
            .withColumn("pdf_url", F.when(F.col("_hit"), F.col("_pdf")).otherwise(F.col("pdf_url")))
            .drop("page_url", "_pdf", "_hit"))


def last_run(runs: DataFrame, triggers: list[str], ident: str = "id") -> DataFrame:
    """The newest run started by one of ``triggers``."""
    rest = [c for c in runs.columns]
    return (runs.filter(F.col("trigger").isin(*triggers)).agg(F.max_by(F.struct(*rest), ident).alias("r"))
            .filter("r IS NOT NULL").select("r.*"))
