"""Published posts: from items to posts, the publish queue, listings and issues."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.columns import STEM, array_of, blank_to_null, host_of, is_blank, post_slug
from headway.functions.ordered import running_total

SOURCE_MARK = "\n\nSource:"
PER_PAGE = 20
# fixed values: site section -> pillar (news shows all)
SECTIONS = {"news": None, "funding": "Funding", "procurement": "Procurement", "people": "People", "policy": "Policy"}
FACETS = ("agencies", "mode", "programs", "tags")


# ---- items to posts -----------------------------------------------------------------------------

def to_posts(items: DataFrame, now: datetime) -> DataFrame:
    """Approved items as published posts."""
    line = F.when(F.col("source_url").isNotNull() & (F.col("source_url") != ""), F.concat(
        F.lit(SOURCE_MARK + " "), F.coalesce("source_name", F.lit("")), F.lit(" - "), "source_url")).otherwise("")
    return items.filter("status = 'approved'").select(
        post_slug("headline", "id").alias("slug"), "pillar", F.col("headline").alias("title"),
        F.concat(F.coalesce("summary", F.lit("")), line).alias("body"), F.lit("published").alias("status"),
        F.lit(now).alias("publish_at"), F.col("id").alias("item_id"), "source_name", "source_url",
        *[F.coalesce(f, array_of()).alias(f) for f in FACETS], "state")


def upsert_posts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rewrite of the post table with new posts folded in by slug; id, title and text of a post stay."""
    keep = ("pillar", "title", "body")
    n = new.select(F.struct(*new.columns).alias("n"), F.col("slug").alias("_ns"))
    both = stored.join(n, F.col("slug") == F.col("_ns"), "full_outer")
    cols = []
    for c in stored.columns:
        if c in new.columns and c not in keep:
            cols.append(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c))
        elif c in new.columns:
            cols.append(F.when(F.col("slug").isNotNull(), F.col(c)).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.col(c))
    return both.select(*cols)


def fill_slugs(posts: DataFrame, stem_chars: int = STEM) -> DataFrame:
    """Missing slugs from title and id; the stem is cut without trimming dashes."""
    stem = F.substring(F.regexp_replace(F.lower(F.coalesce("title", F.lit("post"))), "[^a-z0-9]+", "-"), 1, stem_chars)
    made = F.concat(stem, F.lit("-"), F.col("id").cast("string"))
    return posts.withColumn("slug", F.when(is_blank("slug"), made).otherwise(F.col("slug")))


# ---- publish queue ------------------------------------------------------------------------------

def ready_list(items: DataFrame, rows: int) -> DataFrame:
    return (items.filter("status = 'approved'")
            .orderBy(F.desc_nulls_last("score"), F.desc("collected_at"), F.desc("id")).limit(rows))


def due_items(items: DataFrame, now: datetime) -> DataFrame:
    """Approved items whose time has come, oldest first; items without a time wait for a person."""
    return items.filter((F.col("status") == "approved") & (F.col("publish_at") <= F.lit(now))).orderBy("publish_at", "id")


def picture_label() -> Column:
    return (F.when(F.col("pick_image_source") == "none", "none (text-only)")
            .when(F.col("pick_image_library_id").isNotNull() & (F.col("pick_image_library_id") != 0), "from the image library")
            .when(F.coalesce("pick_image_url", F.lit("")) != "", "source photo").otherwise("no picture chosen"))


def queue_view(items: DataFrame) -> DataFrame:
    rows = items.filter("status = 'approved'").withColumns({
        "image_label": picture_label(), "scheduled": F.col("publish_at").isNotNull()})
    return rows.orderBy(F.asc_nulls_first("publish_at"), F.desc("id"))


def queue_view_counts(items: DataFrame) -> DataFrame:
    rows = items.filter("status = 'approved'")
    return rows.agg(F.count_if(F.col("publish_at").isNull()).alias("now_count"),
                    F.count("publish_at").alias("scheduled_count"))


def publish_batch(requested: DataFrame, items: DataFrame) -> DataFrame:
    """Outcome per requested id, at the position of its first request.

    ``requested(position, id)``.
    """
    once = requested.groupBy("id").agg(F.min("position").alias("position"))
    ok = items.filter("status = 'approved'").select("id", F.lit(True).alias("_ok"))
    return once.join(ok, "id", "left").select(
        "position", "id", F.when(F.col("_ok"), "published").otherwise("skipped").alias("outcome"))


def status_cascade(items: DataFrame, posts: DataFrame, moved: DataFrame, withdrawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moving an item back drafts its published post; withdrawing a post returns its item.

    ``moved(id, status)``, ``withdrawn(post_id)``.
    """
    m = moved.select(F.col("id").alias("_m"), F.col("status").alias("_to"))
    w = withdrawn.select(F.col("post_id").alias("_w")).distinct()
    back = posts.join(w, F.col("id") == F.col("_w"), "left_semi").filter("item_id IS NOT NULL").select(F.col("item_id").alias("_b")).distinct()
    new_items = (items.join(m, F.col("id") == F.col("_m"), "left").join(back, F.col("id") == F.col("_b"), "left")
                 .withColumn("status", F.when(F.col("_to").isNotNull(), F.col("_to"))
                             .when(F.col("_b").isNotNull() & (F.col("status") == "published"), "approved")
                             .otherwise(F.col("status"))).drop("_m", "_to", "_b"))
    pulled = m.select(F.col("_m").alias("_pi"))
    new_posts = (posts.join(w, F.col("id") == F.col("_w"), "left").join(pulled, F.col("item_id") == F.col("_pi"), "left")
                 .withColumn("status", F.when(F.col("_w").isNotNull(), "draft")
                             .when(F.col("_pi").isNotNull() & (F.col("status") == "published"), "draft")
                             .otherwise(F.col("status"))).drop("_w", "_pi"))
    return new_items, new_posts


def feature_until(posts: DataFrame, requests: DataFrame, now: datetime) -> DataFrame:
    """Featured placements switched on for 1 to 365 days, or cleared. ``requests(id, on, days)``."""
    ok = requests.filter(F.col("days").between(1, 365)).select(F.col("id").alias("_r"), "on", "days")
    until = F.lit(now).cast("timestamp") + F.make_dt_interval(F.col("days"))
    rows = posts.join(ok, F.col("id") == F.col("_r"), "left")
    asked = F.col("_r").isNotNull()
    return rows.withColumns({
        "featured_until": F.when(asked & F.col("on"), until).when(asked, F.lit(None)).otherwise(F.col("featured_until")),
        "featured": F.when(asked, F.col("on")).otherwise(F.col("featured"))}).drop("_r", "on", "days")


def apply_decisions(items: DataFrame, decisions: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Apply the latest review decision per item; returns (items, refused decisions).

    ``decisions(item_id, at, seq, action, publish_at, image_url, image_source, library_id)``; actions
    approve, schedule, unqueue_review, unqueue_skip, skip, reset. Queue moves need an approved item and
    a schedule needs a future time; anything else is reported.
    """
    fields = ["action", "publish_at", "image_url", "image_source", "library_id"]
    last = (decisions.groupBy("item_id").agg(F.max_by(F.struct(*fields), F.struct("at", "seq")).alias("d"))
            .select(F.col("item_id").alias("_i"), "d"))
    rows = items.join(last, F.col("id") == F.col("_i"), "left")
    act, when = F.col("d.action"), F.col("d.publish_at")
    queued = F.col("status") == "approved"
    clear = (act == "schedule") & when.isNull()
    ok = (act.isin("approve", "skip", "reset") | (act.isin("unqueue_review", "unqueue_skip") & queued)
          | ((act == "schedule") & queued & (clear | (when > F.lit(now)))))
    ok = F.coalesce(ok, F.lit(False))
    to = (F.when(act == "approve", "approved").when(act.isin("skip", "unqueue_skip"), "skipped")
          .when(act.isin("reset", "unqueue_review"), "pending"))
    state = (F.when(act == "approve", "queued").when(act == "schedule", F.when(clear, "queued").otherwise("scheduled")))
    moves = act.isin("approve", "schedule", "unqueue_review", "unqueue_skip")
    approve = ok & (act == "approve")
    out = rows.withColumns({
        "queue_state": F.when(ok & moves, state).otherwise(F.col("queue_state")),
        "publish_at": F.when(ok & (act == "schedule"), when).when(ok & moves, F.lit(None)).otherwise(F.col("publish_at")),
        "pick_image_url": F.when(approve, F.col("d.image_url")).otherwise(F.col("pick_image_url")),
        "pick_image_source": F.when(approve, F.col("d.image_source")).otherwise(F.col("pick_image_source")),
        "pick_image_library_id": F.when(approve, F.col("d.library_id")).otherwise(F.col("pick_image_library_id")),
        "_ok": ok})
    applied = out.withColumn("status", F.when(F.col("_ok"), F.coalesce(to, F.col("status"))).otherwise(F.col("status")))
    refused = rows.filter(F.col("d").isNotNull() & ~ok).select(
        F.col("id").alias("item_id"), act.alias("action"),
        F.when((act == "schedule") & queued, "that time has already passed").otherwise("that item is not in the queue").alias("reason"))
    unknown = last.join(items.select(F.col("id").alias("_i")), "_i", "left_anti").select(
        F.col("_i").alias("item_id"), F.col("d.action").alias("action"), F.lit("no such item").alias("reason"))
    return applied.select(*items.columns), refused.unionByName(unknown)


# ---- pictures -----------------------------------------------------------------------------------

def picture_options(items: DataFrame, ranked: DataFrame) -> DataFrame:
    """Choices per item in fixed order (source photo, library, none) with the preselected one.

    ``ranked(item_id, place, asset_id, kind, url, note)`` is the image shortlist, a few rows per item.
    """
    has = F.coalesce(F.trim("image_url"), F.lit("")) != ""
    source = items.filter(has).select(
        F.col("id").alias("item_id"), F.lit(0).alias("tier"), F.lit(0).alias("place"), F.lit("source").alias("key"),
        F.lit("source").alias("kind"), F.col("image_url").alias("url"),
        F.concat(F.lit("via "), F.coalesce(F.nullif(host_of("image_url"), F.lit("")), F.lit("the source")),
                 F.lit(" - licence not reviewed")).alias("note"), F.lit(None).cast("bigint").alias("asset_id"))
    library = ranked.select("item_id", F.lit(1).alias("tier"), "place", F.concat(F.lit("lib-"), F.col("asset_id").cast("string")).alias("key"),
                            "kind", "url", "note", "asset_id")
    none = items.select(F.col("id").alias("item_id"), F.lit(2).alias("tier"), F.lit(0).alias("place"), F.lit("none").alias("key"),
                        F.lit("none").alias("kind"), F.lit(None).cast("string").alias("url"), F.lit("text-only").alias("note"),
                        F.lit(None).cast("bigint").alias("asset_id"))
    options = source.unionByName(library).unionByName(none)
    earlier = (F.when(F.col("pick_image_source") == "none", "none")
               .when(F.col("pick_image_library_id").isNotNull() & (F.col("pick_image_library_id") != 0),
                     F.concat(F.lit("lib-"), F.col("pick_image_library_id").cast("string")))
               .when(F.coalesce(F.trim("pick_image_url"), F.lit("")) != "", "source"))
    best = options.groupBy("item_id").agg(F.min_by("key", F.struct(
        F.element_at(F.array(F.lit(1), F.lit(0), F.lit(2)), F.col("tier") + 1), "place")).alias("_first"))
    chosen = items.select(F.col("id").alias("item_id"), earlier.alias("_earlier")).join(best, "item_id")
    chosen = chosen.select("item_id", F.coalesce("_earlier", "_first").alias("selected"))
    return options.join(chosen, "item_id").withColumn("preselected", F.col("key") == F.col("selected"))


# ---- listings -----------------------------------------------------------------------------------

def featured_live(now: datetime) -> Column:
    return F.coalesce("featured", F.lit(False)) & (F.col("featured_until").isNull() | (F.col("featured_until") > F.lit(now)))


def published_posts(posts: DataFrame, now: datetime, **facets) -> DataFrame:
    """Published posts under facet filters with the live featured flag and the summary."""
    from headway.operators.review import facet_filter
    only = facets.pop("featured", None)
    rows = facet_filter(posts.filter("status = 'published'").withColumn("featured", featured_live(now)), **facets)
    if only is not None:
        rows = rows.filter(F.col("featured") == only)
    return rows.withColumn("summary", post_summary("body"))


def _site_order() -> list[Column]:
    return [F.desc("featured"), F.desc_nulls_last("publish_at"), F.desc("id")]


def post_page(posts: DataFrame, now: datetime, limit: int, offset: int = 0, **facets) -> DataFrame:
    return published_posts(posts, now, **facets).orderBy(*_site_order()).offset(offset).limit(limit)


def post_total(posts: DataFrame, now: datetime, limit: int, offset: int = 0, **facets) -> DataFrame:
    total = published_posts(posts, now, **facets).agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", (F.lit(offset) + F.least(F.lit(limit), F.greatest(F.col("total") - offset, F.lit(0)))
                                  < F.col("total")).alias("has_more"))


def post_summary(body: Column | str) -> Column:
    """The text before the source line."""
    head = F.substring_index(F.coalesce(body, F.lit("")), SOURCE_MARK, 1)
    return F.nullif(F.regexp_replace(head, r"^\s+|\s+$", ""), F.lit(""))


def _shared_keys() -> Column:
    """Every way another post can share something: one value (or nothing) per facet, not all nothing."""
    some = lambda name, values: F.concat(array_of(""), F.transform(values, lambda v: F.concat(F.lit(name + "="), v)))
    parts = [some("a", F.array_distinct("agencies")), some("p", F.array_distinct("programs")),
             some("l", F.array("pillar")), some("s", F.array_compact(F.array(F.nullif("state", F.lit("")))))]
    def crossed(left: Column, right: Column) -> Column:
        return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.concat(x, F.lit("\x01"), y))))
    keys = parts[0]
    for part in parts[1:]:
        keys = crossed(keys, part)
    return F.filter(keys, lambda k: k != "\x01\x01\x01")


def related(posts: DataFrame, n: int = 4) -> DataFrame:
    """The ``n`` best related posts of each post: 4 for a shared agency, 2 for a shared program, 1 for
    the same pillar, 1 for the same state; earlier posts in site order win ties.

    Posts meet through what they share (a value per facet, or several together). Per such key only its
    first ``n + 1`` posts matter: all posts of a key score at least what the key is worth, so a later
    one is always beaten by ``n`` others. The result is exact and no key ever yields pairs of its posts.
    """
    place = F.struct(~F.col("featured"), F.col("publish_at").isNull(), -F.unix_micros(F.col("publish_at").cast("timestamp")),
                     -F.col("id"))
    rows = posts.filter("coalesce(slug, '') <> ''").select(
        "slug", place.alias("o"), F.coalesce("agencies", array_of()).alias("agencies"),
        F.coalesce("programs", array_of()).alias("programs"), F.coalesce("pillar", F.lit("News")).alias("pillar"), "state")
    keyed = rows.withColumn("k", F.explode(_shared_keys()))
    first = Window.partitionBy("k").orderBy("o")
    heads = keyed.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n + 1).select(
        "k", F.struct(*rows.columns).alias("y"))
    met = keyed.select("k", F.struct(*rows.columns).alias("x")).join(heads, "k").filter("x.slug <> y.slug")
    hit = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0)
    score = (hit(F.arrays_overlap("x.agencies", "y.agencies"), 4) + hit(F.arrays_overlap("x.programs", "y.programs"), 2)
             + hit(F.col("x.pillar") == F.col("y.pillar"), 1)
             + hit((F.col("x.state") == F.col("y.state")) & (F.col("x.state") != ""), 1))
    pairs = met.select(F.col("x.slug").alias("slug"), F.col("y.slug").alias("related"), F.col("y.o").alias("o"),
                       score.alias("score")).distinct()
    best = Window.partitionBy("slug").orderBy(F.desc("score"), "o")  # at most (n + 1) per key of the post
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select("slug", "rank", "related", "score")


def section_posts(posts: DataFrame) -> DataFrame:
    """Posts once per section they appear in; the news section holds all."""
    named = [F.when(F.coalesce("pillar", F.lit("News")) == p, F.lit(s)) if p else F.lit(s) for s, p in SECTIONS.items()]
    return posts.select("*", F.explode(F.array_compact(F.array(*named))).alias("section"))


def paginate(posts: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """Page number of every post in every section and the section's number of pages."""
    rows = section_posts(posts).select("section", "id", "slug", "featured", "publish_at")
    placed = running_total(rows, ["section"], _site_order(), name="place")
    pages = rows.groupBy("section").agg(F.ceil(F.count(F.lit(1)) / per_page).alias("pages"))
    return placed.join(F.broadcast(pages), "section").select(
        "section", "id", "slug", "place", F.ceil(F.col("place") / per_page).alias("page"), "pages")


def front_page(posts: DataFrame) -> DataFrame:
    """One lead, three also-rans and eight for the wire."""
    first = posts.orderBy(*_site_order()).limit(12)
    place = F.row_number().over(Window.orderBy(*_site_order()))  # twelve rows
    slot = F.when(F.col("place") == 1, "lead").when(F.col("place") <= 4, "also").otherwise("wire")
    return first.withColumn("place", place).select("place", slot.alias("slot"), "id", "slug")


def real_source(posts: DataFrame) -> DataFrame:
    """Name and address of the publisher, unless they are an aggregator's or a search label."""
    host = F.lower(F.try_parse_url("source_url", F.lit("HOST")))
    web = F.col("source_url").rlike("^(?i)https?://[^/]+")
    label = F.col("source_name").rlike("^(?i)google news") | F.contains("source_name", F.lit(":"))
    return posts.withColumns({
        "real_source_url": F.when(web & ~host.endswith("news.google.com"), F.col("source_url")),
        "real_source_name": F.when(~label, blank_to_null("source_name"))})


def assemble_issue(posts: DataFrame, since: datetime, until: datetime, lead_id: int | None = None) -> DataFrame:
    """Slots of an issue from the period's posts, newest first: lead, feed of four, three people moves,
    three procurements. Without any other pillar all posts feed the lead."""
    window_ = posts.filter((F.col("status") == "published") & (F.col("publish_at") >= F.lit(since)) & (F.col("publish_at") < F.lit(until)))
    rows = window_.withColumn("pillar", F.coalesce(F.nullif("pillar", F.lit("")), F.lit("News")))
    special = F.col("pillar").isin("People", "Procurement")
    newest = [F.desc("publish_at"), F.desc("id")]
    any_rest = rows.agg(F.coalesce(F.max(~special), F.lit(False)).alias("_any"))
    rows = rows.crossJoin(F.broadcast(any_rest)).withColumn("_rest", ~special | ~F.col("_any"))
    asked = F.lit(lead_id).cast("bigint")
    # the lead is the asked post when it is in the period, else the newest of the rest
    lead = (rows.filter((F.col("id") == asked) | F.col("_rest"))
            .orderBy(F.desc(F.coalesce(F.col("id") == asked, F.lit(False))), *newest).limit(1).select(F.col("id").alias("_lead")))
    rows = rows.join(F.broadcast(lead), F.lit(True), "left")
    by = lambda cond, label, most: (rows.filter(cond).orderBy(*newest).limit(most)
                                    .withColumn("place", F.row_number().over(Window.orderBy(*newest)))
                                    .select(F.lit(label).alias("slot"), "place", "id", "pillar", "title"))
    return (by(F.col("id") == F.col("_lead"), "lead", 1)
            .unionByName(by(F.col("_rest") & ~F.col("id").eqNullSafe(F.col("_lead")), "feed", 4))
            .unionByName(by(F.col("pillar") == "People", "moves", 3))
            .unionByName(by(F.col("pillar") == "Procurement", "procurements", 3)))
