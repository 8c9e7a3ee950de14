"""Image library: provenance, review, matching pictures to stories and names to candidates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.functions.columns import any_of, array_of, first_rule, is_blank, lookup
from headway.sources import buckets

# fixed values
KINDS = ("logo", "stock")
SOURCES = ("wikimedia", "unsplash", "pexels", "manual")
STATUSES = ("candidate", "approved", "rejected")
PROVENANCE = ("source", "source_url", "license", "attribution")
LICENCE_CLASSES = ("free", "non-free", "unclear")
FREE_HINTS = ("public domain", "pd-", "cc0", "cc by", "cc-by", "attribution", "gfdl")
NONFREE_HINTS = ("non-free", "nonfree", "fair use", "fairuse", "copyright", "trademark")
# fixed values: topic -> words that bring it up
TOPIC_WORDS = {
    "bus": ("bus", "brt", "bus rapid"), "light-rail": ("light rail", "streetcar", "tram"),
    "heavy-rail": ("subway", "heavy rail", "metro rail"), "commuter-rail": ("commuter rail", "regional rail", "commuter train"),
    "ferry": ("ferry",), "station": ("station", "terminal", "platform"),
    "construction": ("construction", "groundbreak", "build", "extension"),
    "funding": ("grant", "funding", "budget", "appropriat", "million", "billion"),
    "policy": ("policy", "legislat", "reauthoriz", "rule", "congress"),
    "people": ("appoint", "named", "ceo", "general manager", "director", "hire"),
    "procurement": ("rfp", "contract", "solicitation", "award", "bid", "design-build"),
    "maintenance": ("maintenance", "overhaul", "state of good repair"),
}
# fixed values: modes and pillars -> topics
MODE_TOPICS = {"Bus": "bus", "BRT": "bus", "Light Rail": "light-rail", "Heavy Rail": "heavy-rail",
               "Commuter Rail": "commuter-rail", "Streetcar": "light-rail", "Ferry": "ferry"}
PILLAR_TOPICS = {"Funding": "funding", "Policy": "policy", "People": "people", "Procurement": "procurement"}
# fixed values: words that do not tell agencies apart
GENERIC = (r"\b(the|of|and|inc|authority|agency|district|department|transit|transportation|"
           r"metropolitan|regional|county|city|public|system|services|service)\b")
TRANSIT_TITLE = (r"(?i)transit|transport|railway|rail|metro|bus|authority|agency|commuter|"
                 r"subway|tramway|council|district")
MATCH_AT, COVERED_AT = 0.6, 0.9


# ---- gate and review ----------------------------------------------------------------------------

def provenance_gate(assets: DataFrame) -> DataFrame:
    """Adds ``reason``: what is missing or unknown, NULL for an asset that may be stored."""
    missing = F.array_join(F.array_compact(F.array(*[F.when(is_blank(f), f) for f in PROVENANCE])), ", ")
    reason = (F.when(missing != "", F.concat(F.lit("missing "), missing))
              .when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "unknown source")
              .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind")
              .when(is_blank("url") & is_blank("file_path"), "no image"))
    return assets.withColumn("reason", reason)


ASSET_KEY = ("kind", "agency", "source_url")
REFRESHED = ("topic_tags", "url", "file_path", "width", "height", "license", "attribution", "notes")


def asset_key() -> Column:
    return F.struct(F.col("kind"), F.lower(F.coalesce("agency", F.lit(""))).alias("agency"), F.col("source_url"))


def merge_assets(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Upsert by kind, agency whatever its case, and source address; a review decision always stays."""
    n = new.withColumn("_k", asset_key()).select("_k", F.struct(*new.columns).alias("n"))
    o = stored.withColumn("_k", asset_key()).select("_k", F.struct(*stored.columns).alias("o"))
    both = n.join(o, "_k", "full_outer")
    pick = lambda c: (F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in REFRESHED
                      else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")))
    outcome = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "untouched").otherwise("updated")
    cols = [c for c in new.columns if c not in ("id", "status", "reviewed_at")]
    return both.select(F.col("o.id").alias("id"), *[pick(c).alias(c) for c in cols],
                       F.coalesce("o.status", F.lit("candidate")).alias("status"),
                       F.col("o.reviewed_at").alias("reviewed_at"), outcome.alias("outcome"))


def merge_stored_assets(path: str, schema: T.StructType, new: DataFrame, count: int = buckets.BUCKETS) -> list[int]:
    """``merge_assets`` into a picture table stored in buckets of its key; only touched buckets are read and written."""
    return buckets.merge(new, path, schema, asset_key(), asset_key(), merge_assets, count)


def supersede(assets: DataFrame, keep: DataFrame, now: datetime) -> DataFrame:
    """Older logo candidates of an agency give way to a newly kept one. ``keep(agency, keep_id)``."""
    k = keep.select(F.lower("agency").alias("_a"), "keep_id").groupBy("_a").agg(F.max("keep_id").alias("keep_id"))
    rows = assets.join(k, F.lower("agency") == F.col("_a"), "left")
    out = ((F.col("kind") == "logo") & (F.col("status") == "candidate") & F.col("keep_id").isNotNull() & (F.col("id") != F.col("keep_id")))
    note = F.concat(F.coalesce("notes", F.lit("")), F.format_string(" | superseded by a later fetch (id %d)", "keep_id"))
    return rows.withColumns({"notes": F.when(out, note).otherwise(F.col("notes")),
                             "reviewed_at": F.when(out, F.lit(now)).otherwise(F.col("reviewed_at")),
                             "status": F.when(out, "rejected").otherwise(F.col("status"))}).drop("_a", "keep_id")


def review_cascade(agencies: DataFrame, assets: DataFrame, reviews: DataFrame) -> DataFrame:
    """Agencies after a batch of reviews: an approved logo becomes its agency's logo, a logo no longer
    approved or no longer stored is cleared. ``reviews(image_id, status, at)``; the latest counts."""
    last = reviews.groupBy("image_id").agg(F.max_by("status", "at").alias("verdict"), F.max("at").alias("at"))
    logos = assets.filter("kind = 'logo'").select(F.col("id").alias("image_id"), F.lower("agency").alias("_a"))
    judged = logos.join(last, "image_id")
    named = (judged.filter("verdict = 'approved' AND _a IS NOT NULL").groupBy("_a")
             .agg(F.max_by("image_id", F.struct("at", "image_id")).alias("_new")))
    gone = judged.filter("verdict <> 'approved'").select(F.col("image_id").alias("_gone"))
    known = assets.select(F.col("id").alias("_known"))
    rows = (agencies.join(named, F.lower("name") == F.col("_a"), "left").drop("_a")
            .withColumn("_now", F.coalesce("_new", "logo_image_id"))
            .join(gone, F.col("_now") == F.col("_gone"), "left").join(known, F.col("_now") == F.col("_known"), "left"))
    keep = F.col("_gone").isNull() & F.col("_known").isNotNull()
    return rows.withColumn("logo_image_id", F.when(keep, F.col("_now"))).select(*agencies.columns)


def public_url(base: str) -> Column:
    made = F.when(~is_blank("file_path"), F.concat(F.lit(base.rstrip("/") + "/api/images/file/"), F.col("id").cast("string")))
    return F.coalesce(F.nullif("url", F.lit("")), made)


def approved_logo(assets: DataFrame, base: str = "") -> DataFrame:
    """The approved logo per agency: newest review, then highest id; with its public address."""
    order = F.struct(F.coalesce(F.unix_micros(F.col("reviewed_at").cast("timestamp")), F.lit(-(2 ** 62))), F.col("id"))
    good = assets.filter("kind = 'logo' AND status = 'approved' AND agency IS NOT NULL").withColumn("url", public_url(base))
    return (good.groupBy(F.lower("agency").alias("agency_key"))
            .agg(F.max_by(F.struct("id", "url", "license", "attribution", "source_url"), order).alias("l"))
            .select("agency_key", F.col("l.id").alias("id"), "l.url", "l.license", "l.attribution", "l.source_url"))


def approved_stock(stories: DataFrame, assets: DataFrame, n: int, base: str = "") -> DataFrame:
    """Approved stock per story by number of shared topics, then highest id. ``stories(story_id, tags)``.

    Stories are folded to their distinct topic sets, of which a closed vocabulary allows few. For each
    combination of topics only its newest ``n`` assets can be anyone's best, so those are the only
    rows a topic set meets, however many assets carry a popular topic.
    """
    sets = stories.select(F.sort_array(F.array_distinct("tags")).alias("tags")).filter("size(tags) > 0").distinct()
    stock = assets.filter("kind = 'stock' AND status = 'approved'").select(
        "id", F.sort_array(F.array_distinct("topic_tags")).alias("topic_tags"), public_url(base).alias("url"))
    # assets with the same topics are interchangeable but for their id: the newest n of each set matter
    line = Window.partitionBy("topic_tags").orderBy(F.desc("id"))
    heads = stock.withColumn("_n", F.row_number().over(line)).filter(F.col("_n") <= n).drop("_n")
    groups = heads.groupBy("topic_tags").agg(F.sort_array(F.collect_list(F.struct((-F.col("id")).alias("neg"), "id", "url"))).alias("best"))
    met = (sets.withColumn("t", F.explode("tags")).join(groups.withColumn("t", F.explode("topic_tags")), "t")
           .select("tags", "topic_tags", "best").distinct())
    scored = met.select("tags", F.size(F.array_intersect("tags", "topic_tags")).alias("overlap"), F.inline("best"))
    top = Window.partitionBy("tags").orderBy(F.desc("overlap"), F.desc("id"))
    ranked = (scored.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= n)
              .select(F.col("tags").alias("_tags"), "rank", "id", "url", "overlap"))
    mine = stories.select("story_id", F.sort_array(F.array_distinct("tags")).alias("_tags"))
    return mine.join(ranked, "_tags").select("story_id", "rank", "id", "url", "overlap")


# ---- topics and cascade -------------------------------------------------------------------------

def topics_for(text: Column | str, mode: Column | str, pillar: Column | str) -> Column:
    """Topic tags of a story in fixed order: from its words, then its modes, then its pillar."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    tags = lambda t: F.array(*[F.when(any_of(F.contains(t, F.lit(w)) for w in ws), F.lit(tag)) for tag, ws in TOPIC_WORDS.items()])
    said = F.transform(F.array(low), tags)[0]  # a text is lower-cased once, not for every word
    modes = F.transform(F.coalesce(F.col(mode) if isinstance(mode, str) else mode, array_of()), lambda m: lookup(MODE_TOPICS, m))
    from_pillar = F.array(lookup(PILLAR_TOPICS, F.coalesce(F.col(pillar) if isinstance(pillar, str) else pillar, F.lit(""))))
    return F.array_distinct(F.array_compact(F.concat(said, modes, from_pillar)))


def _logo_hits(stories: DataFrame, assets: DataFrame) -> DataFrame:
    """(story_id, pos, agency, logo) for every named agency with an approved logo."""
    named = stories.select("story_id", F.posexplode("agencies").alias("pos", "agency")).filter("agency <> ''")
    return named.join(approved_logo(assets), F.lower("agency") == F.col("agency_key")).drop("agency_key")


def pick_image(stories: DataFrame, assets: DataFrame) -> DataFrame:
    """Existing picture, else the first agency with a logo, else the best stock, else none; with why.

    ``stories(story_id, image_url, image_source, agencies, tags)``.
    """
    first = _logo_hits(stories, assets).groupBy("story_id").agg(
        F.min_by(F.struct("id", "url", "agency"), "pos").alias("logo"))
    stock = approved_stock(stories, assets, 1).select("story_id", F.struct("id", "url").alias("stock"))
    rows = stories.join(first, "story_id", "left").join(stock, "story_id", "left")
    existing = ~is_blank("image_url") & ~F.col("image_source").eqNullSafe(F.lit("none"))
    choice = (F.when(existing, "existing").when(F.col("logo").isNotNull(), "logo")
              .when(F.col("stock").isNotNull(), "stock").otherwise("none"))
    reason = (F.when(choice == "existing", "This post already carries a chosen picture.")
              .when(choice == "logo", F.format_string("Story is about %s, which has an approved logo.", F.col("logo.agency")))
              .when(choice == "stock", "Best topic overlap.")
              .otherwise(F.format_string("No approved image matches this story (topics: %s).",
                                         F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise("none detected"))))
    return rows.select("story_id", choice.alias("choice"),
                       F.when(choice == "logo", F.col("logo.id")).when(choice == "stock", F.col("stock.id")).alias("image_id"),
                       F.when(choice == "existing", F.col("image_url")).when(choice == "logo", F.col("logo.url"))
                       .when(choice == "stock", F.col("stock.url")).alias("url"), reason.alias("reason"))


def fill_images(posts: DataFrame, assets: DataFrame) -> DataFrame:
    """Posts without a picture, and not deliberately bare, take the cascade's picture and its credit."""
    picked = pick_image(posts.withColumnRenamed("id", "story_id"), assets).select(
        F.col("story_id").alias("id"), "choice", F.col("url").alias("_url"), F.col("image_id").alias("image_library_id"))
    credit = attach_credit(picked, assets).withColumnRenamed("image_library_id", "_pic")
    rows = posts.drop(*CREDIT).join(credit, "id", "left")
    fill = F.col("choice").isin("logo", "stock") & ~is_blank("_url") & ~F.col("image_source").eqNullSafe(F.lit("none"))
    credits = {c: F.when(fill, F.col(c)) for c in CREDIT}
    if "image_library_id" in posts.columns:
        credits["image_library_id"] = F.when(fill, F.col("_pic")).otherwise(F.col("image_library_id"))
    return rows.withColumns({"image_url": F.when(fill, F.col("_url")).otherwise(F.col("image_url")),
                             "image_source": F.when(fill, F.concat(F.lit("library-"), "choice")).otherwise(F.col("image_source"))} | credits
                            ).drop("choice", "_url", "_pic")


def image_shortlist(stories: DataFrame, assets: DataFrame, n: int = 5) -> DataFrame:
    """Ranked pictures per story: logos in agency order, then stock; each picture once."""
    logos = _logo_hits(stories, assets).select("story_id", F.lit(0).alias("tier"), F.col("pos").alias("at"), "id", "url",
                                               F.lit("logo").alias("kind"))
    stock = approved_stock(stories, assets.filter(public_url("").isNotNull()), n).select(
        "story_id", F.lit(1).alias("tier"), F.col("rank").alias("at"), "id", "url", F.lit("stock").alias("kind"))
    both = logos.unionByName(stock).filter("coalesce(url, '') <> ''")
    once = both.groupBy("story_id", "id").agg(F.min(F.struct("tier", "at", "kind", "url")).alias("b"))
    place = F.row_number().over(Window.partitionBy("story_id").orderBy("b.tier", "b.at", "id"))
    return (once.withColumn("place", place).filter(F.col("place") <= n)
            .select("story_id", "place", F.col("id").alias("asset_id"), "b.kind", "b.url"))


CREDIT = ("image_license", "image_attribution", "image_source_url", "image_kind")


def attach_credit(posts: DataFrame, assets: DataFrame) -> DataFrame:
    """Licence and credit of the library picture a post carries."""
    dim = assets.select(F.col("id").alias("image_library_id"), F.col("license").alias("image_license"),
                        F.col("attribution").alias("image_attribution"), F.col("source_url").alias("image_source_url"),
                        F.col("kind").alias("image_kind"))
    return posts.join(dim, "image_library_id", "left")


# ---- reports ------------------------------------------------------------------------------------

def logo_coverage(agencies: DataFrame, assets: DataFrame) -> DataFrame:
    counts = (assets.filter("kind = 'logo'").groupBy(F.lower("agency").alias("_a"))
              .agg(F.count_if(F.col("status") == "candidate").alias("candidates"),
                   F.count_if(F.col("status") == "rejected").alias("rejected")))
    rows = agencies.join(counts, F.lower("name") == F.col("_a"), "left").drop("_a").fillna(0, ["candidates", "rejected"])
    return rows.select(F.col("name").alias("agency"), "state", F.col("logo_image_id").isNotNull().alias("approved"),
                       "candidates", "rejected")


def coverage_totals(coverage: DataFrame) -> DataFrame:
    waiting = ~F.col("approved") & (F.col("candidates") > 0)
    return coverage.agg(F.count(F.lit(1)).alias("total"), F.count_if("approved").alias("with_approved"),
                        F.count_if(waiting).alias("awaiting_review"),
                        F.count_if(~F.col("approved") & (F.col("candidates") == 0)).alias("none"))


def library_stats(assets: DataFrame) -> DataFrame:
    """Counts by kind and status and by source, from one pass."""
    sets = assets.groupingSets([["kind", "status"], ["source"]], "kind", "status", "source").agg(F.count(F.lit(1)).alias("n"))
    return sets.select("kind", "status", "source", "n")


def library_listing(assets: DataFrame, kind: str = "logo", status: str | None = None, q: str | None = None,
                    limit: int | None = None) -> DataFrame:
    rows = assets.filter(F.col("kind") == kind)
    if status and status != "all":
        rows = rows.filter(F.col("status") == status)
    if q:
        hay = [F.coalesce("agency", F.lit("")), F.array_join(F.coalesce("topic_tags", array_of()), " "), F.coalesce("notes", F.lit(""))]
        rows = rows.filter(any_of(F.contains(F.lower(h), F.lit(q.lower())) for h in hay))
    first = F.trim(F.split(F.coalesce("notes", F.lit("")), r" \| ")[0])
    rows = rows.withColumn("license_class", F.when(first.isin(*LICENCE_CLASSES), first))
    rows = rows.orderBy("status", F.lower(F.coalesce("agency", F.lit(""))), "id")
    return rows if limit is None else rows.limit(limit)


def browse_assets(assets: DataFrame, base: str, q: str | None = None, kind: str | None = None, *, n: int) -> DataFrame:
    rows = assets.filter("status = 'approved'")
    if kind in KINDS:
        rows = rows.filter(F.col("kind") == kind)
    if q:
        hay = [F.coalesce("agency", F.lit("")), F.array_join(F.coalesce("topic_tags", array_of()), " ")]
        rows = rows.filter(any_of(F.contains(F.lower(h), F.lit(q.lower())) for h in hay))
    return (rows.withColumn("url", public_url(base))
            .orderBy("kind", F.lower(F.coalesce("agency", F.lit(""))), "id").limit(n))


# ---- names --------------------------------------------------------------------------------------

def compact_name(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def acronym(c: Column | str) -> Column:
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9\s]", " "), r"\s+"), lambda w: w != "")
    return F.lower(F.array_join(F.transform(parts, lambda w: F.left(w, F.lit(1))), ""))


def distinctive(c: Column | str) -> Column:
    """Words of a name that tell it apart."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.array_distinct(F.filter(F.split(F.regexp_replace(t, GENERIC, " "), r"\s+"), lambda w: w != ""))


def name_score(a: Column | str, b: Column | str) -> Column:
    """1 for equal names or an acronym, 0 for fewer than two shared distinctive words, else Jaccard."""
    ca, cb, wa, wb = compact_name(a), compact_name(b), distinctive(a), distinctive(b)
    shared = F.size(F.array_intersect(wa, wb))
    blank = (ca == "") | (cb == "")
    return (F.when(blank, 0.0).when((ca == cb) | (ca == acronym(b)) | (cb == acronym(a)), 1.0)
            .when(shared < 2, 0.0).otherwise(shared / F.size(F.array_union(wa, wb))))


def scored_names(left: DataFrame, right: DataFrame, at: float) -> DataFrame:
    """(l, r, score) of all name pairs scoring at least ``at``.

    Pairs meet through equal compact forms, an acronym, or the two rarest-first words a pair with
    Jaccard ``at`` must share; nothing is compared through a common word alone.
    """
    def prepared(df: DataFrame, c: str) -> DataFrame:
        return df.select(F.col(c)).distinct().select(F.col(c), compact_name(c).alias("c"), acronym(c).alias("ac"), distinctive(c).alias("ws"))
    lp, rp = prepared(left, "l"), prepared(right, "r")
    whole = lp.select("l", F.explode(F.array_distinct(F.array(F.concat(F.lit("c:"), "c"), F.concat(F.lit("a:"), "ac")))).alias("k"))
    other = rp.select("r", F.explode(F.array_distinct(F.array(F.concat(F.lit("c:"), "c"), F.concat(F.lit("a:"), "c"),
                                                              F.concat(F.lit("b:"), "ac")))).alias("k"))
    whole = whole.unionByName(lp.select("l", F.concat(F.lit("b:"), "c").alias("k"))).filter("length(k) > 2")
    met = whole.join(other, "k").select("l", "r")
    spread = (lp.select(F.explode("ws").alias("w")).unionByName(rp.select(F.explode("ws").alias("w")))
              .groupBy("w").agg(F.count(F.lit(1)).alias("df")))

    def prefix(df: DataFrame, c: str) -> DataFrame:
        words = df.filter("size(ws) > 1").select(c, F.explode("ws").alias("w")).join(spread, "w")
        o = words.groupBy(c).agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("o"))
        need = F.greatest(F.ceil(F.size("o") * at - 1e-9), F.lit(2))
        return o.select(c, F.explode(F.slice("o", F.lit(1), (F.size("o") - need + 1).cast("int"))["w"]).alias("w"))
    by_word = prefix(lp, "l").join(prefix(rp, "r"), "w").select("l", "r")
    return (met.unionByName(by_word).distinct().withColumn("score", name_score("l", "r")).filter(F.col("score") >= at))


def best_match(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best candidate title per entity over all its names, at 0.6 or more; ties prefer a transit-like
    title, then the shortest. ``names(entity, name)``, ``candidates(title)``."""
    low = F.lower("title")
    usable = candidates.filter(~any_of(low.startswith(p) for p in ("list of", "history of", "timeline of"))
                               & ~F.contains(low, F.lit("(disambiguation)"))).select("title").distinct()
    bare = F.trim(F.regexp_replace("title", r"\s*\([^)]*\)\s*$", ""))
    forms = usable.select("title", F.explode(F.array_distinct(F.array(F.col("title"), bare))).alias("r"))
    pairs = scored_names(names.select(F.col("name").alias("l")).filter("l <> ''"), forms.select("r"), MATCH_AT)
    hits = names.join(pairs, F.col("name") == F.col("l")).join(forms, "r")
    order = F.struct(-F.col("score"), ~F.col("title").rlike(TRANSIT_TITLE), F.length("title"), F.col("title"))
    return (hits.groupBy("entity").agg(F.min_by(F.struct("title", "score"), order).alias("b"))
            .select("entity", F.col("b.title").alias("title"), F.round("b.score", 2).alias("score")))


def unmatched_sponsors(sponsors: DataFrame, names: DataFrame) -> DataFrame:
    """Sponsors that no known agency name covers. ``sponsors(sponsor)``, ``names(name)``."""
    s = sponsors.select(F.col("sponsor").alias("l")).filter("coalesce(l, '') <> ''").distinct()
    covered = scored_names(s, names.select(F.col("name").alias("r")).filter("r <> ''"), COVERED_AT).select("l").distinct()
    return s.join(covered, "l", "left_anti").select(F.col("l").alias("sponsor"))


def licence_class(licence: Column | str, artist: Column | str, hosted_on: Column | str) -> Column:
    text = F.lower(F.concat_ws(" ", licence, artist))
    says = lambda hints: any_of(F.contains(text, F.lit(h)) for h in hints)
    return first_rule([(says(NONFREE_HINTS) & ~says(("cc by", "cc-by", "public domain")), "non-free"), (says(FREE_HINTS), "free"),
                       (F.coalesce(F.col(hosted_on) if isinstance(hosted_on, str) else hosted_on, F.lit("")) == "commons", "free")],
                      F.lit("unclear"))
