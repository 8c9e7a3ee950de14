"""Scores, shortlists and the balanced set of stories to publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.columns import array_of, any_of

# fixed values
ACTIONS = ("publish", "hold", "skip")
FLAGS = ("likely_duplicate", "lead_candidate")
PILLARS = ("Funding", "Procurement", "People", "Policy")
AGGREGATORS = ("news.google.com", "google.com/url", "flipboard.com", "news.yahoo.com/rss")
DUPLICATE, LEAD = FLAGS
MOST_RAISE, SET_SIZE, PILLAR_CAP = 15, 6, 2


def data_tie(items: DataFrame, agency_names: DataFrame, sponsors: DataFrame) -> DataFrame:
    """(id, tie): ``cig`` for a sponsor or a grant program, else ``ntd`` for a known agency, else NULL.

    ``agency_names(name)`` and ``sponsors(name)`` hold lower-cased names.
    """
    named = items.select("id", F.explode("agencies").alias("_a")).select("id", F.lower(F.trim("_a")).alias("name")).distinct()
    kinds = (sponsors.select("name").distinct().withColumn("_k", F.lit(1))
             .unionByName(agency_names.select("name").distinct().withColumn("_k", F.lit(3))))
    by_name = named.join(kinds, "name").groupBy("id").agg(F.min("_k").alias("_k"))
    program = F.exists(F.coalesce("programs", array_of()), lambda p: p.startswith("CIG "))
    best = F.least(F.col("_k"), F.when(program, 2))
    return items.join(by_name, "id", "left").select(
        "id", F.when(best <= 2, "cig").when(best == 3, "ntd").alias("tie"))


REPLY = "array<struct<id:string,score:string,action:string,reason:string,flags:array<string>>>"


def parse_scores(replies: DataFrame) -> DataFrame:
    """Scored replies to rows, keeping only ids that were asked about; of an id answered twice in a batch
    the last answer counts.

    Replies are JSON lists, possibly fenced or wrapped in prose; a broken one gives no rows. Fields are
    read as text and typed leniently. ``replies(batch_id, asked_ids, reply)``.
    """
    bracketed = F.regexp_extract("reply", r"(?s)(\[.*\])", 1)
    rows = replies.select("batch_id", "asked_ids", F.posexplode(F.from_json(bracketed, REPLY)).alias("pos", "r")).select(
        "batch_id", "asked_ids", "pos", "r.*")
    ident = F.col("id").try_cast("bigint")
    score = F.rint(F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)))
    action = F.lower(F.trim(F.col("action")))
    flags = F.filter(F.coalesce("flags", array_of()), lambda f: f.isin(*FLAGS))
    out = rows.withColumn("id", ident).filter(F.array_contains("asked_ids", F.col("id"))).select(
        "batch_id", "id", "pos", F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)).cast("int").alias("score"),
        F.when(action.isin(*ACTIONS), action).otherwise("hold").alias("action"),
        F.trim(F.coalesce("reason", F.lit(""))).alias("reason"), flags.alias("flags"))
    last = out.groupBy("batch_id", "id").agg(F.max_by(F.struct("score", "action", "reason", "flags"), "pos").alias("r"))
    return last.select("batch_id", "id", "r.*")


def merge_scores(items: DataFrame, scores: DataFrame, groups: DataFrame, seen: DataFrame) -> DataFrame:
    """Every item with its score (NULL when unscored), duplicate group, and the duplicate flag when
    something like it was already published."""
    s = scores.select("id", "score", "action", "reason", "flags")
    old = seen.select("id").distinct().withColumn("_seen", F.lit(True))
    rows = items.join(s, "id", "left").join(groups.select("id", F.col("group").alias("dupe_group")), "id", "left").join(old, "id", "left")
    flags = F.coalesce("flags", array_of())
    return rows.withColumns({
        "flags": F.when(F.col("_seen"), F.array_union(flags, array_of(DUPLICATE))).otherwise(flags),
        "reason": F.coalesce("reason", F.lit(""))}).drop("_seen")


def aggregator(url: Column | str) -> Column:
    return any_of(F.contains(F.col(url) if isinstance(url, str) else url, F.lit(a)) for a in AGGREGATORS)


def shortlist(items: DataFrame, n: int) -> DataFrame:
    """Best scored items that can be read in full."""
    open_ = (F.col("score").isNotNull() & (F.coalesce("action", F.lit("")) != "skip")
             & (F.coalesce("source_url", F.lit("")) != "") & ~aggregator("source_url"))
    return items.filter(open_).orderBy(F.desc("score"), "id").limit(n)


def merge_second_pass(first: DataFrame, second: DataFrame) -> DataFrame:
    """Second-pass scores may fall freely and rise a little; group and duplicate flag carry over."""
    s = second.select("id", F.col("score").alias("s_score"), F.col("action").alias("s_action"),
                      F.col("reason").alias("s_reason"), F.col("flags").alias("s_flags"), F.lit(True).alias("deepened"))
    rows = first.join(s, "id", "left").withColumn("deepened", F.coalesce("deepened", F.lit(False)))
    kept = F.filter(F.coalesce("flags", array_of()), lambda f: f == DUPLICATE)
    re = F.col("deepened")
    return rows.withColumns({
        "score": F.when(re, F.least(F.col("s_score"), F.col("score") + MOST_RAISE)).otherwise(F.col("score")),
        "action": F.when(re, F.col("s_action")).otherwise(F.col("action")),
        "reason": F.when(re, F.col("s_reason")).otherwise(F.col("reason")),
        "flags": F.when(re, F.array_sort(F.array_union(F.col("s_flags"), kept))).otherwise(F.col("flags")),
    }).drop("s_score", "s_action", "s_reason", "s_flags")


def _has(flag: str) -> Column:
    return F.array_contains(F.coalesce("flags", array_of()), flag)


def eligible(items: DataFrame) -> DataFrame:
    """Items that may be published. In a group some member confirms as duplicate, the best item claims
    the group before the flag is looked at, so a flagged best item removes the whole group.

    Group facts come from partial aggregates: a group of any size folds to one row.
    """
    confirmed = items.filter(_has(DUPLICATE) & F.col("dupe_group").isNotNull()).select(F.col("dupe_group").alias("_g")).distinct()
    live = items.filter((F.coalesce("action", F.lit("")) != "skip") & (F.col("score") >= 0))
    best = (live.filter("dupe_group IS NOT NULL").groupBy(F.col("dupe_group").alias("_g"))
            .agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("_best"))
            .join(confirmed, "_g", "left_semi"))
    rows = live.join(best, F.col("dupe_group") == F.col("_g"), "left").drop("_g")
    return rows.filter((F.col("_best").isNull() | (F.col("_best") == F.col("id"))) & ~_has(DUPLICATE)).drop("_best")


def balanced_set(items: DataFrame, size: int = SET_SIZE, cap: int = PILLAR_CAP) -> DataFrame:
    """A set spanning the pillars: one per listed pillar, then by score under the cap, then any.

    Only the first ``size`` of each pillar can ever be chosen, so the cut per pillar happens before
    the shuffle and the rest is a top-``size``.
    """
    pillar = F.coalesce("pillar", F.lit(""))
    line = Window.partitionBy("_p").orderBy(F.desc("score"), "id")
    rows = eligible(items).withColumn("_p", pillar).withColumn("_n", F.row_number().over(line)).filter(F.col("_n") <= size)
    turn = F.when((F.col("_n") == 1) & F.col("_p").isin(*PILLARS), 1).when(F.col("_n") <= cap, 2).otherwise(3)
    chosen = rows.withColumn("_t", turn).orderBy("_t", F.desc("score"), "id").limit(size)
    return chosen.drop("_p", "_n", "_t").orderBy(F.desc("score"), "id")


def lead_story(among: DataFrame) -> DataFrame:
    """The best flagged item, else the best item."""
    return among.filter("score IS NOT NULL").orderBy(F.desc(_has(LEAD)), F.desc("score"), "id").limit(1)


def triage_summary(items: DataFrame) -> DataFrame:
    n = F.count_if
    return items.filter("score IS NOT NULL").agg(
        F.count(F.lit(1)).alias("scored"), *[n(F.col("action") == a).alias(a) for a in ACTIONS],
        n(_has(DUPLICATE)).alias("duplicates"), n(_has(LEAD)).alias("lead_candidates"))


def run_cost(usage: DataFrame, prices: DataFrame, default: str) -> DataFrame:
    """Money per run from token counts and a price table of a few rows (per million tokens)."""
    p = prices.select(F.col("model").alias("_m"), "price_in", "price_out")
    base = prices.filter(F.col("model") == default).agg(F.max("price_in").alias("_in"), F.max("price_out").alias("_out"))
    rows = usage.join(p, F.col("model") == F.col("_m"), "left").crossJoin(F.broadcast(base))
    cost = (F.col("input_tokens") / 1e6 * F.coalesce("price_in", "_in")
            + F.col("output_tokens") / 1e6 * F.coalesce("price_out", "_out"))
    return rows.select(*usage.columns, (F.rint(cost * 10_000) / 10_000).alias("cost"))


def embed_text(headline: Column | str, summary: Column | str) -> Column:
    """Text to embed: the headline, then the words of the summary."""
    head = F.nullif(F.trim(F.coalesce(headline, F.lit(""))), F.lit(""))
    tail = F.nullif(F.trim(F.regexp_replace(F.coalesce(summary, F.lit("")), r"\s+", " ")), F.lit(""))
    return F.concat_ws(". ", head, tail)


def embed_backlog(items: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """Rows without a vector, or with one of another width."""
    return items.filter(F.col(vector).isNull() | (F.size(vector) != width))


def last_recommendation(items: DataFrame) -> DataFrame:
    """Stored scores in order with the time of the latest run."""
    rows = items.filter("recommended_at IS NOT NULL")
    ran = rows.agg(F.max("recommended_at").alias("ran_at"))
    return rows.crossJoin(F.broadcast(ran)).orderBy(F.desc_nulls_last("score"), "id")
