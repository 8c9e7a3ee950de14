"""Queries over the image library."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from headway.operators import images
from headway.plans import catalog_posts  # noqa: F401  (shared WITH entries)
from headway.plans.catalog import common, query
from headway.session import scratch
from headway.sources import buckets

common("assets", """
  SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'logo' ELSE 'stock' END AS kind, p_brand AS agency, string_split(p_name, ' ') AS topic_tags,
    CASE WHEN p_partkey % 9 = 0 THEN '/files/' || p_partkey END AS file_path, CASE WHEN p_partkey % 9 <> 0 THEN 'https://cdn.example/' || p_partkey || '.svg' END AS url,
    CASE WHEN p_partkey % 31 = 0 THEN '' ELSE ['wikimedia', 'unsplash', 'flickr'][p_partkey % 3 + 1] END AS source,
    ['CC BY 4.0', 'Non-free fair use', 'Unknown', 'Public domain, trademark'][p_partkey % 4 + 1] AS license, CASE WHEN p_partkey % 37 = 0 THEN '  ' ELSE 'Someone' END AS attribution,
    CASE p_size % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'candidate' ELSE 'rejected' END AS status, ['free', 'non-free', 'odd'][p_partkey % 3 + 1] || ' | note' AS notes,
    CASE WHEN p_partkey % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(p_size) END AS reviewed_at FROM part""")
common("logos", """
  SELECT lower(agency) AS agency_key, id, coalesce(url, '/api/images/file/' || id) AS url, license FROM (SELECT *, row_number() OVER (PARTITION BY lower(agency) ORDER BY reviewed_at DESC NULLS LAST, id DESC) AS r
    FROM assets WHERE kind = 'logo' AND status = 'approved') WHERE r = 1""", "assets")
_words = "['red', 'blue', 'small', 'ring', 'bolt', 'widget']"
common("stories", f"""
  SELECT id AS story_id, image_url, image_source, agencies, CASE WHEN id % 7 = 0 THEN []::VARCHAR[] ELSE [({_words})[id % 6 + 1], ({_words})[(id + 2) % 6 + 1]] END AS tags FROM posts""", "posts")
common("stock", """
  SELECT story_id, id, url, overlap, row_number() OVER (PARTITION BY story_id ORDER BY overlap DESC, id DESC) AS rank FROM (
    SELECT s.story_id, a.id, coalesce(a.url, '/api/images/file/' || a.id) AS url, len(list_intersect(s.tags, a.topic_tags))::INTEGER AS overlap FROM stories s JOIN assets a ON list_has_any(s.tags, a.topic_tags)
    WHERE a.kind = 'stock' AND a.status = 'approved')""", "stories", "assets")
common("logo_hits", """
  SELECT story_id, pos, id, url, agency FROM (SELECT story_id, unnest(agencies) AS agency, generate_subscripts(agencies, 1) AS pos FROM stories) JOIN logos ON agency_key = lower(agency)""", "stories", "logos")
common("brands", """
  SELECT upper(p_brand) AS name, 'XX' AS state, CASE WHEN n % 3 = 0 THEN n * 2 END AS logo_image_id FROM (SELECT DISTINCT p_brand, regexp_extract(p_brand, '(\\d+)$', 1)::BIGINT AS n FROM part)""")


@query("provenance_gate", """
  SELECT id, CASE WHEN source = '' OR trim(attribution) = '' THEN 'missing ' || concat_ws(', ', CASE WHEN source = '' THEN 'source' END, CASE WHEN trim(attribution) = '' THEN 'attribution' END)
    WHEN source = 'flickr' THEN 'unknown source' END AS reason FROM assets""", ("assets",))
def provenance_gate(t):
    return images.provenance_gate(t.assets).select("id", "reason")


@query("merge_assets", """
  SELECT coalesce(n.id, o.id) AS key, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'untouched' ELSE 'updated' END AS outcome, coalesce(o.status, 'candidate') AS status,
    CASE WHEN n.id IS NOT NULL THEN 'new' ELSE o.notes END AS notes
  FROM (SELECT * FROM assets WHERE id % 3 <> 0) o FULL OUTER JOIN (SELECT * FROM assets WHERE id % 5 <> 0) n ON n.id = o.id""", ("assets",))
def merge_assets(t):
    new = t.assets.filter("id % 5 <> 0").withColumns({"notes": F.lit("new"), "agency": F.upper("agency")})
    out = images.merge_assets(new, t.assets.filter("id % 3 <> 0"))
    return out.select(F.regexp_extract("source_url", r"(\d+)$", 1).cast("bigint").alias("key"), "outcome", "status", "notes")


@query("merge_stored_assets", """
  SELECT id AS key, CASE WHEN id % 3 = 0 THEN 'candidate' ELSE status END AS status, CASE WHEN id % 5 <> 0 THEN 'new' ELSE notes END AS notes, lower(agency) AS agency
  FROM assets WHERE id % 3 <> 0 OR id % 5 <> 0""", ("assets",))
def merge_stored_assets(t):
    """The same upsert into a picture table stored in buckets of its key."""
    new = t.assets.filter("id % 5 <> 0").withColumns({"notes": F.lit("new"), "agency": F.upper("agency")})
    have, path = t.assets.filter("id % 3 <> 0"), scratch(t.spark, "assets")
    buckets.store(have, path, images.asset_key())
    images.merge_stored_assets(path, have.schema, new)
    out = buckets.read(t.spark, path, have.schema)
    return out.select(F.regexp_extract("source_url", r"(\d+)$", 1).cast("bigint").alias("key"), "status", "notes", F.lower("agency").alias("agency"))


@query("supersede_candidates", """
  SELECT a.id, CASE WHEN kind = 'logo' AND status = 'candidate' AND k.keep_id IS NOT NULL AND a.id <> k.keep_id THEN 'rejected' ELSE status END AS status
  FROM assets a LEFT JOIN (SELECT lower(p_brand) AS b, max(p_partkey) AS keep_id FROM part WHERE p_partkey % 2 = 0 AND p_size % 3 = 1 GROUP BY 1) k ON k.b = lower(agency)""", ("assets",))
def supersede_candidates(t):
    keep = t.assets.filter("kind = 'logo' AND status = 'candidate'").groupBy("agency").agg(F.max("id").alias("keep_id"))
    return images.supersede(t.assets, keep, datetime(2024, 3, 1)).select("id", "status")


@query("review_cascade", """
  SELECT b.name, CASE WHEN g.id IS NULL AND k.id IS NOT NULL THEN coalesce(n.id, b.logo_image_id) END AS logo_image_id FROM brands b
  LEFT JOIN (SELECT upper(agency) AS u, max(id) AS id FROM assets WHERE kind = 'logo' AND id % 40 = 0 GROUP BY 1) n ON n.u = b.name
  LEFT JOIN (SELECT id FROM assets WHERE kind = 'logo' AND id % 40 = 6) g ON g.id = coalesce(n.id, b.logo_image_id)
  LEFT JOIN assets k ON k.id = coalesce(n.id, b.logo_image_id)""", ("brands", "assets"))
def review_cascade(t):
    k = F.col("id")
    day = F.lit(datetime(2024, 3, 1)).cast("timestamp")
    reviews = t.assets.filter("id % 40 = 0 OR id % 40 = 6").select(k.alias("image_id"), F.when(k % 40 == 0, "approved").otherwise("rejected").alias("status"), day.alias("at"))
    return images.review_cascade(t.brands, t.assets, reviews).select("name", "logo_image_id")


@query("approved_logos", "SELECT agency_key, id FROM logos", ("logos",))
def approved_logos(t):
    return images.approved_logo(t.assets).select("agency_key", "id")


@query("approved_stock", "SELECT story_id, rank, id, overlap FROM stock WHERE rank <= 6", ("stock",))
def approved_stock(t):
    return images.approved_stock(t.stories, t.assets, 6).select("story_id", "rank", "id", "overlap")


_topic_rules = ", ".join("CASE WHEN " + " OR ".join(f"contains(low, '{w}')" for w in ws) + f" THEN '{tag}' END" for tag, ws in images.TOPIC_WORDS.items())


@query("story_topics", f"""
  SELECT id, array_to_string(list_filter([""" + _topic_rules + """, CASE WHEN pillar = 'Funding' AND NOT (""" + " OR ".join(f"contains(low, '{w}')" for w in images.TOPIC_WORDS["funding"]) + """) THEN 'funding' END],
    lambda x: x IS NOT NULL), ',') AS topics FROM (SELECT id, CASE WHEN pillar = 'Funding' THEN pillar END AS pillar, lower(headline || ' bus') AS low FROM items)""", ("items",))
def story_topics(t):
    only = F.when(F.col("pillar") == "Funding", F.col("pillar"))
    topics = images.topics_for(F.concat("headline", F.lit(" bus")), F.array(F.lit("Bus"), F.lit("Hovercraft")), only)
    return t.items.select("id", F.array_join(topics, ",").alias("topics"))


@query("pick_image", """
  SELECT s.story_id, CASE WHEN existing THEN 'existing' WHEN l.id IS NOT NULL THEN 'logo' WHEN k.id IS NOT NULL THEN 'stock' ELSE 'none' END AS choice,
    CASE WHEN existing THEN NULL WHEN l.id IS NOT NULL THEN l.id ELSE k.id END AS image_id
  FROM (SELECT *, image_url IS NOT NULL AND image_source IS DISTINCT FROM 'none' AS existing FROM stories) s
  LEFT JOIN (SELECT story_id, min_by(id, pos) AS id FROM logo_hits GROUP BY 1) l USING (story_id) LEFT JOIN (SELECT * FROM stock WHERE rank = 1) k USING (story_id)""", ("stories", "logo_hits", "stock"))
def pick_image(t):
    return images.pick_image(t.stories, t.assets).select("story_id", "choice", "image_id")


@query("filled_images", """
  SELECT f.id, f.image_source, f.image_url, a.license AS image_license, a.kind AS image_kind FROM (
    SELECT s.story_id AS id, image_url IS NULL AND image_source IS DISTINCT FROM 'none' AS bare,
      CASE WHEN bare AND l.id IS NOT NULL THEN 'library-logo' WHEN bare AND k.id IS NOT NULL THEN 'library-stock' ELSE image_source END AS image_source,
      CASE WHEN bare THEN coalesce(l.url, k.url) ELSE image_url END AS image_url, CASE WHEN bare THEN coalesce(l.id, k.id) END AS pic
    FROM stories s LEFT JOIN (SELECT story_id, min_by(id, pos) AS id, min_by(url, pos) AS url FROM logo_hits GROUP BY 1) l USING (story_id)
    LEFT JOIN (SELECT * FROM stock WHERE rank = 1) k USING (story_id)) f LEFT JOIN assets a ON a.id = f.pic""",
       ("stories", "logo_hits", "stock", "assets"))
def filled_images(t):
    posts_ = t.stories.withColumnRenamed("story_id", "id")
    return images.fill_images(posts_, t.assets).select("id", "image_source", "image_url", "image_license", "image_kind")


@query("image_shortlist", """
  SELECT story_id, place, id AS asset_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY tier, at0, id) AS place FROM (
    SELECT story_id, id, 'logo' AS kind, 0 AS tier, min(pos) AS at0 FROM logo_hits GROUP BY 1, 2
    UNION ALL SELECT story_id, id, 'stock', 1, rank FROM stock)) WHERE place <= 5""", ("logo_hits", "stock"))
def image_shortlist(t):
    return images.image_shortlist(t.stories, t.assets).select("story_id", "place", "asset_id", "kind")


@query("image_credits", "SELECT p.id, a.license AS image_license, a.kind AS image_kind FROM posts p LEFT JOIN assets a ON a.id = image_library_id", ("posts", "assets"))
def image_credits(t):
    return images.attach_credit(t.posts, t.assets).select("id", "image_license", "image_kind")


common("coverage", """
  SELECT name AS agency, logo_image_id IS NOT NULL AS approved, count(*) FILTER (WHERE status = 'candidate') AS candidates, count(*) FILTER (WHERE status = 'rejected') AS rejected
  FROM brands LEFT JOIN assets ON upper(agency) = name AND kind = 'logo' GROUP BY 1, 2""", "brands", "assets")


@query("logo_coverage", "SELECT agency, approved, candidates, rejected FROM coverage", ("coverage",))
def logo_coverage(t):
    return images.logo_coverage(t.brands, t.assets).select("agency", "approved", "candidates", "rejected")


@query("coverage_totals", "SELECT count(*) AS total, count(*) FILTER (WHERE approved) AS with_approved, count(*) FILTER (WHERE NOT approved AND candidates > 0) AS awaiting_review, "
       "count(*) FILTER (WHERE NOT approved AND candidates = 0) AS none FROM coverage", ("coverage",))
def coverage_totals(t):
    return images.coverage_totals(images.logo_coverage(t.brands, t.assets))


@query("library_stats", "SELECT kind, status, source, count(*) AS n FROM assets GROUP BY GROUPING SETS ((kind, status), (source))", ("assets",))
def library_stats(t):
    return images.library_stats(t.assets)


@query("library_listing", "SELECT id, CASE WHEN id % 3 = 0 THEN 'free' WHEN id % 3 = 1 THEN 'non-free' END AS license_class FROM assets WHERE kind = 'logo' AND status = 'approved' "
       "AND (contains(lower(agency), 'brand#1') OR contains(lower(array_to_string(topic_tags, ' ')), 'brand#1')) ORDER BY lower(agency), id", ("assets",))
def library_listing(t):
    return images.library_listing(t.assets, "logo", "approved", "BRAND#1").select("id", "license_class")


@query("browse_assets", "SELECT id, coalesce(url, 'https://api.example/api/images/file/' || id) AS url FROM assets WHERE status = 'approved' AND kind = 'stock' "
       "AND contains(array_to_string(topic_tags, ' '), 'red') ORDER BY lower(agency), id LIMIT 60", ("assets",))
def browse_assets(t):
    return images.browse_assets(t.assets, "https://api.example", "RED", "stock", n=60).select("id", "url")


def _spoken(t):
    """Agency-like names: suppliers spelled out, and the acronyms and short forms people use."""
    k = F.col("s_suppkey")
    city = lambda n: F.element_at(F.array(*[F.lit(c) for c in ("Madison", "Harbor", "Lakeside", "Granite", "Prairie")]), (n % 5 + 1).cast("int"))
    kind = lambda n: F.element_at(F.array(*[F.lit(c) for c in ("Valley", "Bay", "Hills")]), (n % 3 + 1).cast("int"))
    full = F.concat(city(k), F.lit(" "), kind(k), F.lit(" "), F.col("n_name"), F.lit(" Transportation Authority"))
    return t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", full.alias("full"))


_city = "(['Madison', 'Harbor', 'Lakeside', 'Granite', 'Prairie'])[s_suppkey % 5 + 1]"
_kind = "(['Valley', 'Bay', 'Hills'])[s_suppkey % 3 + 1]"
common("spoken", f"SELECT s_suppkey, {_city} || ' ' || {_kind} || ' ' || n_name || ' Transportation Authority' AS longname FROM supplier JOIN nation ON n_nationkey = s_nationkey")
_norm = ("list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\b(the|of|and|inc|authority|agency|district|department|"
         "transit|transportation|metropolitan|regional|county|city|public|system|services|service)\\b', ' ', 'g'), '\\s+'), lambda w: w <> ''))").format
common("pairs", f"""
  SELECT DISTINCT x.longname AS l, y.full2 AS r, {_norm('x.longname')} AS a, {_norm('y.full2')} AS b FROM spoken x CROSS JOIN
    (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN replace(longname, 'Transportation Authority', 'Transit') ELSE replace(longname, 'Valley', 'River') END AS full2 FROM spoken) y""", "spoken")
common("scored", """
  SELECT l, r, CASE WHEN regexp_replace(lower(l), '[^a-z0-9]', '', 'g') = regexp_replace(lower(r), '[^a-z0-9]', '', 'g') THEN 1.0
    WHEN len(list_intersect(a, b)) < 2 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS score FROM pairs""", "pairs")


def _variants(t):
    return _spoken(t).select(F.when(F.col("s_suppkey") % 2 == 0, F.replace("full", F.lit("Transportation Authority"), F.lit("Transit")))
                             .otherwise(F.replace("full", F.lit("Valley"), F.lit("River"))).alias("r")).distinct()


@query("name_scores", "SELECT l, r, round(score, 6) AS score FROM scored WHERE score >= 0.6", ("scored",))
def name_scores(t):
    out = images.scored_names(_spoken(t).select(F.col("full").alias("l")), _variants(t), 0.6)
    return out.withColumn("score", F.round("score", 6))


@query("best_match", """
  SELECT entity, title, round(score, 2) AS score FROM (SELECT l AS entity, r AS title, score, row_number() OVER (PARTITION BY l ORDER BY score DESC,
    NOT regexp_matches(r, '(?i)transit|transport|railway|rail|metro|bus|authority|agency|commuter|subway|tramway|council|district'), length(r), r) AS q FROM scored WHERE score >= 0.6) WHERE q = 1""", ("scored",))
def best_match(t):
    names = _spoken(t).select(F.col("full").alias("entity"), F.col("full").alias("name")).distinct()
    return images.best_match(names, _variants(t).select(F.col("r").alias("title")))


@query("unmatched_sponsors", "SELECT DISTINCT longname AS sponsor FROM spoken WHERE longname NOT IN (SELECT l FROM scored WHERE score >= 0.9)", ("spoken", "scored"))
def unmatched_sponsors(t):
    return images.unmatched_sponsors(_spoken(t).select(F.col("full").alias("sponsor")), _variants(t).select(F.col("r").alias("name")))


@query("licence_class", "SELECT id, ['free', 'non-free', 'unclear', 'free'][id % 4 + 1] AS class FROM assets", ("assets",))
def licence_class(t):
    return t.assets.select("id", images.licence_class("license", "attribution", F.lit("wiki")).alias("class"))
