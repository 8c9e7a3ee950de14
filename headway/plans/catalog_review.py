"""Queries over the review queue, its registries, near-duplicates and triage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from headway.functions.columns import content_words
from headway.operators import duplicates, registry, review, triage
from headway.plans.catalog import common, query

NOW = datetime(2024, 2, 15, 12)
_day0 = "DATE '2024-01-01'"

common("items", f"""
  SELECT d.doc_id AS id, ['Funding', 'Procurement', 'People', 'Policy', 'Data'][d.doc_id % 5 + 1] AS pillar, text AS headline,
    'Report from ' || source AS summary, source AS source_name,
    CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 6 = 0 THEN 'https://news.google.com/rss/' || d.doc_id
         ELSE 'https://' || source || '.example.com/' || d.doc_id END AS source_url,
    CASE WHEN d.doc_id % 17 <> 0 THEN {_day0} + (d.doc_id % 60)::INTEGER END AS published,
    CASE WHEN d.doc_id % 10 = 0 THEN {_day0} + (d.doc_id % 45 + 31)::INTEGER END AS deadline,
    ['low', 'med', 'high'][d.doc_id % 3 + 1] AS relevance, ['pending', 'approved', 'published', 'skipped'][d.doc_id % 4 + 1] AS status,
    CASE WHEN d.doc_id % 9 <> 0 THEN [source, 'Agency ' || (d.doc_id % 7)] ELSE []::VARCHAR[] END AS agencies,
    CASE d.doc_id % 3 WHEN 0 THEN ['Bus'] WHEN 1 THEN ['Light Rail', 'Bus'] ELSE []::VARCHAR[] END AS mode,
    CASE d.doc_id % 8 WHEN 0 THEN ['CIG New Starts'] WHEN 1 THEN ['RAISE'] ELSE []::VARCHAR[] END AS programs,
    [lang, 't' || (d.doc_id % 12)] AS tags, CASE WHEN d.doc_id % 5 <> 0 THEN upper(lang) END AS state,
    TIMESTAMP '2024-01-01' + to_hours((d.doc_id % 100)::INTEGER) AS collected_at,
    CASE WHEN quality IS NOT NULL THEN quality * 60 + (d.doc_id % 40)::INTEGER END AS score,
    CASE WHEN quality IS NOT NULL THEN ['skip', 'hold', 'publish', 'publish'][d.doc_id % 4 + 1] END AS action,
    list_filter([CASE WHEN toxic = 1 THEN 'likely_duplicate' END, CASE WHEN d.doc_id % 6 = 0 THEN 'lead_candidate' END],
                lambda x: x IS NOT NULL) AS flags,
    CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id % 50 END AS dupe_group,
    CASE WHEN quality IS NOT NULL THEN TIMESTAMP '2024-01-01' + to_hours((d.doc_id % 30)::INTEGER) END AS recommended_at,
    CASE WHEN d.doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_hours((d.doc_id % 1000)::INTEGER) END AS publish_at,
    CASE WHEN d.doc_id % 2 = 0 THEN 'https://img.example.com/' || d.doc_id || '.jpg' END AS image_url,
    CASE WHEN d.doc_id % 14 = 0 THEN 'none' WHEN d.doc_id % 7 = 3 THEN 'manual' END AS pick_image_source,
    CASE WHEN d.doc_id % 7 = 3 THEN d.doc_id % 20 END AS pick_image_library_id
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
common("sources", """
  SELECT regexp_extract(source, '(\\d+)$', 1)::BIGINT AS id, source AS name, 'https://' || source || '.example.com/feed' AS url,
    CASE WHEN id % 3 = 0 THEN 'Search' ELSE 'Feed' END AS type, CASE WHEN id % 7 = 6 THEN 'Manual' ELSE 'RSS' END AS method,
    id % 6 <> 5 AS enabled, CASE WHEN id % 5 = 4 THEN 'user' ELSE 'registry' END AS origin, id % 4 = 3 AS edited, id % 9 = 8 AS deleted
  FROM (SELECT DISTINCT source FROM documents)""")
common("fetches", """
  SELECT user_id AS source_id, ts, CASE WHEN event_type = 'error' THEN 'HTTP ' || event_id END AS error,
    CASE WHEN event_type <> 'error' THEN k END AS entries, CASE WHEN event_type <> 'error' AND k % 2 = 0 THEN k + 1 END AS new,
    CASE WHEN event_type <> 'error' AND k % 3 = 0 THEN k + 2 END AS queued
  FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events)""")


def _feed(t):
    n = F.col("doc_id")
    return t.documents.select(
        F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("source_no"), F.col("source"), n.alias("position"),
        F.when(n % 11 == 0, None).otherwise(F.concat(F.lit("https://x.example/"), (n % 700).cast("string"))).alias("link"), "doc_id")


@query("new_items", """
  SELECT link, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY source_no, doc_id) AS q FROM
    (SELECT doc_id, source, regexp_extract(source, '(\\d+)$', 1)::INTEGER AS source_no,
        CASE WHEN doc_id % 11 <> 0 THEN 'https://x.example/' || (doc_id % 700) END AS link FROM documents)
    WHERE link IS NOT NULL AND link NOT IN (SELECT 'https://x.example/' || item_id FROM benchmark)) WHERE q = 1""")
def new_items(t):
    known = t.benchmark.select(F.concat(F.lit("https://x.example/"), F.col("item_id").cast("string")).alias("link"))
    return review.new_items(_feed(t), known).select("link", "doc_id", "source")


@query("route_items", "SELECT id, CASE WHEN relevance = 'low' THEN 'filtered' ELSE 'pending' END AS status, "
       "CASE WHEN relevance = 'low' THEN 0 ELSE len(agencies) + len(tags) END AS facets FROM items", ("items",))
def route_items(t):
    return review.route_items(t.items).select("id", "status", (F.size("agencies") + F.size("tags")).cast("bigint").alias("facets"))


@query("clean_array", """
  SELECT page_id, array_to_string(list_transform(list_sort(list_transform(map_entries(min_at), lambda e: {'at': e.value, 'k': e.key})), lambda e: e.k), '|') AS parts FROM (
    SELECT page_id, map_from_entries(list_transform(list_distinct(w), lambda x: (x, list_position(w, x)))) AS min_at FROM (
      SELECT page_id, list_filter(list_transform(string_split(html, ' '), lambda s: trim(s, ' ')), lambda s: s <> '') AS w FROM pages))""")
def clean_array(t):
    """Words of whole pages: long values and long lists."""
    return t.pages.select("page_id", F.array_join(review.clean_array(F.split("html", " ")), "|").alias("parts"))


@query("restrict_vocab", """
  SELECT id, array_to_string(list_filter([CASE WHEN id % 2 = 0 THEN 'Light Rail' END, CASE WHEN id % 3 = 0 THEN 'BRT' END],
    lambda x: x IS NOT NULL), '|') AS modes, CASE WHEN id % 5 = 0 THEN 'TX' WHEN id % 5 = 1 THEN NULL ELSE 'DE' END AS state FROM items""", ("items",))
def restrict_vocab(t):
    k = F.col("id")
    said = F.array(F.when(k % 2 == 0, " light RAIL "), F.lit("Hovercraft"), F.when(k % 3 == 0, "brt"))
    code = F.when(k % 5 == 0, "tx ").when(k % 5 == 1, "Texas").otherwise("de")
    return t.items.select("id", F.array_join(review.restrict_vocab(said, review.MODES), "|").alias("modes"),
                          review.known_state(code).alias("state"))


_said = ["MTA", "The Chicago Transit Authority", "bay-area rapid transit", "Bay Area transit agencies", "Regional Transportation District",
         "Unknown Agency", "LIRR"]


def _said_names(t):
    pick = lambda n: F.element_at(F.array(*[F.lit(s) for s in _said]), (n % len(_said) + 1).cast("int"))
    k = F.col("id")
    state = F.when(k % 4 == 0, "MD").when(k % 4 == 1, "CO").when(k % 4 == 2, "TX")
    return t.items.select("id", F.array(pick(k), pick(k + 3), pick(k)).alias("agencies"), state.alias("state"))


common("said", f"""
  SELECT id, list_distinct_in_order FROM (SELECT id, list_filter([a, CASE WHEN b IS DISTINCT FROM a THEN b END], lambda x: x IS NOT NULL)
    AS list_distinct_in_order FROM (SELECT id, """ + ", ".join(f"""
      CASE {expr} WHEN 0 THEN CASE WHEN id % 4 = 0 THEN 'Maryland Transit Administration' ELSE 'MTA (New York)' END WHEN 1 THEN 'CTA' WHEN 2 THEN 'BART'
        WHEN 4 THEN CASE WHEN id % 4 IN (0, 2) THEN 'Regional Transportation District' ELSE 'RTD (Denver)' END WHEN 5 THEN 'Unknown Agency'
        WHEN 6 THEN 'MTA Long Island Rail Road' END AS {name}""" for expr, name in (("id % 7", "a"), ("(id + 3) % 7", "b"))) + " FROM items))", "items")


@query("normalize_names", "SELECT id, array_to_string(list_distinct_in_order, '|') AS names FROM said", ("said",))
def normalize_names(t):
    return _said_names(t).select("id", F.array_join(review.normalize_names("agencies", "state"), "|").alias("names"))


@query("renormalize_report", "SELECT count(*) AS changed, (SELECT count(DISTINCT n) FROM (SELECT unnest(list_distinct_in_order) AS n FROM said)) "
       "AS names FROM said", ("said",))
def renormalize_report(t):
    return review.renormalize_report(_said_names(t))


common("clock", f"""
  SELECT id, (epoch_us(TIMESTAMP '2024-02-15 12:00:00') - epoch_us(published::TIMESTAMP)) / 86400000000.0 AS age0, published, pillar,
    (epoch_us(deadline::TIMESTAMP) - epoch_us(TIMESTAMP '2024-02-15 12:00:00')) / 86400000000.0 AS until FROM items""", "items")
common("fresh", """
  SELECT id, CASE WHEN until < 0 THEN 'Expired' WHEN until >= 0 THEN 'Live' WHEN pillar = 'Policy' THEN 'Developing' WHEN age <= 2 THEN 'Fresh'
      WHEN age <= 7 THEN 'Recent' WHEN age <= 21 THEN 'Aging' ELSE 'Stale' END AS status,
    CASE WHEN until < 0 THEN 6 WHEN until >= 0 THEN floor(greatest(60, least(100, 100 - least(until, 60) * 0.5)))
      WHEN pillar = 'Policy' THEN floor(greatest(22, 100 * exp(-age / 12))) ELSE floor(100 * exp(-age / 3)) END::INTEGER AS score
  FROM (SELECT *, CASE WHEN published IS NULL THEN 999 ELSE greatest(age0, 0) END AS age FROM clock)""", "clock")


@query("freshness", "SELECT id, status, score FROM fresh", ("fresh",))
def freshness(t):
    f = review.freshness(F.col("published"), F.col("deadline"), F.col("pillar") == "Policy", NOW)
    return t.items.select("id", f.alias("f")).select("id", "f.status", "f.score")


@query("search_items", "SELECT id FROM items WHERE contains(lower(concat_ws(' ', headline, summary, source_name, pillar, state, "
       "array_to_string(agencies, ' '), array_to_string(tags, ' '), array_to_string(mode, ' '), array_to_string(programs, ' '))), 'fund') "
       "AND contains(lower(concat_ws(' ', headline, array_to_string(mode, ' '))), 'light') "
       + "".join(f"AND contains(lower(concat_ws(' ', headline, summary, source_name, pillar, state, array_to_string(agencies, ' '), array_to_string(tags, ' '), array_to_string(mode, ' '), array_to_string(programs, ' '))), '{w}') "
                 for w in ("rail", "bus", "report", "src", "ag", "t", "en", "1")), ("items",))
def search_items(t):
    return review.search_items(t.items, "Fund LIGHT rail bus Report src ag T en 1").select("id")


@query("facet_filter", "SELECT id FROM items WHERE pillar = 'Funding' AND list_contains(mode, 'Bus') AND list_contains(agencies, 'Agency 3')", ("items",))
def facet_filter(t):
    return review.facet_filter(t.items, pillar="Funding", mode="Bus", agencies="Agency 3", state=None).select("id")


common("page_fresh", "SELECT id, CASE WHEN until < 0 THEN 6 WHEN until >= 0 THEN floor(greatest(60, least(100, 100 - least(until, 60) * 0.5))) "
       "ELSE floor(100 * exp(-(CASE WHEN published IS NULL THEN 999 ELSE greatest(age0, 0) END) / 3)) END::INTEGER AS fresh_score FROM clock", "clock")


@query("queue_page", "SELECT id, fresh_score FROM (SELECT * FROM items WHERE status = 'pending' ORDER BY collected_at DESC, id DESC LIMIT 200) "
       "JOIN page_fresh USING (id)", ("items", "page_fresh"))
def queue_page(t):
    pending = t.items.filter("status = 'pending'").withColumn("reco_score", F.col("score"))
    return review.queue_page(pending, NOW, 200).select("id", "fresh_score")


@query("queue_page_by_score", "SELECT id, score FROM items WHERE status = 'pending' ORDER BY score DESC NULLS LAST, collected_at DESC, id DESC LIMIT 200", ("items",))
def queue_page_by_score(t):
    pending = t.items.filter("status = 'pending'").withColumn("reco_score", F.col("score"))
    return review.queue_page(pending, NOW, 200, by_score=True).select("id", "score")


@query("queue_counts", "SELECT count(*) AS matched, count(*) FILTER (WHERE score IS NULL) AS unscored FROM items WHERE status = 'pending'", ("items",))
def queue_counts(t):
    return review.queue_counts(t.items.filter("status = 'pending'").withColumn("reco_score", F.col("score")))


@query("status_counts", "SELECT status, count(*) AS n FROM items GROUP BY 1", ("items",))
def status_counts(t):
    return review.status_counts(t.items)


@query("facet_counts", """
  SELECT facet, value, count(*) AS n FROM (
    SELECT 'pillar' AS facet, pillar AS value FROM items UNION ALL SELECT 'state', state FROM items UNION ALL SELECT 'mode', unnest(mode) FROM items
    UNION ALL SELECT 'program', unnest(programs) FROM items UNION ALL SELECT 'agency', unnest(agencies) FROM items UNION ALL SELECT 'tag', unnest(tags) FROM items)
    WHERE value IS NOT NULL GROUP BY 1, 2""", ("items",))
def facet_counts(t):
    return review.facet_counts(t.items)


common("last_ok", "SELECT source_id, max(ts) FILTER (WHERE error IS NULL) AS ok_at FROM fetches GROUP BY 1", "fetches")


@query("health_fold", """
  SELECT f.source_id, max(ts) AS last_fetched_at, max(ts) FILTER (WHERE error IS NULL) AS last_ok_at,
    count(*) FILTER (WHERE error IS NOT NULL AND (ok_at IS NULL OR ts > ok_at)) AS fail_streak,
    CASE WHEN count(*) FILTER (WHERE error IS NOT NULL AND (ok_at IS NULL OR ts > ok_at)) > 0 THEN max_by(error, ts) FILTER (WHERE error IS NOT NULL) END AS last_error,
    max_by(entries, ts) FILTER (WHERE error IS NULL) AS last_entries, max_by(new, ts) FILTER (WHERE new IS NOT NULL) AS last_new,
    max_by(queued, ts) FILTER (WHERE queued IS NOT NULL) AS last_queued
  FROM fetches f JOIN last_ok o USING (source_id) GROUP BY 1""", ("fetches", "last_ok"))
def health_fold(t):
    out = registry.health_fold(t.fetches)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("source_id", ntz("last_fetched_at"), ntz("last_ok_at"), "fail_streak", "last_error", "last_entries", "last_new", "last_queued")


@query("source_stats", """
  SELECT s.name, count(i.id) AS items, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status IN ('approved', 'published')) AS kept,
    count(*) FILTER (WHERE status = 'published') AS published FROM sources s LEFT JOIN items i ON i.source_name = s.name WHERE NOT deleted GROUP BY 1""",
       ("sources", "items"))
def source_stats(t):
    return registry.source_stats(t.sources, t.items).select("name", "items", "pending", "kept", "published")


@query("active_sources", "SELECT id, name FROM sources WHERE method = 'RSS' AND enabled AND NOT deleted", ("sources",))
def active_sources(t):
    return registry.active_sources(t.sources).select("id", "name")


@query("merge_registry", """
  SELECT lower(coalesce(s.name, n.name)) AS name, CASE WHEN s.id IS NULL THEN 'added' WHEN n.name IS NOT NULL AND (origin <> 'registry' OR edited OR deleted) THEN 'kept'
    WHEN n.name IS NOT NULL THEN 'updated' WHEN type = 'Search' AND origin = 'registry' AND NOT edited AND NOT deleted AND method <> 'Retired' THEN 'retired'
    ELSE 'untouched' END AS outcome
  FROM sources s FULL OUTER JOIN (SELECT DISTINCT 'SRC' || (item_id % 30) AS name FROM benchmark WHERE item_id % 30 % 2 = 0) n ON lower(n.name) = lower(s.name)""", ("sources",))
def merge_registry(t):
    n = F.col("item_id") % 30
    new = t.benchmark.filter(n % 2 == 0).select(
        F.concat(F.lit("SRC"), n.cast("string")).alias("name"), F.lit("u").alias("url"), F.lit("News").alias("pillar"), F.lit("Feed").alias("type"),
        F.lit("RSS").alias("method"), F.lit("High").alias("trust"), F.lit("").alias("notes"), F.lit(None).cast("string").alias("query"),
        F.lit(None).cast("int").alias("search_days")).distinct()
    return registry.merge_registry(new, t.sources).select(F.lower("name").alias("name"), "outcome")


def _agencies(t):
    none = F.expr("array()").cast("array<string>")
    return t.supplier.select(
        F.col("s_name").alias("name"), F.array(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("aliases"), F.lit("").alias("state"),
        F.col("s_suppkey").cast("string").alias("ntd_id"), F.concat(F.lit("Sponsor "), (F.col("s_suppkey") % 40).cast("string")).alias("cig_sponsor"),
        F.lit("").alias("website"), F.lit("").alias("newsroom"), F.lit("").alias("procurement_url"), (F.col("s_suppkey") % 3 == 0).alias("search_enabled")), none


@query("merge_agencies", """
  SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'updated' ELSE 'added' END AS outcome,
    CASE WHEN s_suppkey % 2 = 0 THEN true ELSE s_suppkey % 3 = 0 END AS search_enabled FROM supplier""")
def merge_agencies(t):
    new, none = _agencies(t)
    old = t.supplier.filter("s_suppkey % 2 = 0").select(
        F.upper("s_name").alias("name"), *[F.lit(None).cast("string").alias(f) for f in registry.AGENCY_FIELDS[1:]], none.alias("aliases"), F.lit(True).alias("search_enabled"))
    return registry.merge_agencies(new, old).select("name", "outcome", "search_enabled")


@query("agency_searches", """
  SELECT 'Agency: ' || s_name AS name, '"' || s_name || '" transit when:2d' AS query,
    'https://news.google.com/rss/search?q=%22' || replace(s_name, '#', '%23') || '%22+transit+when%3A2d&hl=en-US&gl=US&ceid=US:en' AS url,
    CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 3 = 0 ELSE false END AS enabled, CASE WHEN s_suppkey % 5 = 0 THEN 'updated' ELSE 'added' END AS outcome
  FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 = 0""")
def agency_searches(t):
    have = t.supplier.filter("s_suppkey % 5 = 0").select(
        F.concat(F.lit("agency: "), F.lower("s_name")).alias("name"), F.lit(True).alias("enabled"), F.lit("q").alias("query"), F.lit("u").alias("url"),
        F.lit(None).cast("timestamp").alias("edited_at"))
    return registry.agency_searches(_agencies(t)[0], have).select("name", "query", "url", "enabled", "outcome")


@query("split_search", """
  SELECT item_id, regexp_replace(trim(text), '\\s+', ' ', 'g') AS text, CASE WHEN item_id % 2 = 0 THEN item_id % 40 + 1 ELSE 30 END::INTEGER AS days FROM benchmark""")
def split_search(t):
    """Search texts to feed addresses and back."""
    words = F.regexp_replace(F.trim("text"), r"\s+", " ")
    said = F.concat(words, F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" when:"), (F.col("item_id") % 40 + 1).cast("string"), F.lit("d"))).otherwise(""))
    rows = t.benchmark.select("item_id", registry.search_url(said).alias("url"))
    return rows.select("item_id", registry.search_of_url("url").alias("s")).select("item_id", "s.text", "s.days")


@query("match_agency", """
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (SELECT min(s_name) FROM supplier WHERE s_suppkey % 40 = c_custkey % 60) WHEN c_custkey % 3 = 1
    THEN (SELECT s_name FROM supplier WHERE s_suppkey = c_custkey % 150) ELSE (SELECT s_name FROM supplier WHERE s_suppkey = c_custkey) END AS agency FROM customer""")
def match_agency(t):
    k = F.col("c_custkey")
    said = (F.when(k % 3 == 0, F.concat(F.lit(" SPONSOR "), (k % 60).cast("string"))).when(k % 3 == 1, F.concat(F.lit("s"), (k % 150).cast("string")))
            .otherwise(F.replace("c_name", F.lit("Customer"), F.lit("SUPPLIER"))))
    return registry.match_agency(t.customer.select("c_custkey", said.alias("text")), _agencies(t)[0]).select("c_custkey", "agency")


@query("expire_stale", "SELECT id, CASE WHEN status = 'pending' AND collected_at < TIMESTAMP '2024-01-03 12:00:00' AND (deadline IS NULL OR "
       "deadline < DATE '2024-02-15') THEN 'expired' ELSE status END AS status FROM items", ("items",))
def expire_stale(t):
    return review.expire_stale(t.items, 43, NOW).select("id", "status")


@query("shelf_report", "SELECT count(*) FILTER (WHERE status = 'pending' AND collected_at < TIMESTAMP '2024-01-03 12:00:00' AND (deadline IS NULL OR "
       "deadline < DATE '2024-02-15')) AS would_clear, count(*) FILTER (WHERE status = 'expired') AS expired_total, "
       "count(*) FILTER (WHERE status = 'pending' AND deadline >= DATE '2024-02-15') AS deadline_exempt FROM items", ("items",))
def shelf_report(t):
    return review.shelf_report(t.items, 43, NOW)


@query("run_report", """
  SELECT coalesce(source, 'TOTAL') AS source, count(*) AS in_feed, count(*) FILTER (WHERE o > 0) AS new, count(*) FILTER (WHERE o = 1) AS queued,
    count(*) FILTER (WHERE o = 2) AS low, count(*) FILTER (WHERE o = 3) AS errors FROM (SELECT source, doc_id % 4 AS o FROM documents) GROUP BY ROLLUP (source)""")
def run_report(t):
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("known", "queued", "low", "error")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return review.run_report(t.documents.select("source", outcome.alias("outcome")))


@query("relabel_items", "SELECT id, CASE WHEN regexp_extract(source_name, '(\\d+)$', 1)::INTEGER % 2 = 0 THEN upper(source_name) ELSE source_name END AS source_name FROM items", ("items",))
def relabel_items(t):
    renames = t.sources.filter("id % 2 = 0").select(F.col("name").alias("old_name"), F.upper("name").alias("new_name"))
    return review.relabel(t.items, renames).select("id", "source_name")


# ---- near-duplicates ----------------------------------------------------------------------------

_stops = ", ".join(f"'{w}'" for w in __import__("headway.functions.columns", fromlist=["STOP_WORDS"]).STOP_WORDS)
common("word_rows", f"""
  SELECT DISTINCT id, w FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)
  WHERE length(w) > 2 AND w NOT IN ({_stops})""")
common("word_sets", """
  SELECT min(w.id) AS rep, ws, state, count(*) AS copies FROM (SELECT id, list_sort(list(w)) AS ws FROM word_rows GROUP BY 1) w
  JOIN items USING (id) WHERE len(ws) >= 3 GROUP BY ws, state""", "word_rows", "items")
common("lexical", """
  SELECT x.a, x.b FROM (SELECT p.rep AS a, q.rep AS b, count(*) AS shared FROM (SELECT rep, unnest(ws) AS w FROM word_sets) p
    JOIN (SELECT rep, unnest(ws) AS w FROM word_sets) q ON q.w = p.w AND p.rep < q.rep GROUP BY 1, 2) x
  JOIN word_sets i ON i.rep = x.a JOIN word_sets j ON j.rep = x.b WHERE shared >= 3 AND shared / least(len(i.ws), len(j.ws)) >= 0.7""", "word_sets")


@query("content_words", "SELECT id, count(*) AS n, md5(string_agg(w, ' ' ORDER BY w)) AS words FROM word_rows GROUP BY 1", ("word_rows",))
def content_word_sets(t):
    rows = t.items.select("id", F.array_sort(content_words("headline")).alias("ws")).filter("size(ws) > 0")
    return rows.select("id", F.size("ws").cast("bigint").alias("n"), F.md5(F.array_join("ws", " ")).alias("words"))


@query("word_overlap", """
  SELECT i.id, round(CASE WHEN s >= 3 THEN s / least(a, b) ELSE 0 END, 6) AS similarity FROM items i LEFT JOIN
    (SELECT x.id, len(list_intersect(x.ws, y.ws)) AS s, len(x.ws) AS a, len(y.ws) AS b FROM (SELECT id, list(w) AS ws FROM word_rows GROUP BY 1) x
     JOIN (SELECT id, list(w) AS ws FROM word_rows GROUP BY 1) y ON y.id = x.id + 1) z USING (id) WHERE z.id IS NOT NULL""", ("word_rows", "items"))
def word_overlap(t):
    """Each item against the next one."""
    rows = t.items.select("id", content_words("headline").alias("ws")).filter("size(ws) > 0")
    nxt = rows.select((F.col("id") - 1).alias("id"), F.col("ws").alias("wn"))
    return rows.join(nxt, "id").select("id", F.round(duplicates.overlap("ws", "wn"), 6).alias("similarity"))


@query("lexical_pairs", "SELECT a, b FROM lexical", ("lexical",))
def lexical_pairs(t):
    """Pairs of distinct (word set, state) representatives over whole texts."""
    return duplicates.lexical_pairs(duplicates.word_sets(t.headlines)).select("a", "b")


common("semantic", """
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE 1 - list_cosine_similarity(a.embedding, b.embedding) <= 0.6""")


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("state"))


@query("semantic_pairs", "SELECT a, b FROM semantic", ("semantic",))
def semantic_pairs(t):
    return duplicates.vector_pairs(duplicates.unit_vectors(_vectors(t)), eps=0.6).select("a", "b")


@query("guarded_pairs", "SELECT s.a, s.b FROM semantic s JOIN embeddings x ON x.vec_id = s.a JOIN embeddings y ON y.vec_id = s.b WHERE x.label = y.label", ("semantic",))
def guarded_pairs(t):
    pairs = duplicates.vector_pairs(duplicates.unit_vectors(_vectors(t)), eps=0.6).select("a", "b")
    return duplicates.guard_pairs(pairs, _vectors(t))


common("links", """
  SELECT a, b FROM (SELECT a, b FROM lexical UNION SELECT s.rep, i.id FROM word_sets s JOIN (SELECT id, list_sort(list(w)) AS ws FROM word_rows GROUP BY 1) i
    ON i.ws = s.ws JOIN items k ON k.id = i.id WHERE k.state IS NOT DISTINCT FROM s.state AND i.id <> s.rep
    UNION SELECT a, b FROM semantic WHERE a IN (SELECT id FROM items) AND b IN (SELECT id FROM items)) e
  JOIN items x ON x.id = a JOIN items y ON y.id = b WHERE x.state IS NULL OR y.state IS NULL OR x.state = y.state""",
       "lexical", "word_sets", "word_rows", "items", "semantic")


@query("duplicate_groups", """
  SELECT id, min(lab) AS "group" FROM (WITH RECURSIVE hops AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT a AS id, a AS lab FROM hops UNION SELECT hops.b, reach.lab FROM reach JOIN hops ON hops.a = reach.id)
    SELECT * FROM reach) GROUP BY 1""", ("links",))
def duplicate_groups(t):
    """Groups over words and vectors; documents and vectors share their ids."""
    return duplicates.duplicate_groups(t.headlines, _vectors(t).drop("state"), eps=0.6)


@query("duplicate_group_members", "SELECT id FROM (SELECT a AS id FROM links UNION SELECT b FROM links)", ("links",))
def duplicate_group_members(t):
    return duplicates.duplicate_groups(t.headlines, _vectors(t).drop("state"), eps=0.6).select("id")


common("title_words", f"""
  SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark)
  WHERE length(w) > 2 AND w NOT IN ({_stops})""")


@query("already_published", """
  SELECT DISTINCT id FROM (SELECT w.id, t.item_id, count(*) AS s FROM word_rows w JOIN title_words t USING (w) GROUP BY 1, 2)
  JOIN (SELECT id, count(*) AS n FROM word_rows GROUP BY 1) USING (id) JOIN (SELECT item_id, count(*) AS m FROM title_words GROUP BY 1) USING (item_id)
  WHERE s >= 3 AND s / least(n, m) >= 0.65""", ("word_rows", "title_words"))
def already_published(t):
    return duplicates.already_published(t.items, t.titles, title_id="item_id")


# ---- triage -------------------------------------------------------------------------------------

@query("data_tie", """
  SELECT id, CASE WHEN list_has_any(agencies, (SELECT list('Agency ' || r_regionkey) FROM region)) OR list_contains(programs, 'CIG New Starts') THEN 'cig'
    WHEN list_has_any(agencies, (SELECT list(DISTINCT source) FROM documents)) THEN 'ntd' END AS tie FROM items""", ("items",))
def data_tie(t):
    names = t.sources.select(F.lower("name").alias("name"))
    sponsors = t.region.select(F.concat(F.lit("agency "), F.col("r_regionkey").cast("string")).alias("name"))
    return triage.data_tie(t.items, names, sponsors)


def _replies(t):
    """Score replies written out as text, forty per batch, some fenced and some broken; every id is answered twice."""
    k = F.col("doc_id")
    one = F.format_string('{"id": "%d", "score": 1, "action": "hold", "reason": "first"}, {"id": "%d", "score": %s, "action": "%s", "reason": " why %d ", "flags": ["%s", "odd"]}', k, k,
                          F.when(k % 5 == 0, '"140"').otherwise((F.col("quality") * 60 + k % 40).cast("string")),
                          F.when(k % 3 == 0, "PUBLISH").when(k % 3 == 1, "skip").otherwise("ponder"), k,
                          F.when(F.col("toxic") == 1, "likely_duplicate").otherwise("none"))
    batch = F.floor(k / 40).cast("int")
    per = t.labels.groupBy(batch.alias("batch_id")).agg(
        F.collect_list(F.when(k % 7 != 0, k)).alias("asked_ids"), F.array_join(F.array_sort(F.collect_list(one)), ", ").alias("body"))
    b = F.col("batch_id")
    return per.select("batch_id", "asked_ids", F.when(b % 4 == 0, F.concat(F.lit("```json\n["), "body", F.lit("]\n```"))).when(
        b % 4 == 1, F.concat(F.lit("Here you are: ["), "body", F.lit("] done"))).when(
        b % 4 == 2, F.concat(F.lit("["), "body", F.lit("]"))).otherwise(F.concat(F.lit("["), "body")).alias("reply"))


@query("parse_scores", """
  SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 100 ELSE quality * 60 + doc_id % 40 END::INTEGER AS score,
    CASE WHEN doc_id % 3 = 0 THEN 'publish' WHEN doc_id % 3 = 1 THEN 'skip' ELSE 'hold' END AS action, 'why ' || doc_id AS reason,
    CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS n_flags FROM labels WHERE doc_id % 7 <> 0 AND (doc_id // 40) % 4 <> 3""")
def parse_scores(t):
    return triage.parse_scores(_replies(t)).select("id", "score", "action", "reason", F.size("flags").alias("n_flags"))


@query("merge_scores", """
  SELECT i.id, CASE WHEN i.id % 2 = 0 THEN score END AS score, CASE WHEN i.id % 3 = 0 THEN i.id % 50 END AS dupe_group,
    list_contains(CASE WHEN i.id % 2 = 0 THEN flags ELSE [] END, 'likely_duplicate') OR b.item_id IS NOT NULL AS duplicate
  FROM items i LEFT JOIN benchmark b ON b.item_id = i.id""", ("items",))
def merge_scores(t):
    base = t.items.select("id")
    scores = t.items.filter("id % 2 = 0").select("id", "score", "action", F.lit("").alias("reason"), "flags")
    groups = t.items.filter("dupe_group IS NOT NULL").select("id", F.col("dupe_group").alias("group"))
    out = triage.merge_scores(base, scores, groups, t.benchmark.select(F.col("item_id").alias("id")))
    return out.select("id", "score", "dupe_group", F.array_contains("flags", "likely_duplicate").alias("duplicate"))


@query("shortlist", "SELECT id, score FROM items WHERE score IS NOT NULL AND action <> 'skip' AND source_url IS NOT NULL AND source_url NOT LIKE "
       "'%news.google.com%' ORDER BY score DESC, id LIMIT 40", ("items",))
def shortlist(t):
    return triage.shortlist(t.items, 40).select("id", "score")


@query("merge_second_pass", """
  SELECT id, CASE WHEN id % 2 = 0 THEN least(id % 101, score + 15) ELSE score END::INTEGER AS score, CASE WHEN id % 2 = 0 THEN
    array_to_string(list_filter(['lead_candidate', CASE WHEN list_contains(flags, 'likely_duplicate') THEN 'likely_duplicate' END], lambda x: x IS NOT NULL), ',')
    ELSE array_to_string(flags, ',') END AS flags FROM items WHERE score IS NOT NULL""", ("items",))
def merge_second_pass(t):
    first = t.items.filter("score IS NOT NULL").withColumn("reason", F.lit(""))
    second = first.filter("id % 2 = 0").select("id", (F.col("id") % 101).cast("int").alias("score"), F.lit("hold").alias("action"),
                                               F.lit("r").alias("reason"), F.array(F.lit("lead_candidate")).alias("flags"))
    return triage.merge_second_pass(first, second).select("id", "score", F.array_join("flags", ",").alias("flags"))


common("eligible", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dupe_group ORDER BY score DESC, id) AS gr,
      dupe_group IN (SELECT dupe_group FROM items WHERE dupe_group IS NOT NULL AND list_contains(flags, 'likely_duplicate')) AS sure
    FROM items WHERE score IS NOT NULL AND action <> 'skip')
  WHERE (dupe_group IS NULL OR NOT sure OR gr = 1) AND NOT list_contains(flags, 'likely_duplicate')""", "items")
common("chosen", """
  SELECT * FROM (SELECT *, CASE WHEN n = 1 AND pillar IN ('Funding', 'Procurement', 'People', 'Policy') THEN 1 WHEN n <= 2 THEN 2 ELSE 3 END AS turn FROM
    (SELECT *, row_number() OVER (PARTITION BY pillar ORDER BY score DESC, id) AS n FROM eligible)) ORDER BY turn, score DESC, id LIMIT 6""", "eligible")


@query("eligible_items", "SELECT id FROM eligible", ("eligible",))
def eligible_items(t):
    return triage.eligible(t.items).select("id")


@query("balanced_set", "SELECT id, pillar, score FROM chosen", ("chosen",))
def balanced_set(t):
    return triage.balanced_set(t.items).select("id", "pillar", "score")


@query("lead_story", "SELECT id FROM chosen ORDER BY list_contains(flags, 'lead_candidate') DESC, score DESC, id LIMIT 1", ("chosen",))
def lead_story(t):
    return triage.lead_story(triage.balanced_set(t.items)).select("id")


@query("triage_summary", """
  SELECT count(*) AS scored, count(*) FILTER (WHERE action = 'publish') AS publish, count(*) FILTER (WHERE action = 'hold') AS hold,
    count(*) FILTER (WHERE action = 'skip') AS skip, count(*) FILTER (WHERE list_contains(flags, 'likely_duplicate')) AS duplicates,
    count(*) FILTER (WHERE list_contains(flags, 'lead_candidate')) AS lead_candidates FROM items WHERE score IS NOT NULL""", ("items",))
def triage_summary(t):
    return triage.triage_summary(t.items)


@query("run_cost", """
  SELECT o_orderkey, round_even((o_custkey * 100 / 1e6 * CASE WHEN o_orderstatus = 'F' THEN 3.0 ELSE 1.0 END
    + o_totalprice / 1e6 * CASE WHEN o_orderstatus = 'F' THEN 15.0 ELSE 5.0 END) * 10000, 0) / 10000 AS cost FROM orders""")
def run_cost(t):
    usage = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("model"), (F.col("o_custkey") * 100).alias("input_tokens"),
                            F.col("o_totalprice").alias("output_tokens"))
    prices = t.spark.createDataFrame([("F", 3.0, 15.0), ("O", 1.0, 5.0)], "model string, price_in double, price_out double")
    return triage.run_cost(usage, prices, "O").select("o_orderkey", "cost")


@query("embed_text", """
  SELECT doc_id, concat_ws('. ', nullif(source, ''), nullif(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' '), '')) AS text
  FROM documents""")
def embed_text(t):
    return t.documents.select("doc_id", triage.embed_text(F.col("source"), F.col("text")).alias("text"))


@query("embed_backlog", "SELECT doc_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE embedding IS NULL")
def embed_backlog(t):
    rows = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left")
    return triage.embed_backlog(rows, 64).select("doc_id")


@query("last_recommendation", "SELECT id, score, (SELECT max(recommended_at) FROM items) AS ran_at FROM items WHERE recommended_at IS NOT NULL", ("items",))
def last_recommendation(t):
    return triage.last_recommendation(t.items).select("id", "score", F.col("ran_at").cast("timestamp_ntz").alias("ran_at"))
