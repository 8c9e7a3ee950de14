"""Queries over posts and the publish queue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from headway.operators import posts
from headway.plans import catalog_review  # noqa: F401  (shared WITH entries)
from headway.plans.catalog import common, query

NOW = datetime(2024, 1, 15)
_now = "TIMESTAMP '2024-01-15'"
_hour = "TIMESTAMP '2024-01-01' + to_hours({}::INTEGER)".format

common("posts", f"""
  SELECT page_id AS id, 'p-' || page_id AS slug, ['Funding', 'Procurement', 'People', 'Policy', 'Data'][page_id % 5 + 1] AS pillar,
    regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1) AS title, url, CASE WHEN page_id % 6 = 5 THEN 'draft' ELSE 'published' END AS status,
    CASE WHEN page_id % 23 <> 0 THEN {_hour('(page_id * 37 % 500)')} END AS publish_at, page_id * 2 AS item_id,
    CASE page_id % 4 WHEN 0 THEN 'Google News: transit' WHEN 1 THEN '  ' ELSE 'Paper ' || (page_id % 9) END AS source_name,
    CASE WHEN page_id % 5 = 0 THEN 'https://news.google.com/a/' || page_id ELSE url END AS source_url,
    CASE WHEN page_id % 3 <> 0 THEN ['Brand#' || (page_id % 30), 'Brand#' || (page_id % 7)] ELSE []::VARCHAR[] END AS agencies,
    CASE WHEN page_id % 2 = 0 THEN ['Bus'] ELSE []::VARCHAR[] END AS mode,
    CASE page_id % 8 WHEN 0 THEN ['RAISE'] WHEN 1 THEN ['TIFIA'] ELSE []::VARCHAR[] END AS programs, ['t' || (page_id % 4)] AS tags,
    CASE WHEN page_id % 5 <> 1 THEN upper(regexp_extract(html, 'lang="([a-z]+)"', 1)) END AS state, page_id % 10 = 0 AS featured,
    CASE WHEN page_id % 20 = 0 THEN {_hour('(page_id % 600)')} END AS featured_until,
    CASE WHEN page_id % 4 = 0 THEN 'https://i.example/' || page_id END AS image_url, CASE WHEN page_id % 12 = 1 THEN 'none' END AS image_source,
    CASE WHEN page_id % 4 = 2 THEN page_id % 50 END AS image_library_id
  FROM pages""")
common("live", f"SELECT * REPLACE (featured AND (featured_until IS NULL OR featured_until > {_now}) AS featured) FROM posts WHERE status = 'published'", "posts")
common("placed", "SELECT *, row_number() OVER (ORDER BY featured DESC, publish_at DESC NULLS LAST, id DESC) AS place FROM live", "live")


@query("items_to_posts", """
  SELECT id AS item_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(coalesce(nullif(headline, ''), 'post')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'post')
    || '-' || id AS slug, summary || CASE WHEN source_url IS NOT NULL THEN chr(10) || chr(10) || 'Source: ' || source_name || ' - ' || source_url ELSE '' END AS body
  FROM items WHERE status = 'approved'""", ("items",))
def items_to_posts(t):
    return posts.to_posts(t.items, NOW).select("item_id", "slug", "body")


@query("upsert_posts", """
  SELECT coalesce(p.slug, n.slug) AS slug, CASE WHEN p.slug IS NOT NULL THEN p.title ELSE n.title END AS title,
    CASE WHEN n.slug IS NOT NULL THEN 'published' ELSE p.status END AS status
  FROM posts p FULL OUTER JOIN (SELECT 'p-' || doc_id AS slug, 'T' || doc_id AS title FROM documents WHERE doc_id % 3 = 0) n USING (slug)""", ("posts",))
def upsert_posts(t):
    new = t.documents.filter("doc_id % 3 = 0").select(
        F.concat(F.lit("p-"), F.col("doc_id").cast("string")).alias("slug"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"),
        F.lit("published").alias("status"))
    return posts.upsert_posts(t.posts.select("id", "slug", "title", "status"), new).select("slug", "title", "status")


@query("fill_slugs", "SELECT id, CASE WHEN id % 3 = 0 THEN slug ELSE substr(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), 1, 60) || '-' || id END "
       "AS slug FROM posts", ("posts",))
def fill_slugs(t):
    rows = t.posts.withColumn("slug", F.when(F.col("id") % 3 == 0, F.col("slug")).when(F.col("id") % 3 == 1, " "))
    return posts.fill_slugs(rows).select("id", "slug")


@query("ready_list", "SELECT id, score FROM items WHERE status = 'approved' ORDER BY score DESC NULLS LAST, collected_at DESC, id DESC LIMIT 200", ("items",))
def ready_list(t):
    return posts.ready_list(t.items, 200).select("id", "score")


@query("due_items", f"SELECT id FROM items WHERE status = 'approved' AND publish_at <= {_now}", ("items",))
def due_items(t):
    return posts.due_items(t.items, NOW).select("id")


common("picks", "SELECT *, CASE WHEN id % 5 = 0 THEN 'https://p.example/' || id END AS pick_image_url FROM items", "items")


def _picked(t):
    return t.items.withColumn("pick_image_url", F.when(F.col("id") % 5 == 0, F.concat(F.lit("https://p.example/"), F.col("id").cast("string"))))


@query("queue_view", """
  SELECT id, publish_at IS NOT NULL AS scheduled, CASE WHEN pick_image_source = 'none' THEN 'none (text-only)' WHEN pick_image_library_id > 0 THEN
    'from the image library' WHEN pick_image_url IS NOT NULL THEN 'source photo' ELSE 'no picture chosen' END AS image_label FROM picks WHERE status = 'approved'""", ("picks",))
def queue_view(t):
    return posts.queue_view(_picked(t)).select("id", "scheduled", "image_label")


@query("queue_view_counts", "SELECT count(*) FILTER (WHERE publish_at IS NULL) AS now_count, count(publish_at) AS scheduled_count FROM items WHERE status = 'approved'", ("items",))
def queue_view_counts(t):
    return posts.queue_view_counts(t.items)


@query("publish_batch", """
  SELECT r.id, CASE WHEN i.id IS NOT NULL THEN 'published' ELSE 'skipped' END AS outcome FROM
    (SELECT user_id AS id, min(event_id) AS p FROM events GROUP BY 1) r
  LEFT JOIN (SELECT id FROM items WHERE status = 'approved') i USING (id)""", ("items",))
def publish_batch(t):
    asked = t.events.select(F.col("event_id").alias("position"), F.col("user_id").alias("id"))
    return posts.publish_batch(asked, t.items).select("id", "outcome")


def _cascade(t):
    moved = t.items.filter("id % 5 = 0").select("id", F.lit("pending").alias("status"))
    withdrawn = t.posts.filter("id % 7 = 0").select(F.col("id").alias("post_id"))
    return posts.status_cascade(t.items, t.posts, moved, withdrawn)


@query("cascade_items", """
  SELECT id, CASE WHEN id % 5 = 0 THEN 'pending' WHEN status = 'published' AND id IN (SELECT item_id FROM posts WHERE id % 7 = 0) THEN 'approved' ELSE status END AS status
  FROM items""", ("items", "posts"))
def cascade_items(t):
    return _cascade(t)[0].select("id", "status")


@query("cascade_posts", "SELECT p.id, CASE WHEN p.id % 7 = 0 THEN 'draft' WHEN p.status = 'published' AND item_id % 5 = 0 AND i.id IS NOT NULL THEN 'draft' "
       "ELSE p.status END AS status FROM posts p LEFT JOIN items i ON i.id = item_id", ("posts", "items"))
def cascade_posts(t):
    return _cascade(t)[1].select("id", "status")


@query("feature_until", f"SELECT id, CASE WHEN id % 3 = 0 AND id % 400 BETWEEN 1 AND 365 THEN id % 2 = 0 ELSE featured END AS featured, "
       f"CASE WHEN id % 3 = 0 AND id % 400 BETWEEN 1 AND 365 THEN CASE WHEN id % 2 = 0 THEN {_now} + to_days((id % 400)::INTEGER) END ELSE featured_until END AS featured_until FROM posts", ("posts",))
def feature_until(t):
    requests = t.posts.filter("id % 3 = 0").select("id", (F.col("id") % 2 == 0).alias("on"), (F.col("id") % 400).cast("int").alias("days"))
    out = posts.feature_until(t.posts, requests, NOW)
    return out.select("id", "featured", F.col("featured_until").cast("timestamp_ntz").alias("featured_until"))


def _decisions(t):
    k, acts = F.col("event_id"), ("approve", "schedule", "unqueue_review", "unqueue_skip", "skip", "reset")
    act = F.element_at(F.array(*[F.lit(a) for a in acts]), (k % 6 + 1).cast("int"))
    return t.events.select((F.col("user_id") * 8).alias("item_id"), F.col("ts").cast("timestamp").alias("at"), k.alias("seq"), act.alias("action"),
                           F.when(k % 4 != 0, F.timestamp_seconds(F.lit(1704067200) + k % 1000 * 3600)).alias("publish_at"), F.lit("u").alias("image_url"),
                           F.lit("manual").alias("image_source"), (k % 9).alias("library_id"))


common("decided", f"""
  SELECT user_id * 8 AS item_id, k, ['approve', 'schedule', 'unqueue_review', 'unqueue_skip', 'skip', 'reset'][k % 6 + 1] AS action,
    CASE WHEN k % 4 <> 0 THEN {_hour('(k % 1000)')} END AS due FROM (SELECT user_id, max_by(event_id, (ts, event_id)) AS k FROM events GROUP BY 1)""")
common("judged", f"""
  SELECT i.id, i.status, i.publish_at, d.action, d.due, coalesce(d.action IN ('approve', 'skip', 'reset') OR (d.action IN ('unqueue_review', 'unqueue_skip') AND i.status = 'approved')
    OR (d.action = 'schedule' AND i.status = 'approved' AND (d.due IS NULL OR d.due > {_now})), false) AS ok FROM items i LEFT JOIN decided d ON d.item_id = i.id""", "items", "decided")


@query("decisions_applied", """
  SELECT id, CASE WHEN NOT ok THEN status WHEN action = 'approve' THEN 'approved' WHEN action IN ('skip', 'unqueue_skip') THEN 'skipped'
    WHEN action IN ('reset', 'unqueue_review') THEN 'pending' ELSE status END AS status,
    CASE WHEN ok AND action = 'approve' THEN 'queued' WHEN ok AND action = 'schedule' THEN CASE WHEN due IS NULL THEN 'queued' ELSE 'scheduled' END END AS queue_state,
    CASE WHEN ok AND action = 'schedule' THEN due WHEN ok AND action IN ('approve', 'unqueue_review', 'unqueue_skip') THEN NULL ELSE publish_at END AS publish_at FROM judged""", ("judged",))
def decisions_applied(t):
    rows = _picked(t).withColumn("queue_state", F.lit(None).cast("string"))
    out = posts.apply_decisions(rows, _decisions(t), NOW)[0]
    return out.select("id", "status", "queue_state", F.col("publish_at").cast("timestamp_ntz").alias("publish_at"))


@query("decisions_refused", "SELECT id AS item_id, action FROM judged WHERE action IS NOT NULL AND NOT ok UNION ALL SELECT item_id, action FROM decided "
       "WHERE item_id NOT IN (SELECT id FROM items)", ("judged", "decided"))
def decisions_refused(t):
    rows = _picked(t).withColumn("queue_state", F.lit(None).cast("string"))
    return posts.apply_decisions(rows, _decisions(t), NOW)[1].select("item_id", "action")


@query("picture_options", """
  SELECT item_id, key, key = sel AS preselected FROM (
    SELECT id AS item_id, unnest(list_filter([CASE WHEN image_url IS NOT NULL THEN 'source' END, CASE WHEN id % 3 = 0 THEN 'lib-' || (id % 20) END, 'none'], lambda x: x IS NOT NULL)) AS key,
      CASE WHEN pick_image_source = 'none' THEN 'none' WHEN pick_image_library_id > 0 THEN 'lib-' || pick_image_library_id WHEN pick_image_url IS NOT NULL THEN 'source'
        WHEN id % 3 = 0 THEN 'lib-' || (id % 20) WHEN image_url IS NOT NULL THEN 'source' ELSE 'none' END AS sel FROM picks)""", ("picks",))
def picture_options(t):
    ranked = t.items.filter("id % 3 = 0").select(F.col("id").alias("item_id"), F.lit(1).alias("place"), (F.col("id") % 20).alias("asset_id"),
                                                F.lit("stock").alias("kind"), F.lit("u").alias("url"), F.lit("n").alias("note"))
    return posts.picture_options(_picked(t), ranked).select("item_id", "key", "preselected")


@query("post_page", "SELECT id, featured, nullif(trim(title), '') AS summary FROM (SELECT * FROM placed WHERE list_contains(mode, 'Bus')) ORDER BY place LIMIT 50 OFFSET 10", ("placed",))
def post_page(t):
    rows = posts.post_page(t.posts, NOW, limit=50, offset=10, mode="Bus")
    return rows.select("id", "featured", "summary")


@query("post_total", "SELECT count(*) AS total, 60 < count(*) AS has_more FROM live WHERE list_contains(mode, 'Bus')", ("live",))
def post_total(t):
    return posts.post_total(t.posts, NOW, limit=50, offset=10, mode="Bus")


@query("post_summaries", "SELECT id, nullif(trim(title), '') AS summary FROM posts", ("posts",))
def post_summaries(t):
    return t.posts.select("id", posts.post_summary("body").alias("summary"))


@query("related_posts", """
  SELECT slug, rank, related, score FROM (SELECT slug, related, score, row_number() OVER (PARTITION BY slug ORDER BY score DESC, place) AS rank FROM (
    SELECT x.slug, y.slug AS related, y.place, (CASE WHEN list_has_any(x.agencies, y.agencies) THEN 4 ELSE 0 END + CASE WHEN list_has_any(x.programs, y.programs) THEN 2 ELSE 0 END
      + CASE WHEN x.pillar = y.pillar THEN 1 ELSE 0 END + CASE WHEN x.state = y.state THEN 1 ELSE 0 END)::INTEGER AS score
    FROM placed x JOIN placed y ON x.slug <> y.slug) WHERE score > 0) WHERE rank <= 4""", ("placed",))
def related_posts(t):
    return posts.related(posts.published_posts(t.posts, NOW))


@query("section_posts", "SELECT 'news' AS section, count(*) AS n FROM live UNION ALL SELECT lower(pillar), count(*) FROM live WHERE pillar <> 'Data' GROUP BY 1", ("live",))
def section_posts(t):
    return posts.section_posts(posts.published_posts(t.posts, NOW)).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query("section_pages", """
  SELECT section, id, ceil(row_number() OVER (PARTITION BY section ORDER BY featured DESC, publish_at DESC NULLS LAST, id DESC) / 20)::BIGINT AS page,
    ceil(count(*) OVER (PARTITION BY section) / 20)::BIGINT AS pages
  FROM (SELECT 'news' AS section, * FROM live UNION ALL SELECT lower(pillar), * FROM live WHERE pillar <> 'Data')""", ("live",))
def section_pages(t):
    return posts.paginate(posts.published_posts(t.posts, NOW)).select("section", "id", "page", "pages")


@query("front_page", "SELECT place, CASE WHEN place = 1 THEN 'lead' WHEN place <= 4 THEN 'also' ELSE 'wire' END AS slot, id FROM placed WHERE place <= 12", ("placed",))
def front_page(t):
    return posts.front_page(posts.published_posts(t.posts, NOW)).select("place", "slot", "id")


@query("real_sources", "SELECT id, CASE WHEN id % 5 <> 0 THEN source_url END AS real_source_url, CASE WHEN id % 4 > 1 THEN source_name END AS real_source_name FROM posts", ("posts",))
def real_sources(t):
    return posts.real_source(t.posts).select("id", "real_source_url", "real_source_name")


common("period", "SELECT *, row_number() OVER (ORDER BY publish_at DESC, id DESC) AS r FROM posts WHERE status = 'published' AND publish_at >= TIMESTAMP '2024-01-05' "
       "AND publish_at < TIMESTAMP '2024-01-20'", "posts")
common("rest", "SELECT *, row_number() OVER (ORDER BY r) AS q FROM period WHERE pillar NOT IN ('People', 'Procurement')", "period")


@query("assemble_issue", """
  SELECT 'lead' AS slot, 1 AS place, id FROM rest WHERE q = 1 UNION ALL SELECT 'feed', q - 1, id FROM rest WHERE q BETWEEN 2 AND 5
  UNION ALL SELECT * FROM (SELECT 'moves', row_number() OVER (ORDER BY r) AS p, id FROM period WHERE pillar = 'People') WHERE p <= 3
  UNION ALL SELECT * FROM (SELECT 'procurements', row_number() OVER (ORDER BY r) AS p, id FROM period WHERE pillar = 'Procurement') WHERE p <= 3""", ("rest", "period"))
def assemble_issue(t):
    return posts.assemble_issue(t.posts, datetime(2024, 1, 5), datetime(2024, 1, 20)).select("slot", "place", "id")
