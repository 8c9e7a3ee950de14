"""Queries over archived documents, listing pages and web pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from headway.functions.columns import date_in_name_last, norm_name
from headway.functions.ordered import previous_row
from headway.operators import archive, grants, pages
from headway.plans import linking_sql
from headway.plans.catalog import common, query
from headway.plans import catalog_grants  # noqa: F401  (shared WITH entries)
from headway.sources import writers

common("canon", r"""
  SELECT id, project_name, sponsor, captured_on, changed, file_name, array_to_string(list_filter(list_transform(
      string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))),
      lambda s: s <> '' AND NOT regexp_matches(s, '^(?i)(page\s*)?\d{1,3}(\s*of\s*\d{1,3})?$')), chr(10)) AS text
  FROM versions""", "versions")


@query("canonical_text", "SELECT id, text, sha256(text) AS text_sha256 FROM canon", ("canon",))
def canonical_text(t):
    rows = t.versions.select("id", archive.canonical_text("text").alias("text"))
    return rows.withColumn("text_sha256", archive.text_hash("text"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def content_hashes(t):
    return t.documents.select("doc_id", archive.text_hash("text").alias("text_sha256"))


common("arrivals", """
  SELECT *, sha256(text) AS h, length(text) < 200 AS short FROM canon WHERE id % 100 <> 0""", "canon")
common("stored", "SELECT *, sha256(text) AS h FROM canon WHERE id % 100 = 0", "canon")
common("admitted", """
  SELECT project_name, sponsor, h, min(captured_on) AS captured_on, min(id) AS id FROM arrivals a WHERE NOT EXISTS
    (SELECT 1 FROM stored s WHERE s.project_name = a.project_name AND s.sponsor = a.sponsor AND s.h = a.h) GROUP BY 1, 2, 3""",
       "arrivals", "stored")
common("chain", """
  SELECT id, lag(id) OVER (PARTITION BY project_name, sponsor ORDER BY captured_on, id) AS prev FROM
    (SELECT project_name, sponsor, captured_on, id FROM admitted UNION ALL SELECT project_name, sponsor, captured_on, id FROM stored)""",
       "admitted", "stored")


@query("admit_versions", """
  SELECT a.id, short, CASE WHEN d.id IS NULL THEN 'unchanged' WHEN c.prev IS NULL THEN 'new'
           ELSE 'changed' END AS status, CASE WHEN d.id IS NOT NULL THEN c.prev END AS prev_version_id
  FROM arrivals a LEFT JOIN admitted d ON d.id = a.id LEFT JOIN chain c ON c.id = a.id""", ("arrivals", "admitted", "chain"))
def admit_versions(t):
    """First turns are the archive, later turns arrive in order."""
    rows = t.versions.withColumn("text", archive.canonical_text("text"))
    stored = rows.filter("id % 100 = 0").withColumn("text_sha256", archive.text_hash("text"))
    out = archive.admit_versions(rows.filter("id % 100 <> 0"), stored, ["project_name", "sponsor"], least=200)
    return out.select("id", "short", "status", "prev_version_id")


def _chained(t):
    """Versions with the one before; only ids pass through the ordered chain."""
    chain = previous_row(t.versions.select("id", "project_name", "sponsor", "captured_at"), ["project_name", "sponsor"],
                         [F.asc("captured_at"), F.asc("id")], {"prev_version_id": "id"})
    return t.versions.join(chain.select("id", "prev_version_id"), "id")


common("version_pairs", "SELECT id, lag(id) OVER (PARTITION BY project_name, sponsor ORDER BY captured_on, id) AS prev_version_id FROM versions", "versions")
common("version_lines", """
  SELECT id, line, count(*) AS n FROM (SELECT id, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]')) AS line FROM versions) GROUP BY 1, 2""", "versions")


@query("line_changes", """
  SELECT p.id, p.prev_version_id, coalesce(sum(greatest(nw - od, 0)), 0)::BIGINT AS lines_added, coalesce(sum(greatest(od - nw, 0)), 0)::BIGINT AS lines_removed,
    coalesce(sum(least(nw, od)), 0)::BIGINT AS lines_kept FROM version_pairs p LEFT JOIN (
      SELECT id, line, sum(nw) AS nw, sum(od) AS od FROM (
        SELECT id, line, n AS nw, 0 AS od FROM version_lines UNION ALL
        SELECT q.id, line, 0, n FROM version_pairs q JOIN version_lines v ON v.id = q.prev_version_id) GROUP BY 1, 2) c ON c.id = p.id
  WHERE p.prev_version_id IS NOT NULL GROUP BY 1, 2""", ("version_pairs", "version_lines"))
def line_changes(t):
    """Each version against the one before it."""
    return archive.line_changes(_chained(t))


_lines = r"string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]')"


@query("ordered_line_changes", f"""
  WITH RECURSIVE {{entries}}
  both_texts AS (SELECT p.id, p.prev_version_id, n.lines AS new, o.lines AS old FROM version_pairs p
    JOIN (SELECT id, {_lines} AS lines FROM versions) n ON n.id = p.id JOIN (SELECT id, {_lines} AS lines FROM versions) o ON o.id = p.prev_version_id),
  table_rows(id, k, best) AS (SELECT id, 0, list_transform(new, lambda x: 0) FROM both_texts UNION ALL
    SELECT id, k, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
      SELECT b.id, k + 1 AS k, list_transform(range(1, len(new) + 1), lambda j: greatest(best[j], CASE WHEN new[j] = old[k + 1] THEN 1 + CASE WHEN j = 1 THEN 0 ELSE best[j - 1] END ELSE 0 END)) AS c
      FROM table_rows r JOIN both_texts b ON b.id = r.id WHERE k < len(old))),
  longest AS (SELECT b.id, r.best[len(new)] AS kept FROM both_texts b JOIN table_rows r ON r.id = b.id AND r.k = len(b.old)),
  shared AS (SELECT p.id, sum(least(n.n, o.n)) AS common FROM version_pairs p JOIN version_lines n ON n.id = p.id
    JOIN version_lines o ON o.id = p.prev_version_id AND o.line = n.line GROUP BY 1)
  SELECT b.id, b.prev_version_id, (len(new) - kept)::BIGINT AS lines_added, (len(old) - kept)::BIGINT AS lines_removed, kept::BIGINT AS lines_kept,
    (coalesce(common, 0) - kept)::BIGINT AS lines_moved FROM both_texts b JOIN longest USING (id) LEFT JOIN shared USING (id)""", ("version_pairs", "version_lines"))
def ordered_line_changes(t):
    """Each version against the one before it, with the order of lines."""
    return archive.ordered_changes(_chained(t))


@query("line_changes_by_project", """
  SELECT project_name, count(*) AS versions, sum(lines_added)::BIGINT AS lines_added, sum(lines_removed)::BIGINT AS lines_removed FROM (
    SELECT p.id, sum(greatest(nw - od, 0)) AS lines_added, sum(greatest(od - nw, 0)) AS lines_removed FROM version_pairs p JOIN (
      SELECT id, line, sum(nw) AS nw, sum(od) AS od FROM (
        SELECT id, line, n AS nw, 0 AS od FROM version_lines UNION ALL
        SELECT q.id, line, 0, n FROM version_pairs q JOIN version_lines v ON v.id = q.prev_version_id) GROUP BY 1, 2) c ON c.id = p.id
    WHERE p.prev_version_id IS NOT NULL GROUP BY 1) JOIN versions USING (id) GROUP BY 1""", ("version_pairs", "version_lines", "versions"))
def line_changes_by_project(t):
    """Recomputed changes of all versions, summed by project."""
    rows = archive.line_changes(_chained(t)).join(t.versions.select("id", "project_name"), "id")
    return rows.groupBy("project_name").agg(F.count(F.lit(1)).alias("versions"), F.sum("lines_added").alias("lines_added"),
                                            F.sum("lines_removed").alias("lines_removed"))


_named = ("CASE doc_id % 3 WHEN 0 THEN 'X-Profile-AR26-' || (doc_id % 12 + 1) || '-' || (doc_id % 28 + 1) || '-25.pdf' "
          "WHEN 1 THEN 'Y-' || (doc_id % 12 + 1) || '-' || (doc_id % 28 + 1) || '-2026-final.pdf' ELSE 'no date ' || doc_id END")


@query("dates_in_file_names", """
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN printf('2025-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1)
    WHEN 1 THEN printf('2026-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1) END AS fta_date FROM documents""")
def dates_in_file_names(t):
    return t.documents.select("doc_id", F.expr(_named).alias("n")).select("doc_id", date_in_name_last("n").alias("fta_date"))


def _listing_page(t):
    """Listing pages of fifty suppliers each, with a second table that must be ignored."""
    row = F.concat(
        F.lit("<tr><td>"), F.concat(F.lit("N"), F.char(65 + F.col("s_nationkey"))), F.lit("</td><td>"), "r_name",
        F.lit("</td><td> Line&nbsp;"), "s_name", F.lit("</td><td>"),
        F.when(F.col("s_acctbal") < 0, "Engineering").otherwise("Project Development"), F.lit('</td><td><a href="/p/'),
        F.col("s_suppkey").cast("string"), F.lit('">Profile</a></td></tr>'))
    pages_ = (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
              .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    head = ("<table><tr><th>Other</th></tr><tr><td>1</td></tr></table><TABLE class='x'><tr><th>State</th><th>City</th>"
            "<th>Project Name</th><th>Stage of Development</th><th>Project Profile</th></tr>")
    return pages_.groupBy(F.floor(F.col("s_suppkey") / 50).alias("page_id")).agg(F.concat(
        F.lit(head), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</TABLE>")).alias("html"))


common("listing", """
  SELECT s_suppkey // 50 AS page_id, 'N' || chr(65 + s_nationkey) AS state, r_name AS city, 'Line ' || s_name AS name,
         CASE WHEN s_acctbal < 0 THEN 'Engineering' ELSE 'Project Development' END AS stage,
         'https://www.transit.dot.gov/p/' || s_suppkey AS profile_url
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")


@query("listing_rows", "SELECT page_id, state, city, name, stage, profile_url FROM listing", ("listing",))
def listing_rows(t):
    return archive.html_table_rows(_listing_page(t)).drop("table_no", "row_no")


def _listing(t, shift: int):
    """Listing snapshots: names, stages and links of suppliers; ``shift`` changes some of them."""
    k = F.col("s_suppkey")
    rows = t.supplier.select(
        k.alias("row_no"), F.concat(F.lit("N"), F.char(65 + F.col("s_nationkey"))).alias("state"),
        F.concat(F.lit("The "), "s_name", F.lit(" Project")).alias("name"),
        F.when((k + shift) % 4 == 0, "Engineering").otherwise("Development").alias("stage"),
        F.when((k % 3 != 0) | F.lit(shift == 0), F.concat(F.lit("/p/"), k.cast("string"))).alias("profile_url"))
    return rows.filter((k + shift) % 5 != 0)


_sql_listing = """SELECT s_suppkey AS row_no, 'N' || chr(65 + s_nationkey) AS state, 'The ' || s_name || ' Project' AS name,
    CASE WHEN s_suppkey % 4 = 0 THEN 'Engineering' ELSE 'Development' END AS stage, '/p/' || s_suppkey AS profile_url FROM supplier WHERE s_suppkey % 5 <> 0"""
_sql_listed = f"SELECT row_no AS profile_id, {linking_sql.key_of('name')} AS key, [state] AS states FROM ({_sql_listing})"
_sql_suppliers = """SELECT s_suppkey AS order_no, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' Extension' ELSE '' END AS name, 'N' || chr(65 + s_nationkey) AS state FROM supplier"""


@query("match_listing", f"""WITH {linking_sql.links(_sql_suppliers, _sql_listed)},
linked AS (SELECT s.order_no, s.name, s.state, l.profile_id FROM ({_sql_suppliers}) s JOIN links l ON l.name = s.name AND l.state = s.state),
kept AS (SELECT *, CASE WHEN order_no = min(order_no) OVER (PARTITION BY profile_id) THEN profile_id END AS row_no FROM linked)
  SELECT k.name AS project_name, CASE WHEN k.name IS NOT NULL THEN '' END AS sponsor, coalesce(k.state, r.state) AS state, r.name AS listing_name, r.stage AS listing_stage,
    r.profile_url, CASE WHEN k.name IS NULL THEN 'not_a_project' WHEN r.row_no IS NULL THEN 'not_listed' ELSE 'matched' END AS outcome,
    k.name IS NOT NULL AND r.row_no IS NOT NULL AND {linking_sql.key_of('k.name')} <> {linking_sql.key_of('r.name')} AS renamed
  FROM kept k FULL OUTER JOIN ({_sql_listing}) r ON r.row_no = k.row_no""")
def match_listing(t):
    """Suppliers listed on the page against projects that carry nearly the same names."""
    k = F.col("s_suppkey")
    projects = t.supplier.select(
        k.alias("order_no"), F.concat("s_name", F.when(k % 2 == 0, " Extension").otherwise("")).alias("project_name"),
        F.lit("").alias("sponsor"), F.concat(F.lit("N"), F.char(65 + F.col("s_nationkey"))).alias("state"))
    return archive.match_listing(_listing(t, 0), projects)


@query("listing_changes", """
  SELECT coalesce(n.state, o.state) AS state, coalesce(n.name, o.name) AS name, u.kind, u.detail FROM
    (SELECT s_suppkey AS k, 'N' || chr(65 + s_nationkey) AS state, 'The ' || s_name || ' Project' AS name, CASE WHEN s_suppkey % 4 = 0
       THEN 'Engineering' ELSE 'Development' END AS stage, '/p/' || s_suppkey AS url FROM supplier WHERE s_suppkey % 5 <> 0) o
  FULL OUTER JOIN
    (SELECT s_suppkey AS k, 'N' || chr(65 + s_nationkey) AS state, 'The ' || s_name || ' Project' AS name, CASE WHEN (s_suppkey + 1) % 4 = 0
       THEN 'Engineering' ELSE 'Development' END AS stage, CASE WHEN s_suppkey % 3 <> 0 THEN '/p/' || s_suppkey END AS url
     FROM supplier WHERE (s_suppkey + 1) % 5 <> 0) n ON n.k = o.k,
  LATERAL (SELECT unnest(list_filter([
      CASE WHEN o.k IS NULL THEN {'kind': 'added', 'detail': 'new on FTA''s page (' || n.stage || ')'} END,
      CASE WHEN n.k IS NULL THEN {'kind': 'removed', 'detail': 'no longer on FTA''s page'} END,
      CASE WHEN o.stage <> n.stage THEN {'kind': 'stage', 'detail': 'stage ' || o.stage || ' → ' || n.stage} END,
      CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL AND coalesce(o.url, '') <> coalesce(n.url, '')
           THEN {'kind': 'link', 'detail': 'profile link changed'} END], lambda x: x IS NOT NULL)) AS u)""")
def listing_changes(t):
    return archive.listing_diff(_listing(t, 0), _listing(t, 1)).select("state", "name", "kind", "detail")


common("marks", "SELECT snapshot_date, string_agg(project_name || '|' || coalesce(phase, ''), ',' ORDER BY project_name, sponsor) AS doc, "
       "count(*) AS rows FROM snaps GROUP BY 1", "snaps")


@query("repeated_snapshots", """
  SELECT snapshot_date, rows, CASE WHEN doc = lag(doc) OVER (ORDER BY snapshot_date) THEN 'skipped' ELSE 'stored' END AS outcome
  FROM (SELECT * FROM marks UNION ALL SELECT snapshot_date + 1, doc, rows FROM marks)""", ("marks",))
def repeated_snapshots(t):
    """Every snapshot is followed by an identical copy one day later."""
    again = t.snapshots.withColumn("snapshot_date", F.date_add("snapshot_date", 1))
    return archive.skip_same_snapshot(t.snapshots.unionByName(again), "snapshot_date", ["project_name", "sponsor", "phase"])


@query("profiles_to_download", """
  SELECT g.project_name, g.sponsor, array_to_string(list_filter([
      CASE WHEN g.ck % 17 = 0 THEN 'stage changed' END,
      CASE WHEN g.pdf_url IS NOT NULL AND NOT coalesce(v.have, false) THEN 'FTA''s page links a file not yet archived: Project%20' || g.ck || '.pdf' END,
      CASE WHEN v.n IS NULL THEN 'no archived version' END], lambda x: x IS NOT NULL), '; ') AS why
  FROM (SELECT *, replace(project_name, 'Project ', '')::BIGINT AS ck FROM project_pages) g
  JOIN (SELECT DISTINCT project_name, coalesce(sponsor, '') AS sponsor FROM latest) p USING (project_name, sponsor)
  LEFT JOIN (SELECT project_name, sponsor, count(*) AS n, bool_or(file_name IS NOT NULL) AS have FROM versions GROUP BY 1, 2) v
    USING (project_name, sponsor)
  WHERE g.ck % 17 = 0 OR (g.pdf_url IS NOT NULL AND NOT coalesce(v.have, false)) OR v.n IS NULL""",
       ("project_pages", "latest", "versions"))
def profiles_to_download(t):
    changes = t.customer.filter("c_custkey % 17 = 0").select(
        F.concat(F.lit("S"), (F.col("c_custkey") % 5).cast("string")).alias("state"),
        F.concat(F.lit("Project "), F.col("c_custkey").cast("string")).alias("name"), F.lit("stage changed").alias("detail"),
        F.lit("stage").alias("kind"))
    return archive.to_download(t.project_pages, t.versions, archive.current_projects(t.snapshot_store), changes).select(
        "project_name", "sponsor", "why")


@query("find_unique", f"""WITH {linking_sql.judged("SELECT s_name AS name, 'N' || chr(65 + s_nationkey) AS state FROM supplier", _sql_listed)},
hits AS (SELECT profile_id, count(*) AS hits, min(name) AS name, arg_min(state, (name, state)) AS state, string_agg(name, ', ' ORDER BY name) AS names
    FROM judged WHERE same OR inside OR ratio >= {linking_sql.CLOSE} GROUP BY profile_id)
  SELECT row_no AS profile_id, d.name AS title, coalesce(hits, 0) AS hits, CASE WHEN hits = 1 THEN h.name END AS project_name, CASE WHEN hits = 1 THEN h.state END AS state,
    CASE WHEN hits > 1 THEN 'matches several projects: ' || names WHEN hits IS NULL THEN 'no current project matches “' || d.name || '”' END AS reason
  FROM ({_sql_listing}) d LEFT JOIN hits h ON h.profile_id = d.row_no""")
def find_unique(t):
    """Each listing row as a document, judged against all projects."""
    docs = _listing(t, 0).select(F.col("row_no").alias("profile_id"), F.col("name").alias("title"), norm_name("name").alias("key"),
                                 F.array("state").alias("states"))
    projects = t.supplier.select(F.col("s_name").alias("project_name"),
                                 F.concat(F.lit("N"), F.char(65 + F.col("s_nationkey"))).alias("state"))
    return archive.find_unique(docs, projects)


@query("archive_coverage", """
  SELECT count(*) AS projects, count(g.profile_url) AS linked, count(v.k) AS archived,
         (SELECT count(*) FROM versions) AS versions, (SELECT count(*) FROM versions WHERE changed) AS changed
  FROM latest p LEFT JOIN project_pages g ON g.project_name = p.project_name AND g.sponsor = coalesce(p.sponsor, '')
  LEFT JOIN (SELECT DISTINCT project_name, sponsor, 1 AS k FROM versions) v ON v.project_name = p.project_name
    AND v.sponsor = coalesce(p.sponsor, '')""", ("latest", "project_pages", "versions"))
def archive_coverage(t):
    return archive.archive_coverage(t.snapshot_store, t.project_pages, t.versions)


@query("version_list", "SELECT project_name, sponsor, id, changed FROM versions", ("versions",))
def version_list(t):
    return archive.version_list(t.versions).select("project_name", "sponsor", "id", "changed")


@query("merge_pages", """
  SELECT coalesce(n.project_name, g.project_name) AS project_name, CASE WHEN n.k IS NOT NULL THEN '/new/' || n.k ELSE g.profile_url END
           AS profile_url, CASE WHEN n.k IS NULL AND g.ck % 3 <> 0 AND g.ck % 2 = 0 THEN 'https://files.example.org/' || g.ck ELSE g.pdf_url END AS pdf_url
  FROM (SELECT *, replace(project_name, 'Project ', '')::BIGINT AS ck FROM project_pages) g FULL OUTER JOIN
       (SELECT p_partkey AS k, 'Project ' || p_partkey AS project_name FROM part WHERE p_partkey % 13 = 0) n
    ON n.project_name = g.project_name AND g.sponsor = ''""", ("project_pages",))
def merge_pages(t):
    pairs = t.part.filter("p_partkey % 13 = 0").select(
        F.concat(F.lit("Project "), F.col("p_partkey").cast("string")).alias("project_name"), F.lit("").alias("sponsor"),
        F.lit("XX").alias("state"), F.concat(F.lit("/new/"), F.col("p_partkey").cast("string")).alias("profile_url"),
        F.lit("n").alias("listing_name"), F.lit("s").alias("listing_stage"))
    k = F.col("c_custkey")
    links = t.customer.select(
        F.concat(F.lit("https://grants.example.org/p/"), k.cast("string")).alias("page_url"),
        F.concat(F.when(k % 2 == 0, "https://files.example.org/").otherwise("https://elsewhere.example.com/"),
                 k.cast("string")).alias("pdf_url"))
    return archive.merge_pages(t.project_pages, pairs, links, ["files.example.org"]).select(
        "project_name", "profile_url", "pdf_url")


@query("current_projects", "SELECT project_name, coalesce(sponsor, '') AS sponsor, state FROM latest", ("latest",))
def current_projects(t):
    return archive.current_projects(t.snapshots)


@query("last_run", "SELECT event_id AS id, event_type AS trigger, user_id AS files FROM events WHERE event_type IN ('click', 'view') "
       "ORDER BY event_id DESC LIMIT 1")
def last_run(t):
    runs = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("trigger"), F.col("user_id").alias("files"))
    return archive.last_run(runs, ["click", "view"])


@query("run_log", """
  SELECT 'weekly' AS trigger, TIMESTAMP '2026-09-22 00:00:00' AS ran_at, count(*) AS files, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS new_versions,
         count(*) FILTER (WHERE event_type = 'click') AS changed, count(*) FILTER (WHERE event_type = 'purchase') AS unchanged FROM events""")
def run_log(t):
    status = F.expr("CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'changed' WHEN 'purchase' THEN 'unchanged' "
                    "WHEN 'error' THEN 'unreadable' ELSE 'unmatched' END")
    results = t.events.select(F.col("event_id").cast("string").alias("file"), status.alias("status"), F.col("props").alias("message"))
    return writers.run_log(results, "weekly", datetime(2026, 9, 22))[0]


@query("run_notes", "SELECT CAST(event_id AS VARCHAR) || ': ' || coalesce(props, '') AS note FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def run_notes(t):
    status = F.expr("CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'changed' WHEN 'purchase' THEN 'unchanged' "
                    "WHEN 'error' THEN 'unreadable' ELSE 'unmatched' END")
    results = t.events.select(F.col("event_id").cast("string").alias("file"), status.alias("status"), F.col("props").alias("message"))
    return writers.run_log(results, "weekly", datetime(2026, 9, 22))[1]


# ---- web pages ----------------------------------------------------------------------------------

common("page_plain", r"""
  WITH body AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1), ''), html) AS h FROM pages),
  dropped AS (SELECT page_id, """ + "regexp_replace(" * 9 + "h" + "".join(
    rf", '(?is)<{tag}\b.*?</{tag}>', ' ', 'g')" for tag in ("script", "style", "noscript", "svg", "form", "nav", "header", "footer", "aside")) + r""" AS h FROM body),
  plain AS (SELECT page_id, """ + "replace(" * 11 + r"regexp_replace(regexp_replace(h, '(?i)</(p|div|li|h[1-6]|tr)>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g')"
    + "".join(f", '{a}', '{b}')" for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                                              ("&rsquo;", "''"), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&mdash;", "-"), ("&ndash;", "-"))) + r""" AS x FROM dropped)
  SELECT page_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'), chr(10)), lambda s: trim(s)), chr(10)),
      '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM plain""")


@query("page_text", "SELECT page_id, text FROM page_plain", ("page_plain",))
def page_text(t):
    return t.pages.select("page_id", pages.page_text("html").alias("text"))


@query("readable_pages", "SELECT page_id, length(text) >= 600 AS readable FROM page_plain", ("page_plain",))
def readable_pages(t):
    return t.pages.select("page_id", pages.readable(pages.page_text("html")).alias("readable"))


@query("page_hosts", "SELECT page_id, replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS host FROM pages")
def page_hosts(t):
    from headway.functions.columns import host_of
    return t.pages.select("page_id", host_of("url").alias("host"))


def _with_pictures(t):
    """The pages with picture markup added around their whole HTML."""
    n = F.col("page_id").cast("string")
    head = F.concat(F.lit('<meta property="og:image" content="/img/'), n, F.lit('.jpg">'))
    turned = F.concat(F.lit("<meta content='https://cdn.example.org/"), n, F.lit(".png' name='x' property='og:image:url'>"))
    body = F.concat(F.lit('<img src="pic'), n, F.lit('.jpg" width="640" alt="A '), n, F.lit('"><img src="/icon.png"><img data-src="lazy.jpg" '
                    'srcset="s.jpg 320w, big.jpg 1280w"><img src="small.jpg" width="20"><a href="/docs/Plan'), n, F.lit('.PDF">x</a>'))
    return t.pages.select("page_id", F.concat(F.lit("https://news.example.org/a/"), n, F.lit("/index.html")).alias("url"),
                          F.concat(F.when(F.col("page_id") % 3 == 0, head).when(F.col("page_id") % 3 == 1, turned).otherwise(""),
                                   "html", body).alias("html"))


@query("social_images", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://news.example.org/img/' || page_id || '.jpg' "
       "WHEN 1 THEN 'https://cdn.example.org/' || page_id || '.png' END AS image_url FROM pages")
def social_images(t):
    return pages.social_image(_with_pictures(t)).select("page_id", "image_url")


@query("image_candidates", """
  SELECT page_id, place, url, kind FROM (
    SELECT page_id, 1 AS place, CASE page_id % 3 WHEN 0 THEN 'https://news.example.org/img/' || page_id || '.jpg'
      WHEN 1 THEN 'https://cdn.example.org/' || page_id || '.png' END AS url, 'og:image' AS kind FROM pages WHERE page_id % 3 <> 2
    UNION ALL SELECT page_id, CASE WHEN page_id % 3 <> 2 THEN 2 ELSE 1 END, 'https://news.example.org/a/' || page_id || '/pic' || page_id || '.jpg', 'article' FROM pages
    UNION ALL SELECT page_id, CASE WHEN page_id % 3 <> 2 THEN 3 ELSE 2 END, 'https://news.example.org/a/' || page_id || '/big.jpg', 'article' FROM pages)""")
def image_candidates(t):
    return pages.image_candidates(_with_pictures(t)).select("page_id", "place", "url", "kind")


@query("document_links", "SELECT page_id, 'https://news.example.org/docs/Plan' || page_id || '.PDF' AS document_url FROM pages")
def document_links(t):
    return pages.document_links(_with_pictures(t), ["news.example.org"]).select("page_id", "document_url")
