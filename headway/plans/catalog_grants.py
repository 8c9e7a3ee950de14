"""Queries over the grant snapshots."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from headway.functions.columns import date_from_name, norm_name
from headway.operators import grants, linkage
from headway.plans import linking_sql
from headway.plans.catalog import common, query

common("dashboard", """
  SELECT o_orderkey AS line_no, date_trunc('quarter', o_orderdate)::DATE AS snapshot_date, 'Project ' || o_custkey AS project_name,
         CASE WHEN o_custkey % 13 <> 0 THEN c_mktsegment END AS sponsor, r_name AS city,
         'N' || chr(65 + n_nationkey) || CASE WHEN o_custkey % 7 = 0 THEN '-ZZ' ELSE '' END AS state,
         CASE o_custkey % 4 WHEN 0 THEN 'BRT' WHEN 1 THEN 'Light Rail' WHEN 3 THEN 'Streetcar' END AS mode,
         CASE o_orderstatus WHEN 'F' THEN 'Eng' WHEN 'O' THEN 'Unknown' WHEN 'P' THEN 'PD' END AS phase,
         o_orderpriority AS rating, o_totalprice AS cost_musd,
         CASE WHEN o_orderkey % 9 <> 0 THEN floor(o_totalprice / 2) END AS cig_request_musd,
         (o_orderkey % 50 + 20) || '%' AS cig_share,
         ['Spring 2027', 'August 2026', '2028', 'TBD', 'early 2027'][o_orderkey % 5 + 1] AS est_grant,
         ['Committed', 'In Progress'][o_orderkey % 2 + 1] AS noncig_status,
         ['TBD', 'N/A', NULL][o_orderkey % 3 + 1] AS excl_brt
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
       JOIN region ON r_regionkey = n_regionkey""")
common("snaps", """
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, project_name, sponsor ORDER BY line_no) rn
    FROM dashboard WHERE phase IN ('PD', 'Eng', 'Const', 'FFGA', 'CGA')) WHERE rn = 1""", "dashboard")
common("latest", "SELECT * FROM snaps WHERE snapshot_date = (SELECT max(snapshot_date) FROM snaps)", "snaps")
common("project_pages", """
  SELECT 'Project ' || c_custkey AS project_name, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment ELSE '' END AS sponsor,
         'S' || (c_custkey % 5) AS state, 'Project ' || c_custkey AS listing_name,
         CASE WHEN c_custkey % 3 <> 0 THEN 'https://grants.example.org/p/' || c_custkey END AS profile_url,
         CASE WHEN c_custkey % 4 <> 0 THEN 'https://grants.example.org/files/Project%20' || c_custkey || '.pdf' END AS pdf_url
  FROM customer""")
common("versions", """
  SELECT conv_id * 100 + turn AS id, 'Project ' || conv_id AS project_name,
         CASE WHEN conv_id % 13 <> 0 THEN coalesce(c_mktsegment, 'NONE') ELSE '' END AS sponsor,
         DATE '2024-01-01' + turn::INTEGER AS captured_on, turn > 0 AS changed,
         CASE WHEN conv_id % 2 = 0 THEN 'Project ' || conv_id || '.pdf' END AS file_name, text
  FROM conversations LEFT JOIN customer ON c_custkey = conv_id""")


@query("valid_dashboard_rows", "SELECT phase, count(*) AS n FROM dashboard WHERE regexp_matches(state, "
       "'^[A-Z]{2}(-[A-Z]{2})?$') AND phase IN ('PD', 'Eng', 'Const', 'FFGA', 'CGA') GROUP BY 1", ("dashboard",))
def valid_dashboard_rows(t):
    return grants.valid_rows(t.dashboard).groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query("clean_money", "SELECT line_no, cost_musd, cig_request_musd FROM dashboard", ("dashboard",))
def clean_money(t):
    rows = grants.with_money(t.dashboard)
    return rows.select("line_no", F.col("cost_musd").cast("double").alias("cost_musd"),
                       F.col("cig_request_musd").cast("double").alias("cig_request_musd"))


_file = "'dash-' || CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%m-%d-%Y') END || '.pdf'"


def _files(t):
    iso, us = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "MM-dd-yyyy")
    return t.orders.select("o_orderkey", F.concat(F.lit("dash-"), F.when(F.col("o_orderkey") % 2 == 0, iso).otherwise(us),
                                                  F.lit(".pdf")).alias("url"))


@query("date_from_name", "SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, "
       "CASE WHEN year(o_orderdate) >= 2000 THEN o_orderdate::DATE ELSE DATE '2026-09-11' END AS snapshot_date FROM orders")
def dates_from_names(t):
    return _files(t).select("o_orderkey", date_from_name("url").alias("day"),
                            grants.snapshot_date("url", date(2026, 9, 11)).alias("snapshot_date"))


@query("latest_file", f"SELECT max_by(url, (d, url)) AS url FROM (SELECT {_file} AS url, CASE WHEN year(o_orderdate) >= 2000 "
       "THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS d FROM orders)")
def latest_file(t):
    return grants.latest_file(_files(t))


_snap_cols = ["snapshot_date", "project_name", "sponsor", "line_no", "phase", "est_grant"]


@query("dedupe_first", f"SELECT {', '.join(_snap_cols)} FROM snaps", ("snaps",))
def dedupe_first(t):
    return t.snapshots.select(*_snap_cols)


@query("load_outcomes", "SELECT snapshot_date, count(*) AS projects, CASE WHEN count(*) >= 300 THEN 'loaded' ELSE 'refused' END "
       "AS status FROM snaps GROUP BY 1", ("snaps",))
def load_outcomes(t):
    return grants.load_outcomes(t.snapshots, least=300)


@query("canonical_names", """
  SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(raw), '&', ' and '),
    '\\([^)]*\\)', ' ', 'g'), '\\bbus rapid transit\\b', 'brt', 'g'), '[^a-z0-9]+', ' ', 'g'), '\\b(the|project|program)\\b', ' ', 'g'),
    '\\s+', ' ', 'g')) AS key
  FROM (SELECT p_partkey, 'The ' || p_name || ' & Bus Rapid Transit (' || p_brand || ') Project' AS raw FROM part)""")
def canonical_names(t):
    raw = F.concat(F.lit("The "), "p_name", F.lit(" & Bus Rapid Transit ("), "p_brand", F.lit(") Project"))
    return t.part.select("p_partkey", norm_name(raw).alias("key"))


_phrases = "['Bus Rapid Transit', 'a BRT line', 'Light Rail', 'heavy rail', 'Commuter Rail', 'Streetcar', 'Lightrail']"


@query("canonical_modes", f"""
  SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'BRT' WHEN 1 THEN 'BRT' WHEN 2 THEN 'Light Rail' WHEN 3 THEN 'Heavy Rail'
    WHEN 4 THEN 'Commuter Rail' WHEN 5 THEN 'Streetcar' END AS mode FROM part""")
def canonical_modes(t):
    said = F.element_at(F.array(*[F.lit(x.strip(" '")) for x in _phrases.strip("[]").split(",")]),
                        (F.col("p_partkey") % 7 + 1).cast("int"))
    return t.part.select("p_partkey", linkage.canon_mode(F.concat("p_name", F.lit(" "), said)).alias("mode"))


_names = list(linkage.STATE_CODES)
_sql_names = "[" + ", ".join(f"'{n}'" for n in _names) + "]"
_sql_codes = "[" + ", ".join(f"'{c}'" for c in linkage.STATE_CODES.values()) + "]"


@query("states_in_place", f"""
  SELECT c_custkey, array_to_string(list_sort(list_distinct(CASE WHEN contains(place, 'washington, dc') OR contains(place, 'district of columbia')
      THEN list_filter(found, lambda c: c <> 'WA') ELSE found END)), ',') AS states
  FROM (SELECT c_custkey, place, list_filter(list_transform(range(1, {len(_names)} + 1), lambda i:
          CASE WHEN regexp_matches(place, '\\b' || ({_sql_names})[i] || '\\b') THEN ({_sql_codes})[i] END), lambda c: c IS NOT NULL) AS found
        FROM (SELECT c_custkey, 'metro, ' || ({_sql_names})[c_custkey % {len(_names)} + 1] || ' and ' ||
                ({_sql_names})[c_nationkey % {len(_names)} + 1] AS place FROM customer))""")
def states_in_place(t):
    names = F.array(*[F.lit(n) for n in _names])
    pick = lambda c: F.initcap(F.element_at(names, (F.col(c) % len(_names) + 1).cast("int")))
    place = F.concat(F.lit("Metro, "), pick("c_custkey"), F.lit(" and "), pick("c_nationkey"))
    return t.customer.select("c_custkey", F.array_join(linkage.states_in(place), ",").alias("states"))


@query("profile_facts", f"""
  SELECT file, title, 'Metro, ' || place AS place, CASE k % 3 WHEN 0 THEN 'Core Capacity' WHEN 1 THEN 'New Starts Engineering' ELSE '' END AS program,
    array_to_string(list_sort(list_filter(list_transform(range(1, {len(_names)} + 1), lambda i:
      CASE WHEN regexp_matches(place, '\\b' || ({_sql_names})[i] || '\\b') THEN ({_sql_codes})[i] END), lambda c: c IS NOT NULL AND NOT (c = 'WA' AND contains(place, 'washington, dc')))), ',') AS states,
    CASE WHEN k % 2 = 0 THEN 'line ' || k || ' and brt' ELSE 'line ' || k || ' corridor' END AS key,
    CASE k % 4 WHEN 1 THEN 'Light Rail Transit' WHEN 2 THEN 'Bus Rapid Transit Line' WHEN 3 THEN 'Extension' END AS mode_field,
    CASE k % 4 WHEN 1 THEN 'Light Rail' WHEN 2 THEN 'BRT' END AS mode, k % 4 = 1 OR k % 5 = 0 AS mentions_rail, k % 2 = 0 AS mentions_brt
  FROM (SELECT c_custkey AS k, 'profiles/' || c_custkey || '.pdf' AS file, ({_sql_names})[c_custkey % {len(_names)} + 1] AS place,
          CASE WHEN c_custkey % 2 = 0 THEN 'The Line ' || c_custkey || ' & Bus Rapid Transit (Phase 1) Project'
            ELSE 'Line ' || c_custkey || ' Corridor' END AS title FROM customer)""")
def profile_facts(t):
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    title = F.when(k % 2 == 0, text("The Line ", k, " & Bus Rapid Transit (Phase 1) Project")).otherwise(text("Line ", k, " Corridor"))
    place = text("  Metro, ", F.element_at(F.array(*[F.lit(n) for n in _names]), (k % len(_names) + 1).cast("int")))
    program = F.when(k % 3 == 0, "Core Capacity").when(k % 3 == 1, " New Starts Engineering").otherwise("Description")
    stated = F.when(k % 4 == 1, "Proposed Project: Light Rail Transit ").when(k % 4 == 2, "Proposed Project:\nBus Rapid Transit Line").when(k % 4 == 3, "Proposed Project: Extension")
    first = F.concat_ws("\n", F.lit(" "), title, F.lit(""), place, program)
    second = F.concat_ws("\n", stated, F.when(k % 5 == 0, "replaces a Streetcar"))
    landed = t.customer.select(text("profiles/", k, ".pdf").alias("file"), F.array(first, second, F.lit("Light rail on a later page")).alias("pages"))
    return linkage.profile_facts(landed).withColumn("states", F.array_join("states", ","))


def _profiles(t):
    """Profiles from the parts: every distinct product line of a type is one profile of that state."""
    lines = t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("profile_id"),
                                                    F.min("p_type").alias("p_type"))
    return lines.select(
        "profile_id", norm_name(F.concat("p_name", F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit(" line ")))).alias("key"),
        F.array(F.left("p_type", F.lit(2))).alias("states"),
        F.when(F.col("profile_id") % 3 == 0, "Light Rail").when(F.col("profile_id") % 3 == 1, "BRT").alias("mode"),
        (F.col("profile_id") % 2 == 0).alias("mentions_rail"),
        F.concat(F.lit("f"), F.col("profile_id").cast("string"), F.lit(".pdf")).alias("file"))


def _part_projects(t):
    return t.part.select(
        F.concat(F.lit("The "), F.initcap("p_name"), F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit(" Line ")),
                 F.when(F.col("p_size") % 3 == 0, " Extension").when(F.col("p_size") % 3 == 1, "0").otherwise("")).alias("name"),
        F.left("p_type", F.lit(2)).alias("state"), F.col("p_size").alias("size"))


_sql_profiles = f"""SELECT min(p_partkey) AS profile_id, {linking_sql.key_of("p_name || ' ' || replace(p_brand, '#', ' line ')")} AS key,
    [left(min(p_type), 2)] AS states FROM part GROUP BY p_name, p_brand"""
_initcap = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
_sql_projects = f"""SELECT 'The ' || {_initcap} || ' ' || replace(p_brand, '#', ' Line ') || CASE p_size % 3 WHEN 0 THEN ' Extension' WHEN 1 THEN '0' ELSE '' END AS name,
    left(p_type, 2) AS state, p_size FROM part"""


@query("link_profiles", f"""WITH {linking_sql.links(_sql_projects, _sql_profiles)}
  SELECT name, state, key, profile_id, tier FROM links""")
def link_profiles(t):
    return linkage.link_profiles(_part_projects(t), _profiles(t))


@query("assign_mode", """
  SELECT line_no, CASE WHEN lane AND pm IS NOT NULL AND pm <> 'BRT' THEN NULL WHEN lane AND linked AND pm IS NULL AND rail THEN NULL
           WHEN lane THEN 'BRT' ELSE pm END AS mode,
         CASE WHEN lane AND pm IS NOT NULL AND pm <> 'BRT' THEN 'conflict: dashboard BRT column vs profile (' || pm || ')'
           WHEN lane AND linked AND pm IS NULL AND rail THEN 'conflict: dashboard BRT column but the profile also describes a rail mode'
           WHEN lane THEN 'FTA dashboard (Length of Exclusive BRT)' WHEN pm IS NOT NULL THEN 'FTA project profile'
           ELSE 'not stated by FTA sources' END AS source
  FROM (SELECT line_no, coalesce(excl_brt, '') NOT IN ('', 'N/A') AS lane, line_no % 5 <> 0 AS linked,
          CASE WHEN line_no % 5 <> 0 THEN mode END AS pm, line_no % 2 = 0 AS rail FROM dashboard)""", ("dashboard",))
def assign_mode(t):
    linked = F.col("line_no") % 5 != 0
    a = linkage.assign_mode(F.col("excl_brt"), linked, F.when(linked, F.col("mode")), F.col("line_no") % 2 == 0)
    return t.dashboard.select("line_no", a.alias("a")).select("line_no", "a.mode", "a.source")


@query("backfill_attribute", """
  SELECT s.snapshot_date, s.project_name, s.sponsor, coalesce(s.excl_brt, n.newest) AS excl_brt FROM snaps s LEFT JOIN
    (SELECT project_name, sponsor, max_by(excl_brt, snapshot_date) AS newest FROM snaps WHERE excl_brt IS NOT NULL GROUP BY 1, 2) n
    ON n.project_name = s.project_name AND n.sponsor = s.sponsor""", ("snaps",))
def backfill_attribute(t):
    return grants.backfill_attr(t.snapshots, "excl_brt").select("snapshot_date", "project_name", "sponsor", "excl_brt")


@query("remode_counts", f"""WITH {linking_sql.links(_sql_projects, _sql_profiles)}
  SELECT CASE WHEN lane AND mode <> 'BRT' THEN 'conflict' WHEN lane AND profile_id IS NOT NULL AND mode IS NULL AND rail THEN 'conflict'
      WHEN lane THEN '{linkage.FROM_DASHBOARD}' WHEN mode IS NOT NULL THEN '{linkage.FROM_PROFILE}' ELSE '{linkage.NOT_STATED}' END AS source, count(*) AS n
  FROM (SELECT r.p_size % 2 = 0 AS lane, profile_id, CASE profile_id % 3 WHEN 0 THEN 'Light Rail' WHEN 1 THEN 'BRT' END AS mode, profile_id % 2 = 0 AS rail
    FROM ({_sql_projects}) r JOIN links l ON l.name = r.name AND l.state = r.state) GROUP BY 1""")
def remode_counts(t):
    """Profiles re-linked over all projects, then counted by where the mode came from."""
    rows = _part_projects(t).select(F.col("name").alias("project_name"), "state",
                                    F.when(F.col("size") % 2 == 0, "TBD").alias("excl_brt"))
    return linkage.provenance_counts(linkage.remode(rows, _profiles(t)))


@query("snapshot_counts", "SELECT snapshot_date, count(*) AS projects FROM snaps GROUP BY 1", ("snaps",))
def snapshot_counts(t):
    return grants.snapshots(t.snapshots)


@query("compare_pair", "SELECT max(snapshot_date) AS to_date, (SELECT max(snapshot_date) FROM snaps WHERE snapshot_date < "
       "(SELECT max(snapshot_date) FROM snaps)) AS from_date FROM snaps", ("snaps",))
def compare_pair(t):
    return grants.pick_pair(grants.snapshots(t.snapshots))


common("old_new", """
  SELECT b.project_name AS bp, a.project_name AS ap, coalesce(b.project_name, a.project_name) AS project_name,
         CASE WHEN b.project_name IS NOT NULL THEN b.sponsor ELSE a.sponsor END AS sponsor,
         CASE WHEN b.project_name IS NOT NULL THEN b.state ELSE a.state END AS state,
         CASE WHEN b.project_name IS NOT NULL THEN b.mode ELSE a.mode END AS mode,
         [a.phase, a.rating, a.est_grant, a.cig_share, a.noncig_status, a.cost_musd::DECIMAL(18,3)::VARCHAR,
          a.cig_request_musd::DECIMAL(18,3)::VARCHAR] AS av,
         [b.phase, b.rating, b.est_grant, b.cig_share, b.noncig_status, b.cost_musd::DECIMAL(18,3)::VARCHAR,
          b.cig_request_musd::DECIMAL(18,3)::VARCHAR] AS bv,
         a.phase AS aphase, b.phase AS bphase, a.cost_musd AS acost, b.cost_musd AS bcost,
         a.cig_request_musd AS acig, b.cig_request_musd AS bcig
  FROM (SELECT * FROM snaps WHERE snapshot_date = DATE '2000-07-01') a FULL OUTER JOIN
       (SELECT * FROM snaps WHERE snapshot_date = DATE '2000-10-01') b
    ON a.project_name = b.project_name AND a.sponsor IS NOT DISTINCT FROM b.sponsor""", "snaps")
_fields = ["phase", "rating", "est_grant", "cig_share", "noncig_status", "cost_musd", "cig_request_musd"]
common("changes", """
  SELECT project_name, sponsor, state, mode, CASE WHEN ap IS NULL THEN 'new' ELSE 'dropped' END AS type, NULL AS before, NULL AS after,
         NULL AS direction, NULL::DOUBLE AS delta, NULL::DOUBLE AS pct, coalesce(bphase, aphase) AS phase
  FROM old_new WHERE ap IS NULL OR bp IS NULL
  """ + "".join(f"""
  UNION ALL SELECT project_name, sponsor, state, mode, '{f}', av[{i + 1}], bv[{i + 1}],
    {"CASE WHEN (CASE bphase WHEN 'PD' THEN 1 WHEN 'Eng' THEN 2 END) > (CASE aphase WHEN 'PD' THEN 1 WHEN 'Eng' THEN 2 END) THEN 'advanced' ELSE 'back' END" if f == 'phase' else 'NULL'},
    {f"round_even(({x[1]} - {x[0]}) * 10, 0) / 10" if (x := {'cost_musd': ('acost', 'bcost'), 'cig_request_musd': ('acig', 'bcig')}.get(f)) else 'NULL'},
    {f"round_even(({x[1]} - {x[0]}) / {x[0]} * 100 * 10, 0) / 10" if x else 'NULL'}, NULL
  FROM old_new WHERE ap IS NOT NULL AND bp IS NOT NULL AND av[{i + 1}] IS DISTINCT FROM bv[{i + 1}]""" for i, f in enumerate(_fields)), "old_new")

_change_cols = ["project_name", "sponsor", "state", "mode", "type", "before", "after", "direction", "delta", "pct", "phase"]


def _diff(t):
    pick = grants.pick_pair(grants.snapshots(t.snapshot_store), date(2000, 10, 1), date(2000, 7, 1))
    return grants.snapshot_diff(grants.at_snapshot(t.snapshot_store, pick, "from_date"),
                                grants.at_snapshot(t.snapshot_store, pick, "to_date"))


@query("snapshot_changes", f"SELECT {', '.join(_change_cols)} FROM changes", ("changes",))
def snapshot_changes(t):
    return grants.order_changes(_diff(t)).select(*_change_cols)


@query("change_summary", "SELECT type, count(*) AS n FROM changes GROUP BY 1", ("changes",))
def change_summary(t):
    return grants.diff_summary(_diff(t))


@query("project_history", "SELECT project_name, sponsor, snapshot_date, phase, rating, cost_musd, est_grant FROM snaps", ("snaps",))
def project_history(t):
    rows = grants.project_history(t.snapshots)
    return rows.select("project_name", "sponsor", "snapshot_date", "phase", "rating",
                       F.col("cost_musd").cast("double").alias("cost_musd"), "est_grant")


_steps = [("phase", "phase", ""), ("rating", "rating", ""), ("est_grant", "est. grant", ""),
          ("cig_request_musd", "CIG", "::DECIMAL(18,3)::VARCHAR"), ("cost_musd", "cost", "::DECIMAL(18,3)::VARCHAR")]


@query("project_timeline", """
  SELECT project_name, sponsor, snapshot_date, CASE WHEN p_seen IS NULL THEN 'first seen' WHEN step = '' THEN 'no change' ELSE step END AS step
  FROM (SELECT *, array_to_string(list_filter([""" + ", ".join(
    f"CASE WHEN p_{f} IS DISTINCT FROM {f} THEN '{lab} ' || coalesce(p_{f}{c}, '?') || ' → ' || coalesce({f}{c}, '?') END"
    for f, lab, c in _steps) + """], lambda x: x IS NOT NULL), ' · ') AS step
    FROM (SELECT *, lag(1) OVER w AS p_seen, """ + ", ".join(f"lag({f}) OVER w AS p_{f}" for f, _, _ in _steps) + """
          FROM snaps WINDOW w AS (PARTITION BY project_name, sponsor ORDER BY snapshot_date)))""", ("snaps",))
def project_timeline(t):
    return grants.timeline(t.snapshots)


@query("grant_listing", """
  SELECT p.project_name, p.sponsor, p.state, p.mode, p.phase, p.cig_request_musd, g.profile_url, v.n AS profile_versions, v.at AS profile_changed_at
  FROM latest p LEFT JOIN project_pages g ON g.project_name = p.project_name AND g.sponsor = coalesce(p.sponsor, '')
  LEFT JOIN (SELECT project_name, sponsor, count(*) AS n, strftime(max(captured_on) FILTER (WHERE changed), '%Y-%m-%d') AS at
             FROM versions GROUP BY 1, 2) v ON v.project_name = p.project_name AND v.sponsor = coalesce(p.sponsor, '')""",
       ("latest", "project_pages", "versions"))
def grant_listing(t):
    rows = grants.grant_listing(t.snapshot_store, t.project_pages, t.versions)
    return rows.select("project_name", "sponsor", "state", "mode", "phase",
                       F.col("cig_request_musd").cast("double").alias("cig_request_musd"), "profile_url",
                       "profile_versions", "profile_changed_at")


@query("grant_listing_filtered", "SELECT project_name, sponsor, phase FROM latest WHERE mode IS NULL AND phase = 'PD' "
       "AND lower(sponsor) LIKE '%chin%'", ("latest",))
def grant_listing_filtered(t):
    rows = grants.grant_listing(t.snapshot_store, t.project_pages, t.versions, mode="Unspecified", phase="PD", sponsor="chin")
    return rows.select("project_name", "sponsor", "phase")


@query("grant_summary", """
  SELECT CASE WHEN g = 1 THEN 'phase' WHEN g = 2 THEN 'mode' ELSE 'all' END AS facet, coalesce(phase, m) AS value, projects, cig_musd
  FROM (SELECT phase, m, grouping_id(phase, m) AS g, count(*) AS projects, sum(cig_request_musd) AS cig_musd
        FROM (SELECT *, coalesce(mode, 'Unspecified') AS m FROM latest) GROUP BY GROUPING SETS ((phase), (m), ()))""", ("latest",))
def grant_summary(t):
    return grants.grant_summary(t.snapshot_store)


@query("version_rollup", "SELECT project_name, sponsor, count(*) AS profile_versions, strftime(max(captured_on) FILTER (WHERE changed), "
       "'%Y-%m-%d') AS profile_changed_at FROM versions GROUP BY 1, 2", ("versions",))
def version_rollup(t):
    return grants.version_rollup(t.versions)


@query("sort_keys", """
  SELECT line_no, CASE phase WHEN 'PD' THEN 1 WHEN 'Eng' THEN 2 END AS phase_key, (line_no % 50 + 20)::DOUBLE AS share_key,
         [2027.3, 2026 + 7.5 / 12, 2028.5, NULL, 2027.15][line_no % 5 + 1]::DOUBLE AS grant_key FROM snaps""", ("snaps",))
def sort_keys(t):
    return t.snapshots.select("line_no", grants.sort_key("phase").alias("phase_key"), grants.sort_key("cig_share").alias("share_key"),
                              grants.sort_key("est_grant").alias("grant_key"))


@query("sorted_projects", "SELECT project_name, est_grant FROM latest", ("latest",))
def sorted_projects(t):
    return grants.sort_projects(grants.latest_rows(t.snapshots), "est_grant").select("project_name", "est_grant")


@query("grant_stat", """
  SELECT count(*) AS projects, coalesce(sum(cig_request_musd), 0)::DOUBLE AS total_musd, count(*) FILTER (WHERE phase = 'Eng') AS engineering,
         CASE WHEN sum(cig_request_musd) >= 1000 THEN printf('$%.1fB', sum(cig_request_musd) / 1000) ELSE printf('$%.0fM', sum(cig_request_musd)) END AS figure
  FROM latest""", ("latest",))
def grant_stat(t):
    return grants.grant_stat(t.snapshots)


@query("load_history", """
  SELECT event_id AS id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS loaded_at, event_type AS status FROM events
  ORDER BY ts DESC, event_id DESC LIMIT 200""")
def load_history(t):
    loads = t.events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("loaded_at"),
                            F.col("event_type").alias("status"))
    return grants.load_history(loads, top=200)


@query("stale_snapshot", "SELECT max(snapshot_date) AS snapshot, (DATE '2001-09-01' - max(snapshot_date))::INTEGER AS age_days, "
       "DATE '2001-09-01' - max(snapshot_date) > 45 AS stale FROM snaps", ("snaps",))
def stale_snapshot(t):
    return grants.stale_snapshot(t.snapshots, date(2001, 9, 1))


@query("projects_for_agency", """
  SELECT r_name AS agency, project_name, snapshot_date FROM snaps JOIN region
    ON upper(sponsor) = ['BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD', 'AUTOMOBILE'][r_regionkey + 1]""", ("snaps",))
def projects_for_agency(t):
    names = F.array(*[F.lit(x) for x in ("Building", "Machinery", "Furniture", "Household", "Automobile")])
    agencies = t.region.select(F.col("r_name").alias("name"), F.lit("").alias("cig_sponsor"),
                               F.array(F.element_at(names, F.col("r_regionkey") + 1)).alias("aliases"))
    return grants.projects_for_agency(t.snapshots, agencies).select("agency", "project_name", "snapshot_date")
