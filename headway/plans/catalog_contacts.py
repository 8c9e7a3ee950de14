"""Queries over contacts, deliveries and issues."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from headway.functions.columns import normalize_email
from headway.operators import contacts
from headway.plans.catalog import common, query
from headway.session import scratch, settle
from headway.sources import buckets, writers

common("contacts", """
  SELECT c_custkey AS id, 'customer.' || c_custkey || '@example.org' AS email, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name,
    ['pending', 'subscribed', 'subscribed', 'unsubscribed', 'bounced'][c_custkey % 5 + 1] AS status, CASE WHEN c_custkey % 3 <> 0 THEN 'web form' END AS source,
    [lower(c_mktsegment), 'r' || (c_custkey % 3)] AS tags, TIMESTAMP '2024-01-01' + to_days((c_custkey % 200)::INTEGER) AS created_at,
    CASE WHEN c_custkey % 5 = 1 THEN TIMESTAMP '2024-01-02' + to_days((c_custkey % 200)::INTEGER) END AS confirmed_at,
    CASE WHEN c_custkey % 5 = 3 THEN TIMESTAMP '2024-01-03' + to_days((c_custkey % 200)::INTEGER) END AS unsubscribed_at,
    ['free', 'Pro', 'unheard', NULL][c_custkey % 4 + 1] AS plan FROM customer""")
common("stopped", "SELECT 'customer.' || c_custkey || '@example.org' AS email FROM customer WHERE c_acctbal < 0")


def _file(t):
    """An import file: every order is one line about its customer, written in the ways people write addresses."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    plain = F.concat(F.lit("customer."), (c * 2).cast("string"), F.lit("@example.org"))
    return t.orders.select(
        k.alias("line_no"), F.when(k % 5 == 0, F.concat(F.lit('"Jane" <'), F.upper(plain), F.lit("> "))).when(k % 5 == 1, F.concat(F.lit("not an address "), c.cast("string")))
        .otherwise(F.concat(F.lit(" '"), plain, F.lit("' "))).alias("address"), F.when(k % 2 == 0, F.concat(F.lit("N"), k.cast("string"))).otherwise("").alias("name"),
        F.array(F.lit("imported")).alias("tags"))


common("import_rows", """
  SELECT f.line_no, f.email, f.name, CASE WHEN f.email IS NULL THEN 'invalid' WHEN line_no <> min(line_no) OVER (PARTITION BY f.email) THEN 'duplicate_in_file'
    WHEN s.email IS NOT NULL OR c.status IN ('unsubscribed', 'bounced', 'complained') THEN 'suppressed' WHEN c.id IS NOT NULL THEN 'updated' ELSE 'added' END AS outcome
  FROM (SELECT o_orderkey AS line_no, CASE WHEN o_orderkey % 5 <> 1 THEN 'customer.' || (o_custkey * 2) || '@example.org' END AS email,
          CASE WHEN o_orderkey % 2 = 0 THEN 'N' || o_orderkey ELSE '' END AS name FROM orders) f
  LEFT JOIN contacts c USING (email) LEFT JOIN stopped s USING (email)""", "contacts", "stopped")


@query("normalize_email", "SELECT o_orderkey AS line_no, CASE WHEN o_orderkey % 5 <> 1 THEN 'customer.' || (o_custkey * 2) || '@example.org' END AS email FROM orders")
def normalized_addresses(t):
    return _file(t).select("line_no", normalize_email("address").alias("email"))


@query("import_outcomes", "SELECT line_no, outcome FROM import_rows", ("import_rows",))
def import_outcomes(t):
    return contacts.import_contacts(_file(t), t.contacts, t.suppressions).select("line_no", "outcome")


@query("import_counts", "SELECT outcome, count(*) AS n FROM import_rows GROUP BY 1", ("import_rows",))
def import_counts(t):
    return contacts.outcome_counts(contacts.import_contacts(_file(t), t.contacts, t.suppressions))


MERGED = """
  SELECT coalesce(c.email, i.email) AS email, coalesce(nullif(i.name, ''), c.name) AS name, coalesce(c.status, 'pending') AS status,
    CASE WHEN c.source IS NOT NULL THEN c.source WHEN i.email IS NOT NULL THEN 'csv import' END AS source,
    CASE WHEN i.email IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_concat(coalesce(c.tags, []), ['imported', 'fall']))), ',') ELSE array_to_string(c.tags, ',') END AS tags
  FROM contacts c FULL OUTER JOIN (SELECT * FROM import_rows WHERE outcome IN ('added', 'updated')) i USING (email)"""


@query("merge_contacts", MERGED, ("contacts", "import_rows"))
def merge_contacts(t):
    rows = contacts.import_contacts(_file(t), t.contacts, t.suppressions).filter("outcome IN ('added', 'updated')").select("email", "name", "tags")
    out = contacts.merge_contacts(t.contacts, rows, "csv import", ["fall"])
    return out.withColumn("tags", F.array_join("tags", ","))


@query("merge_stored_contacts", MERGED, ("contacts", "import_rows"))
def merge_stored_contacts(t):
    """The same import into a contact table stored in buckets."""
    rows = contacts.import_contacts(_file(t), t.contacts, t.suppressions).filter("outcome IN ('added', 'updated')").select("email", "name", "tags")
    have, path = t.contacts.select("email", "name", "status", "source", "tags"), scratch(t.spark, "contacts")
    buckets.store(have, path, F.col("email"))
    contacts.merge_stored_contacts(path, have.schema, rows, "csv import", ["fall"])
    return buckets.read(t.spark, path, have.schema).withColumn("tags", F.array_join("tags", ","))


@query("suppress", """
  SELECT email, CASE WHEN email IN (SELECT email FROM stopped) THEN 'bounced' ELSE min_by(event_type, (ts, event_type)) END AS reason FROM
    (SELECT 'customer.' || user_id || '@example.org' AS email, event_type, ts FROM events UNION ALL SELECT email, 'bounced', TIMESTAMP '2024-01-01' FROM stopped) GROUP BY 1""", ("stopped",))
def suppress(t):
    new = t.events.select(F.concat(F.lit("customer."), F.col("user_id").cast("string"), F.lit("@example.org")).alias("email"), F.col("event_type").alias("reason"),
                          F.lit(None).cast("string").alias("detail"), F.col("ts").cast("timestamp").alias("created_at"))
    return contacts.suppress(t.suppressions, new).select("email", "reason")


def _changes(t):
    status = F.expr("CASE event_type WHEN 'signup' THEN 'subscribed' WHEN 'error' THEN 'bounced' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'unsubscribed' ELSE 'unknown' END")
    return t.events.select(F.col("user_id").alias("contact_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), status.alias("status"), F.lit(None).cast("string").alias("event"))


common("changed", """
  SELECT user_id AS contact_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'subscribed' WHEN 'error' THEN 'bounced' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'unsubscribed' END AS status
  FROM events WHERE event_type <> 'purchase'""")


@query("apply_status", """
  SELECT c.id, coalesce(l.status, c.status) AS status, coalesce(c.confirmed_at, l.c) AS confirmed_at, coalesce(c.unsubscribed_at, l.u) AS unsubscribed_at FROM contacts c LEFT JOIN
    (SELECT contact_id, max_by(status, (ts, event_id)) AS status, min(ts) FILTER (WHERE status = 'subscribed') AS c, min(ts) FILTER (WHERE status = 'unsubscribed') AS u FROM changed GROUP BY 1) l
    ON l.contact_id = c.id""", ("contacts", "changed"))
def apply_status(t):
    out = contacts.apply_status(t.contacts, _changes(t))
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("id", "status", ntz("confirmed_at"), ntz("unsubscribed_at"))


@query("status_suppressions", "SELECT 'customer.' || contact_id || '@example.org' AS email, status AS reason, count(*) AS n FROM changed JOIN customer ON c_custkey = contact_id "
       "WHERE status IN ('unsubscribed', 'bounced') GROUP BY 1, 2", ("changed",))
def status_suppressions(t):
    return contacts.status_suppressions(t.contacts, _changes(t)).groupBy("email", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("mailable", "SELECT id, email FROM contacts WHERE status = 'subscribed' AND email NOT IN (SELECT email FROM stopped) AND list_contains(tags, 'r1')", ("contacts", "stopped"))
def mailable(t):
    return contacts.mailable(t.contacts, t.suppressions, tag="r1").select("id", "email")


@query("contact_counts", "SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in contacts.STATUSES) + ", count(*) AS total, (SELECT count(*) FROM stopped) AS suppressed, "
       "count(*) FILTER (WHERE status = 'subscribed') AS mailable FROM contacts", ("contacts", "stopped"))
def contact_counts(t):
    return contacts.contact_counts(t.contacts, t.suppressions)


@query("list_health", "SELECT s.status, count(c.id) AS n, floor(count(c.id) / (SELECT count(*) FROM contacts) * 100 + 0.5)::BIGINT AS pct FROM (SELECT unnest(['pending', 'subscribed', "
       "'unsubscribed', 'bounced', 'complained']) AS status) s LEFT JOIN contacts c USING (status) GROUP BY 1", ("contacts",))
def list_health(t):
    return contacts.list_health(t.contacts)


@query("contact_list", "SELECT id, email FROM contacts WHERE status = 'subscribed' AND list_contains(tags, 'r2') AND (contains(email, '1') OR contains(lower(name), '1')) "
       "ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10", ("contacts",))
def contact_list(t):
    return contacts.contact_list(t.contacts, status="subscribed", tag="r2", q=" 1 ", limit=50, offset=10).select("id", "email")


@query("tags_in_use", "SELECT DISTINCT unnest(tags) AS tag FROM contacts", ("contacts",))
def tags_in_use(t):
    return contacts.tags_in_use(t.contacts)


common("feedback", """
  SELECT 'n' || event_id AS notification_id, 'm' || event_id AS message_id, 'customer.' || user_id || '@example.org' AS email, ts, event_id,
    CASE event_type WHEN 'error' THEN 'bounce' WHEN 'purchase' THEN 'complaint' ELSE 'delivery' END AS type,
    CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'Permanent' ELSE 'Transient' END || '/General: 550' WHEN 'purchase' THEN 'complaint: unknown' END AS detail,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'bounced' WHEN event_type = 'purchase' THEN 'complained' END AS reason
  FROM events WHERE event_type IN ('error', 'purchase', 'view')""")


@query("feedback_events", "SELECT notification_id, message_id, email, type, detail, reason FROM feedback", ("feedback",))
def feedback_events(t):
    return contacts.feedback_events(t.feedback).select("notification_id", "message_id", "email", "type", "detail", "reason")


common("stopped", "SELECT 'customer.' || c_custkey || '@example.org' AS email, 'bounced' AS reason FROM customer WHERE c_acctbal < 0")


@query("feedback_suppressions", """
  SELECT email, reason FROM stopped UNION ALL
  SELECT email, min_by(reason, (ts, reason)) FROM feedback WHERE reason IS NOT NULL AND email NOT IN (SELECT email FROM stopped) GROUP BY 1""", ("feedback", "stopped"))
def feedback_suppressions(t):
    new = contacts.feedback_suppressions(contacts.feedback_events(t.feedback))
    return contacts.suppress(t.suppressions, new).select("email", "reason")


@query("delivery_update", """
  SELECT event_id AS id, CASE WHEN f.type = 'bounce' THEN 'bounced' WHEN f.type = 'complaint' THEN 'complained' WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 15 = 1 THEN 'skipped' ELSE 'sent' END AS status,
    CASE WHEN f.type <> 'delivery' THEN f.detail END AS detail FROM events LEFT JOIN feedback f USING (event_id)""", ("feedback",))
def delivery_update(t):
    return contacts.delivery_update(t.recipients, contacts.feedback_events(t.feedback)).select("id", "status", "detail")


common("sends", "SELECT event_id AS id, day(ts) AS issue_id, 'customer.' || user_id || '@example.org' AS email, ts, CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 15 = 1 THEN 'skipped' ELSE 'sent' END AS status FROM events")


@query("send_rollup", "SELECT issue_id, count(*) AS recipients, count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER (WHERE status = 'failed') AS failed, "
       "count(*) FILTER (WHERE status = 'skipped') AS skipped FROM sends GROUP BY 1", ("sends",))
def send_rollup(t):
    return contacts.send_rollup(t.recipients)


def _issues(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("id"), F.when(k % 3 != 0, k % 100).alias("issue_no"), F.concat(F.lit("Issue "), k.cast("string")).alias("subject"), F.lower("o_orderstatus").alias("status"),
                           F.col("o_orderdate").cast("timestamp").alias("created_at"), F.array(k, k + 1).alias("post_ids"))


@query("issue_list", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 100 ELSE o_orderkey END AS issue_no, 2 AS posts FROM orders ORDER BY 1 DESC LIMIT 30")
def issue_list(t):
    return contacts.issue_list(_issues(t), 30).select("id", "issue_no", "posts")


@query("next_issue", "SELECT max(o_orderkey % 100) + 1 AS issue_no FROM orders WHERE o_orderkey % 3 <> 0")
def next_issue(t):
    return contacts.next_issue(_issues(t))


@query("issue_outcomes", "SELECT issue_id, id, email, status, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS at FROM sends", ("sends",))
def issue_outcomes(t):
    return contacts.issue_outcomes(t.recipients).select("issue_id", "id", "email", "status", "at")


@query("mail_events_by_type", "SELECT type, count(*) AS n FROM feedback GROUP BY 1", ("feedback",))
def mail_events_by_type(t):
    return contacts.events_by_type(contacts.feedback_events(t.feedback))


@query("latest_mail_events", "SELECT event_id AS id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS at, type FROM feedback ORDER BY event_id DESC LIMIT 25", ("feedback",))
def latest_mail_events(t):
    rows = contacts.feedback_events(t.feedback).withColumn("id", F.substring("notification_id", 2, 20).cast("bigint"))
    return contacts.latest_events(rows, 25).select("id", "at", "type")


@query("signup_outcomes", """
  SELECT line_no, CASE WHEN email IS NULL THEN 'invalid' WHEN s.email IS NOT NULL OR c.status IN ('unsubscribed', 'bounced', 'complained') THEN 'suppressed' WHEN c.id IS NOT NULL THEN 'updated' ELSE 'added' END AS outcome
  FROM (SELECT line_no, email FROM import_rows) LEFT JOIN contacts c USING (email) LEFT JOIN stopped s USING (email)""", ("import_rows", "contacts", "stopped"))
def signup_outcomes(t):
    return contacts.signup_outcomes(_file(t), t.contacts, t.suppressions).select("line_no", "outcome")


@query("token_events", """
  SELECT event_id AS seq, id AS contact_id, CASE WHEN event_type = 'signup' THEN 'subscribed' ELSE 'unsubscribed' END AS status FROM events JOIN contacts ON id = user_id
  WHERE (event_type = 'signup' AND status <> 'subscribed' AND email NOT IN (SELECT email FROM stopped)) OR event_type = 'click'""", ("contacts", "stopped"))
def token_events(t):
    rows = t.events.filter("event_type IN ('signup', 'click')")
    kind = F.when(F.col("event_type") == "signup", "confirm").otherwise("unsubscribe")
    links = rows.select(F.concat(F.substring(kind, 1, 1), F.col("user_id").cast("string")).alias("token"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    return contacts.token_events(links, t.contacts, t.suppressions).select("seq", "contact_id", "status")


@query("contact_export", """
  SELECT email, coalesce(name, '') AS name, status, coalesce(source, '') AS source, array_to_string(tags, ';') AS tags, coalesce(strftime(confirmed_at, '%Y-%m-%d'), '') AS confirmed_on FROM contacts WHERE status = 'subscribed'""", ("contacts",))
def contact_export(t):
    rows = writers.contact_rows(t.contacts, "subscribed")
    return rows.select("email", "name", "status", "source", "tags", F.substring("confirmed_at", 1, 10).alias("confirmed_on"))


@query("contact_files", """
  SELECT email AS address, name || chr(10) || 'Dept, "A"' AS name, 'x;' || status AS tags, 'named' AS kind FROM contacts WHERE name IS NOT NULL
  UNION ALL SELECT email, coalesce(name, ''), '', 'bare' FROM contacts""", ("contacts",))
def contact_files(t):
    """Files as people have them: with a header in another order and quoted line breaks, and without a header."""
    from headway.operators.contacts import parse_contacts
    from headway.sources.readers import read_contact_files
    path = scratch(t.spark, "contact-files")
    named = t.contacts.filter("name IS NOT NULL").select(
        F.concat(F.lit("x;"), "status").alias("Tags"), F.col("email").alias("E-Mail"), F.concat("name", F.lit('\n' + 'Dept, "A"')).alias("Full Name"))
    named.write.option("quoteAll", True).option("escape", '"').csv(path + "/named", header=True)
    t.contacts.select("email", "name").write.csv(path + "/bare", header=False)
    rows = parse_contacts(settle(read_contact_files(t.spark, path + "/*", 8)))
    return rows.select("address", "name", F.array_join("tags", ";").alias("tags"), F.when(F.contains("file", F.lit("/named/")), "named").otherwise("bare").alias("kind"))


@query("contact_file_round_trip", "SELECT email AS address, coalesce(name, '') AS name, array_to_string(tags, ';') AS tags FROM contacts WHERE status = 'bounced'", ("contacts",))
def contact_file_round_trip(t):
    """Exported as CSV, read back through its header."""
    from headway.sources.readers import read_flat
    path = scratch(t.spark, "contacts")
    writers.export_contacts(t.contacts, path, "bounced")
    return contacts.contact_columns(read_flat(t.spark, path)).select("address", "name", F.array_join("tags", ";").alias("tags"))
