"""Contacts, suppressions, deliveries and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.functions.columns import array_of, eastern_minute, normalize_email
from headway.sources import buckets

# fixed values
STATUSES = ("pending", "subscribed", "unsubscribed", "bounced", "complained")
SUPPRESSED = ("unsubscribed", "bounced", "complained")
EMAIL_HEADERS = ("email", "e-mail", "email address", "emailaddress")
NAME_HEADERS = ("name", "full name", "fullname", "contact")


# ---- files --------------------------------------------------------------------------------------

def contact_columns(rows: DataFrame) -> DataFrame:
    """(address, name, tags) from a read CSV, whatever its header calls them; other columns stay."""
    named = {c.strip().lower(): c for c in rows.columns}
    pick = lambda options: F.coalesce(*[F.nullif(F.trim(F.col(f"`{named[o]}`")), F.lit("")) for o in options if o in named], F.lit(""))
    tags = F.col(f"`{named['tags']}`") if "tags" in named else F.lit(None).cast("string")
    split = F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(*[c for c in rows.columns if c.startswith("_")], pick(EMAIL_HEADERS).alias("address"),
                       pick(NAME_HEADERS).alias("name"), split.alias("tags"))


def parse_contacts(rows: DataFrame) -> DataFrame:
    """Rows of contact files to (file, line_no, address, name, tags), each file by its own first row.

    ``rows(file, line_no, cells)``. A first row that names an address column is a header, and the file's other
    columns are found by name; otherwise the cells are address and name. Only the first row of each file is
    folded and joined back.
    """
    low = F.transform(F.col("head"), lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    at = lambda options: F.coalesce(*[F.nullif(F.array_position("low", o), F.lit(0)) for o in options])
    heads = rows.groupBy("file").agg(F.min_by("cells", "line_no").alias("head"), F.min("line_no").alias("first")).withColumn("low", low)
    heads = heads.select("file", "first", at(EMAIL_HEADERS).alias("at_email"), at(NAME_HEADERS).alias("at_name"), at(("tags",)).alias("at_tags"))
    both = rows.join(heads, "file").filter(F.col("at_email").isNull() | (F.col("line_no") != F.col("first")))
    cell = lambda n: F.trim(F.coalesce(F.get("cells", (n - 1).cast("int")), F.lit("")))
    named = F.col("at_email").isNotNull()
    address = F.when(named, cell(F.col("at_email"))).otherwise(cell(F.lit(1)))
    name = F.when(named & F.col("at_name").isNull(), "").when(named, cell(F.col("at_name"))).otherwise(cell(F.lit(2)))
    tags = F.when(named & F.col("at_tags").isNotNull(), cell(F.col("at_tags"))).otherwise("")
    split = F.filter(F.transform(F.split(tags, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    out = both.select("file", "line_no", address.alias("address"), name.alias("name"), split.alias("tags"))
    return out.filter("address <> '' OR name <> ''")


# ---- outcomes -----------------------------------------------------------------------------------

def _known(rows: DataFrame, contacts: DataFrame, suppressions: DataFrame) -> DataFrame:
    have = contacts.select("email", F.col("id").alias("contact_id"), F.col("status").alias("contact_status"))
    stop = suppressions.select("email", F.lit(True).alias("stopped")).distinct()
    return rows.join(have, "email", "left").join(stop, "email", "left").withColumn("stopped", F.coalesce("stopped", F.lit(False)))


def import_contacts(file: DataFrame, contacts: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Outcome of every file row: invalid, duplicate_in_file (the first line wins), suppressed, updated,
    added. ``file(line_no, address, name, tags)``."""
    rows = file.withColumn("email", normalize_email("address"))
    first = rows.filter("email IS NOT NULL").groupBy("email").agg(F.min("line_no").alias("_first"))
    rows = _known(rows.join(first, "email", "left"), contacts, suppressions)
    stop = F.col("stopped") | F.coalesce(F.col("contact_status").isin(*SUPPRESSED), F.lit(False))
    outcome = (F.when(F.col("email").isNull(), "invalid").when(F.col("line_no") != F.col("_first"), "duplicate_in_file")
               .when(stop, "suppressed").when(F.col("contact_id").isNotNull(), "updated").otherwise("added"))
    return rows.withColumn("outcome", outcome).drop("_first", "stopped", "contact_status")


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def merge_contacts(contacts: DataFrame, incoming: DataFrame, source: str, default_tags=()) -> DataFrame:
    """The contact table after an import: a non-blank name wins, the first source stays, tags are united,
    status is untouched; new addresses start pending. ``incoming(email, name, tags)`` unique by email."""
    n = incoming.select("email", F.col("name").alias("n_name"), F.concat("tags", array_of(*default_tags)).alias("n_tags"), F.lit(True).alias("_n"))
    both = contacts.join(n, "email", "full_outer")
    tags = F.array_sort(F.array_distinct(F.concat(F.coalesce("tags", array_of()), F.coalesce("n_tags", array_of()))))
    return both.select(
        "email", F.coalesce(F.nullif("n_name", F.lit("")), F.col("name")).alias("name"), F.coalesce("status", F.lit("pending")).alias("status"),
        F.coalesce("source", F.when(F.col("_n"), F.lit(source))).alias("source"),
        F.when(F.col("_n"), tags).otherwise(F.col("tags")).alias("tags"))


def merge_stored_contacts(path: str, schema: T.StructType, incoming: DataFrame, source: str, default_tags=(), count: int = buckets.BUCKETS) -> list[int]:
    """``merge_contacts`` into a contact table stored in buckets of the address; only touched buckets are read and written."""
    address = F.col("email")
    return buckets.merge(incoming, path, schema, address, address, lambda n, o: merge_contacts(o, n, source, default_tags), count)


def suppress(suppressions: DataFrame, new: DataFrame) -> DataFrame:
    """The do-not-mail list with new entries; the first reason of an address is kept."""
    cols = ["email", "reason", "detail", "created_at"]
    both = suppressions.select(*cols, F.lit(0).alias("_n")).unionByName(new.select(*cols, F.lit(1).alias("_n")))
    first = both.groupBy("email").agg(F.min_by(F.struct("reason", "detail", "created_at"), F.struct("_n", "created_at", "reason")).alias("r"))
    return first.select("email", "r.*")


def apply_status(contacts: DataFrame, changes: DataFrame) -> DataFrame:
    """Fold status changes into contacts: the latest wins, first confirmation and first opt-out are
    stamped once. ``changes(contact_id, at, seq, status, event)``."""
    ok = changes.filter(F.col("status").isin(*STATUSES))
    at = lambda s: F.min(F.when(F.col("status") == s, F.col("at")))
    fold = ok.groupBy("contact_id").agg(
        F.max_by(F.struct("status", "at", F.coalesce("event", "status").alias("event")), F.struct("at", "seq")).alias("l"),
        at("subscribed").alias("_c"), at("unsubscribed").alias("_u"))
    rows = contacts.join(fold, F.col("id") == F.col("contact_id"), "left")
    return rows.withColumns({
        "status": F.coalesce("l.status", "status"), "confirmed_at": F.coalesce("confirmed_at", "_c"),
        "unsubscribed_at": F.coalesce("unsubscribed_at", "_u"), "last_event_at": F.coalesce("l.at", "last_event_at"),
        "last_event": F.coalesce("l.event", "last_event")}).drop("contact_id", "l", "_c", "_u")


def status_suppressions(contacts: DataFrame, changes: DataFrame) -> DataFrame:
    """Addresses whose status change puts them on the do-not-mail list."""
    bad = changes.filter(F.col("status").isin(*SUPPRESSED))
    return (bad.join(contacts.select(F.col("id").alias("contact_id"), "email"), "contact_id")
            .select("email", F.col("status").alias("reason"), F.lit(None).cast("string").alias("detail"), F.col("at").alias("created_at")))


def mailable(contacts: DataFrame, suppressions: DataFrame, tag: str | None = None, n: int | None = None) -> DataFrame:
    rows = contacts.filter("status = 'subscribed'").join(suppressions.select("email"), "email", "left_anti")
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    rows = rows.orderBy("id")
    return rows.limit(n) if n else rows


def contact_counts(contacts: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Contacts per status with zeros, in total, suppressed and mailable; one row."""
    n = lambda s: F.count_if(F.col("status") == s)
    per = contacts.agg(*[n(s).alias(s) for s in STATUSES], F.count(F.lit(1)).alias("total"))
    return per.crossJoin(suppressions.agg(F.count(F.lit(1)).alias("suppressed"))).withColumn("mailable", F.col("subscribed"))


def list_health(contacts: DataFrame) -> DataFrame:
    """Share of each status in whole percent, with zeros for unused statuses."""
    counts = contacts.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    rows = counts.select("total", F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATUSES])))
    share = F.floor(F.col("n") / F.nullif(F.col("total"), F.lit(0)) * 100 + 0.5)
    return rows.select("status", "n", F.coalesce(share, F.lit(0)).alias("pct"))


def contact_list(contacts: DataFrame, status=None, tag=None, q=None, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = contacts
    if status:
        rows = rows.filter(F.col("status") == status)
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    if q:
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q.strip().lower()))
        rows = rows.filter(has("email") | has("name"))
    rows = rows.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset))
    return rows if limit is None else rows.limit(limit)


def tags_in_use(contacts: DataFrame) -> DataFrame:
    return contacts.select(F.explode("tags").alias("tag")).distinct()


# ---- feedback -----------------------------------------------------------------------------------

MESSAGE = ("notificationType string, eventType string, mail struct<messageId:string>, "
           "bounce struct<bounceType:string,bounceSubType:string,bouncedRecipients:array<struct<emailAddress:string,diagnosticCode:string>>>, "
           "complaint struct<complaintFeedbackType:string,complainedRecipients:array<struct<emailAddress:string>>>, "
           "delivery struct<recipients:array<string>>")


def feedback_events(messages: DataFrame) -> DataFrame:
    """Mail feedback notifications to one row per recipient: type, detail, and whether the address must
    be suppressed. ``messages(Type, MessageId, Timestamp, Message)`` with JSON in ``Message``."""
    rows = messages.filter("Type = 'Notification'").withColumn("b", F.from_json("Message", MESSAGE))
    what = F.coalesce("b.notificationType", "b.eventType")
    one = lambda kind, email, detail, reason: F.struct(
        F.lit(kind).alias("type"), email.alias("address"), detail.alias("detail"), reason.alias("reason"))
    no = F.lit(None).cast("string")
    said = lambda c: F.coalesce(c, F.lit("None"))
    hard = F.when(F.col("b.bounce.bounceType") == "Permanent", "bounced")
    bounced = F.transform("b.bounce.bouncedRecipients", lambda r: one("bounce", r["emailAddress"], F.concat(
        said(F.col("b.bounce.bounceType")), F.lit("/"), said(F.col("b.bounce.bounceSubType")), F.lit(": "),
        F.coalesce(r["diagnosticCode"], F.lit(""))), hard))
    complained = F.transform("b.complaint.complainedRecipients", lambda r: one("complaint", r["emailAddress"], F.concat(
        F.lit("complaint: "), F.coalesce("b.complaint.complaintFeedbackType", F.lit("unknown"))), F.lit("complained")))
    delivered = F.transform("b.delivery.recipients", lambda r: one("delivery", r, no, no))
    events = F.when(what == "Bounce", bounced).when(what == "Complaint", complained).when(what == "Delivery", delivered)
    out = rows.select(F.col("MessageId").alias("notification_id"), F.col("Timestamp").try_cast("timestamp").alias("created_at"),
                      F.col("b.mail.messageId").alias("message_id"), F.inline(events))
    out = out.withColumn("email", normalize_email("address")).drop("address")
    return out.filter(F.col("email").isNotNull() | (F.col("type") == "delivery"))


def feedback_suppressions(events: DataFrame) -> DataFrame:
    return events.filter("reason IS NOT NULL").select("email", "reason", "detail", "created_at")


def delivery_update(recipients: DataFrame, events: DataFrame) -> DataFrame:
    """Later bounces and complaints update the recipient row of the same message."""
    status = F.when(F.col("type") == "bounce", "bounced").when(F.col("type") == "complaint", "complained")
    last = (events.withColumn("_s", status).filter("_s IS NOT NULL AND message_id IS NOT NULL")
            .groupBy("message_id").agg(F.max_by(F.struct("_s", "detail"), F.struct("created_at", "notification_id")).alias("e")))
    rows = recipients.join(last, "message_id", "left")
    return rows.withColumns({"status": F.coalesce("e._s", "status"), "detail": F.coalesce("e.detail", "detail")}).drop("e")


def send_rollup(recipients: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return recipients.groupBy("issue_id").agg(F.count(F.lit(1)).alias("recipients"), n("sent").alias("sent"),
                                              n("failed").alias("failed"), n("skipped").alias("skipped"))


def issue_list(issues: DataFrame, n: int) -> DataFrame:
    return issues.orderBy(F.desc("id")).limit(n).select(
        "id", F.coalesce("issue_no", "id").alias("issue_no"), "subject", "status", eastern_minute("created_at").alias("created_at"),
        F.size(F.coalesce("post_ids", F.expr("array()").cast("array<bigint>"))).alias("posts"))


def issue_outcomes(recipients: DataFrame, issue_id: int | None = None) -> DataFrame:
    rows = recipients if issue_id is None else recipients.filter(F.col("issue_id") == issue_id)
    return rows.orderBy("issue_id", "id").select("issue_id", "id", "email", "status", F.coalesce("detail", F.lit("")).alias("detail"),
                                                 eastern_minute("at").alias("at"))


def events_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def latest_events(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("id")).limit(n).select("id", eastern_minute("created_at").alias("at"), "email", "type", "detail")


def signup_outcomes(signups: DataFrame, contacts: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Outcome of each sign-up: invalid, suppressed, updated (status never changes) or added as pending."""
    rows = _known(signups.withColumn("email", normalize_email("address")), contacts, suppressions)
    stop = F.col("stopped") | F.coalesce(F.col("contact_status").isin(*SUPPRESSED), F.lit(False))
    outcome = (F.when(F.col("email").isNull(), "invalid").when(stop, "suppressed")
               .when(F.col("contact_id").isNotNull(), "updated").otherwise("added"))
    return rows.withColumn("outcome", outcome).drop("stopped")


def token_events(events: DataFrame, contacts: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Confirm and unsubscribe links to status changes: a confirmation of a suppressed address is
    ignored. ``events(token, kind, at, seq)``; returns changes in the shape of ``apply_status``."""
    c = contacts.select(F.col("id").alias("contact_id"), "email", F.col("status").alias("_now"), "confirm_token", "unsub_token")
    confirm = (events.filter("kind = 'confirm'").join(c, F.col("token") == F.col("confirm_token"))
               .join(suppressions.select("email"), "email", "left_anti").filter("_now <> 'subscribed'")
               .select("contact_id", "at", "seq", F.lit("subscribed").alias("status"), F.lit("confirmed opt-in").alias("event")))
    leave = (events.filter("kind = 'unsubscribe'").join(c, F.col("token") == F.col("unsub_token"))
             .select("contact_id", "at", "seq", F.lit("unsubscribed").alias("status"), F.lit("unsubscribed via link").alias("event")))
    return confirm.unionByName(leave)


def next_issue(issues: DataFrame) -> DataFrame:
    return issues.agg((F.coalesce(F.max("issue_no"), F.lit(0)) + 1).alias("issue_no"))
