"""The domain tables, derived from the driver tables (see SURVEY 7.4).

Nothing here is sampled or cut: every derived table is a projection, join or aggregate of whole
driver tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.operators import mart
from headway.session import scratch, settle

# stand-in labels; ECONOMY is left out so that one code falls through to itself
LABELS = {"STANDARD": "Bus", "MEDIUM": "Light Rail", "PROMO": "Heavy Rail", "LARGE": "Commuter Rail",
          "SMALL": "Streetcar"}
# fixed values: consumer price index for the years of the driver tables; 2001 is missing on purpose
INDEX = {1994: 148.2, 1995: 152.4, 1996: 156.9, 1997: 160.5, 1998: 163.0, 1999: 166.6, 2000: 172.2}
PILLARS = ("Funding", "Procurement", "People", "Policy")


def specs():
    """The curated rankings with floors scaled to the driver tables."""
    return [(s, m, k, o, f / 10_000) for s, m, k, o, f in mart.RANKINGS]


class Tables:
    """Driver tables by attribute, and the domain tables built from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                    "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)

    # ---- annual mart ----------------------------------------------------------------------------

    @cached_property
    def places(self) -> DataFrame:
        """Agency names and places: supplier with its nation and region (25 and 5 rows)."""
        return (self.supplier
                .join(F.broadcast(self.nation), F.col("s_nationkey") == F.col("n_nationkey"))
                .join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))
                .select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_suppkey").cast("string").alias("ntd_id"),
                        F.col("s_name").alias("agency"), F.col("r_name").alias("city"), F.col("n_name").alias("state")))

    @cached_property
    def facts(self) -> DataFrame:
        """Line items reduced to (supplier, mode, year, type of service) before any name is joined."""
        rows = self.lineitem.join(self.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
        return rows.groupBy("l_suppkey", F.upper("p_type").alias("mode_code"),
                            F.year("l_shipdate").alias("report_year"), F.col("l_returnflag").alias("tos")).agg(
            F.sum("l_quantity").alias("upt"),
            F.sum(F.round("l_extendedprice")).alias("operating_expense"),
            F.sum(F.round(F.col("l_extendedprice") * F.col("l_discount"))).alias("fares"),
            F.sum(F.col("l_quantity") * F.col("l_linenumber")).alias("passenger_miles"),
            F.sum(F.col("l_linenumber").cast("double")).alias("vehicle_revenue_hours"))

    @cached_property
    def long_facts(self) -> DataFrame:
        """The same facts in the field/value layout, all text, with one unknown measure."""
        wide = self.facts.join(self.places, "l_suppkey").select(
            "ntd_id", F.col("agency").alias("agency_name"), F.concat(F.lit(" "), "city").alias("city"), "state",
            F.lower("mode_code").alias("mode"), F.col("report_year").cast("string").alias("report_year"), "tos",
            F.col("upt").alias("Unlinked Passenger Trips"),
            F.col("operating_expense").alias("Operating Expenses"), F.col("fares").alias("Fares"),
            F.col("passenger_miles").alias("Passenger Miles Traveled"),
            F.col("vehicle_revenue_hours").alias("Vehicle Revenue Hours"),
            F.col("upt").alias("Unknown Measure"))
        fields = [c for c in wide.columns if c[0].isupper()]
        tall = wide.unpivot([c for c in wide.columns if c not in fields], fields, "field", "number")
        return tall.withColumn("value", F.concat(F.lit("$"), F.format_number("number", 0))).drop("number")

    @cached_property
    def base_history(self) -> DataFrame:
        return mart.roll_up_history(self.facts.join(self.places, "l_suppkey").drop("l_suppkey"), LABELS)

    @cached_property
    def index(self) -> DataFrame:
        return mart.index_frame(self.spark, INDEX)

    @cached_property
    def cpi(self) -> DataFrame:
        years = self.lineitem.select(F.year("l_shipdate").alias("report_year"))
        return mart.deflator(years, self.index)

    @cached_property
    def history(self) -> DataFrame:
        return mart.with_real(mart.with_ratios(self.base_history), self.cpi)

    @cached_property
    def stored(self) -> DataFrame:
        """The history written once, as the mart is; anything that reads it more than once starts here."""
        return settle(self.history)

    @cached_property
    def service(self) -> DataFrame:
        return mart.latest_service(self.stored)

    @cached_property
    def ranked(self) -> DataFrame:
        return mart.rankings(self.service, mart.spec_frame(self.spark, specs()), top=40, least=5)

    # ---- grant snapshots ------------------------------------------------------------------------

    @cached_property
    def dashboard(self) -> DataFrame:
        """Dashboard rows as parsed text: one per order, project = customer, snapshot = quarter."""
        people = (self.customer.join(F.broadcast(self.nation), F.col("c_nationkey") == F.col("n_nationkey"))
                  .join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))
                  .select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_nationkey", "r_name"))
        key = F.col("o_orderkey")
        code = F.concat(F.lit("N"), F.char(65 + F.col("n_nationkey")))
        of = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (n % len(v) + 1).cast("int"))
        money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
        return self.orders.join(people, "o_custkey").select(
            key.alias("line_no"), F.trunc("o_orderdate", "quarter").alias("snapshot_date"),
            F.concat(F.lit("Project "), F.col("o_custkey").cast("string")).alias("project_name"),
            F.when(F.col("o_custkey") % 13 != 0, F.col("c_mktsegment")).alias("sponsor"), F.col("r_name").alias("city"),
            F.when(F.col("o_custkey") % 7 == 0, F.concat(code, F.lit("-ZZ"))).otherwise(code).alias("state"),
            of(F.col("o_custkey"), "BRT", "Light Rail", None, "Streetcar").alias("mode"),
            of(F.ascii("o_orderstatus"), "PD", "Const", "Eng", "Unknown").alias("phase"),
            F.col("o_orderpriority").alias("rating"), money(F.col("o_totalprice")).alias("cost"),
            F.when(key % 9 == 0, "TBD").otherwise(money(F.floor(F.col("o_totalprice") / 2))).alias("cig_request"),
            F.concat((key % 50 + 20).cast("string"), F.lit("%")).alias("cig_share"),
            of(key, "Spring 2027", "August 2026", "2028", "TBD", "early 2027").alias("est_grant"),
            of(key, "Committed", "In Progress").alias("noncig_status"), of(key, "TBD", "N/A", None).alias("excl_brt"))

    @cached_property
    def snapshots(self) -> DataFrame:
        """Stored snapshot rows: valid, money typed, first row of each project and quarter."""
        from headway.operators import grants
        rows = grants.with_money(grants.valid_rows(self.dashboard))
        return grants.dedupe_first(rows, ["snapshot_date", *grants.KEY], "line_no")

    @cached_property
    def snapshot_store(self) -> DataFrame:
        """The snapshots written once, a folder per date; what reads single dates or reads twice starts here."""
        from headway.sources import writers
        path = scratch(self.spark, "snapshot-store")
        writers.overwrite_snapshot(self.snapshots, path)
        return self.spark.read.parquet(path)

    @cached_property
    def project_pages(self) -> DataFrame:
        """One page link per project, with the file it points to."""
        k = F.col("c_custkey")
        name = F.concat(F.lit("Project "), k.cast("string"))
        return self.customer.select(
            name.alias("project_name"), F.when(k % 13 != 0, F.col("c_mktsegment")).otherwise("").alias("sponsor"),
            F.concat(F.lit("S"), (k % 5).cast("string")).alias("state"), name.alias("listing_name"), F.lit("listed").alias("listing_stage"),
            F.when(k % 3 != 0, F.concat(F.lit("https://grants.example.org/p/"), k.cast("string"))).alias("profile_url"),
            F.when(k % 4 != 0, F.concat(F.lit("https://grants.example.org/files/Project%20"), k.cast("string"),
                                        F.lit(".pdf"))).alias("pdf_url"))

    @cached_property
    def versions(self) -> DataFrame:
        """Archived documents: every conversation turn is a captured version of its project's profile."""
        k = F.col("conv_id")
        rows = self.conversations.join(
            self.customer.select(F.col("c_custkey").alias("conv_id"), "c_mktsegment"), "conv_id", "left")
        return rows.select(
            (k * 100 + F.col("turn")).alias("id"), F.concat(F.lit("Project "), k.cast("string")).alias("project_name"),
            F.when(k % 13 != 0, F.coalesce("c_mktsegment", F.lit("NONE"))).otherwise("").alias("sponsor"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 86400).alias("captured_at"),
            (F.col("turn") > 0).alias("changed"),
            F.when(k % 2 == 0, F.concat(F.lit("Project "), k.cast("string"), F.lit(".pdf"))).alias("file_name"),
            F.lit(None).cast("string").alias("pdf_url"), "text")

    # ---- review queue ---------------------------------------------------------------------------

    @cached_property
    def items(self) -> DataFrame:
        """Review items: every document, its whole text as headline, scored where labels exist."""
        k = F.col("doc_id")
        of = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
        none = F.expr("array()").cast("array<string>")
        start = F.lit("2024-01-01").cast("date")
        hours = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 3600)
        rows = self.documents.join(self.labels, "doc_id", "left")
        scored = F.col("quality").isNotNull()
        return rows.select(
            k.alias("id"), of(*PILLARS, "Data").alias("pillar"), F.col("text").alias("headline"),
            F.concat(F.lit("Report from "), "source").alias("summary"), F.col("source").alias("source_name"),
            F.when(k % 11 == 0, None).when(k % 6 == 0, F.concat(F.lit("https://news.google.com/rss/"), k.cast("string")))
            .otherwise(F.concat(F.lit("https://"), "source", F.lit(".example.com/"), k.cast("string"))).alias("source_url"),
            F.when(k % 17 != 0, F.date_add(start, (k % 60).cast("int"))).alias("published"),
            F.when(k % 10 == 0, F.date_add(start, (k % 45 + 31).cast("int"))).alias("deadline"),
            of("low", "med", "high").alias("relevance"), of("pending", "approved", "published", "skipped").alias("status"),
            F.when(k % 9 != 0, F.array("source", F.concat(F.lit("Agency "), (k % 7).cast("string")))).otherwise(none).alias("agencies"),
            F.when(k % 3 == 0, F.array(F.lit("Bus"))).when(k % 3 == 1, F.array(F.lit("Light Rail"), F.lit("Bus"))).otherwise(none).alias("mode"),
            F.when(k % 8 == 0, F.array(F.lit("CIG New Starts"))).when(k % 8 == 1, F.array(F.lit("RAISE"))).otherwise(none).alias("programs"),
            F.array("lang", F.concat(F.lit("t"), (k % 12).cast("string"))).alias("tags"),
            F.when(k % 5 != 0, F.upper("lang")).alias("state"), hours(k % 100).alias("collected_at"),
            F.when(scored, F.col("quality") * 60 + (k % 40).cast("int")).alias("score"),
            F.when(scored, F.when(k % 4 == 0, "skip").when(k % 4 == 1, "hold").otherwise("publish")).alias("action"),
            F.array_compact(F.array(F.when(F.col("toxic") == 1, "likely_duplicate"), F.when(k % 6 == 0, "lead_candidate"))).alias("flags"),
            F.when(k % 3 == 0, k % 50).alias("dupe_group"), F.when(scored, hours(k % 30)).alias("recommended_at"),
            F.when(k % 3 == 0, hours(k % 1000)).alias("publish_at"),
            F.when(k % 2 == 0, F.concat(F.lit("https://img.example.com/"), k.cast("string"), F.lit(".jpg"))).alias("image_url"),
            F.when(k % 14 == 0, "none").when(k % 7 == 3, "manual").alias("pick_image_source"),
            F.when(k % 7 == 3, k % 20).alias("pick_image_library_id"))

    @cached_property
    def headlines(self) -> DataFrame:
        """Id, headline and state of the review items, for what needs no labels: texts don't travel to meet them."""
        return self.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("headline"),
                                     F.when(F.col("doc_id") % 5 != 0, F.upper("lang")).alias("state"))

    @cached_property
    def titles(self) -> DataFrame:
        """Published titles: every benchmark passage."""
        return self.benchmark.select("item_id", F.col("text").alias("title"))

    @cached_property
    def sources(self) -> DataFrame:
        """Source registry: one row per document source, with hand edits on some."""
        n = F.regexp_extract("source", r"(\d+)$", 1).cast("bigint")
        rows = self.documents.select("source").distinct()
        day = F.lit("2024-02-01").cast("timestamp")
        return rows.select(
            n.alias("id"), F.col("source").alias("name"), F.concat(F.lit("https://"), "source", F.lit(".example.com/feed")).alias("url"),
            F.lit("News").alias("pillar"), F.when(n % 3 == 0, "Search").otherwise("Feed").alias("type"),
            F.when(n % 7 == 6, "Manual").otherwise("RSS").alias("method"), F.lit("Med").alias("trust"), F.lit("").alias("notes"),
            F.lit(None).cast("string").alias("query"), F.lit(None).cast("int").alias("search_days"), (n % 6 != 5).alias("enabled"),
            F.when(n % 5 == 4, "user").otherwise("registry").alias("origin"), F.when(n % 4 == 3, day).alias("edited_at"),
            F.when(n % 9 == 8, day).alias("deleted_at"))

    @cached_property
    def fetches(self) -> DataFrame:
        """Fetch events: every usage event read as one fetch of the source named after its user."""
        bad = F.col("event_type") == "error"
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select(
            F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("at"),
            F.when(bad, F.concat(F.lit("HTTP "), F.col("event_id").cast("string"))).alias("error"),
            F.when(~bad, k).alias("entries"), F.when(~bad & (k % 2 == 0), k + 1).alias("new"),
            F.when(~bad & (k % 3 == 0), k + 2).alias("queued"))

    # ---- posts and pictures ---------------------------------------------------------------------

    @cached_property
    def posts(self) -> DataFrame:
        """Posts: every web page, titled by its heading."""
        k = F.col("page_id")
        of = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
        title = F.regexp_extract("html", "(?is)<h1>(.*?)</h1>", 1)
        lang = F.upper(F.regexp_extract("html", 'lang="([a-z]+)"', 1))
        none = F.expr("array()").cast("array<string>")
        hour = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 3600)
        return self.pages.select(
            k.alias("id"), F.concat(F.lit("p-"), k.cast("string")).alias("slug"), of(*PILLARS, "Data").alias("pillar"),
            title.alias("title"), F.concat(F.lit(" "), title, F.lit("\n\nSource: x - "), "url").alias("body"),
            F.when(k % 6 == 5, "draft").otherwise("published").alias("status"),
            F.when(k % 23 != 0, hour((k * 37 % 500))).alias("publish_at"), (k * 2).alias("item_id"),
            F.when(k % 4 == 0, "Google News: transit").when(k % 4 == 1, "  ").otherwise(F.concat(F.lit("Paper "), (k % 9).cast("string"))).alias("source_name"),
            F.when(k % 5 == 0, F.concat(F.lit("https://news.google.com/a/"), k.cast("string"))).otherwise(F.col("url")).alias("source_url"),
            F.when(k % 3 != 0, F.array(F.concat(F.lit("Brand#"), (k % 30).cast("string")), F.concat(F.lit("Brand#"), (k % 7).cast("string")))).otherwise(none).alias("agencies"),
            F.when(k % 2 == 0, F.array(F.lit("Bus"))).otherwise(none).alias("mode"),
            F.when(k % 8 == 0, F.array(F.lit("RAISE"))).when(k % 8 == 1, F.array(F.lit("TIFIA"))).otherwise(none).alias("programs"),
            F.array(F.concat(F.lit("t"), (k % 4).cast("string"))).alias("tags"), F.when(k % 5 != 1, lang).alias("state"),
            (k % 10 == 0).alias("featured"), F.when(k % 20 == 0, hour(k % 600)).alias("featured_until"),
            F.lit(None).cast("string").alias("sponsor"), F.when(k % 4 == 0, F.concat(F.lit("https://i.example/"), k.cast("string"))).alias("image_url"),
            F.when(k % 12 == 1, "none").alias("image_source"), F.when(k % 4 == 2, k % 50).alias("image_library_id"))

    @cached_property
    def assets(self) -> DataFrame:
        """Image library: every part is one asset of its brand."""
        k = F.col("p_partkey")
        day = F.timestamp_seconds(F.lit(1704067200) + F.col("p_size") * 86400)
        return self.part.select(
            k.alias("id"), F.when(k % 2 == 0, "logo").otherwise("stock").alias("kind"), F.col("p_brand").alias("agency"),
            F.split("p_name", " ").alias("topic_tags"), F.when(k % 9 == 0, F.concat(F.lit("/files/"), k.cast("string"))).alias("file_path"),
            F.when(k % 9 != 0, F.concat(F.lit("https://cdn.example/"), k.cast("string"), F.lit(".svg"))).alias("url"),
            F.lit(640).alias("width"), F.lit(480).alias("height"), F.when(k % 31 == 0, "").otherwise(
                F.element_at(F.array(F.lit("wikimedia"), F.lit("unsplash"), F.lit("flickr")), (k % 3 + 1).cast("int"))).alias("source"),
            F.concat(F.lit("https://src.example/"), k.cast("string")).alias("source_url"),
            F.element_at(F.array(F.lit("CC BY 4.0"), F.lit("Non-free fair use"), F.lit("Unknown"), F.lit("Public domain, trademark")), (k % 4 + 1).cast("int")).alias("license"),
            F.when(k % 37 == 0, "  ").otherwise("Someone").alias("attribution"), day.alias("fetched_at"),
            F.when(F.col("p_size") % 3 == 0, "approved").when(F.col("p_size") % 3 == 1, "candidate").otherwise("rejected").alias("status"),
            F.concat(F.element_at(F.array(F.lit("free"), F.lit("non-free"), F.lit("odd")), (k % 3 + 1).cast("int")), F.lit(" | note")).alias("notes"),
            F.when(k % 5 != 0, day).alias("reviewed_at"))

    @cached_property
    def brands(self) -> DataFrame:
        """Agencies of the image library: the distinct brands, upper-cased names, some with a logo."""
        n = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("bigint")
        return self.part.select("p_brand").distinct().select(
            F.upper("p_brand").alias("name"), F.lit("XX").alias("state"), F.when(n % 3 == 0, n * 2).alias("logo_image_id"))

    @cached_property
    def stories(self) -> DataFrame:
        """Posts as stories to illustrate: their named agencies, and the words of parts as topics."""
        k = F.col("id")
        word = lambda n: F.element_at(F.array(*[F.lit(w) for w in ("red", "blue", "small", "ring", "bolt", "widget")]), (n % 6 + 1).cast("int"))
        return self.posts.select(
            k.alias("story_id"), "image_url", "image_source",
            "agencies",
            F.when(k % 7 == 0, F.expr("array()").cast("array<string>")).otherwise(F.array(word(k), word(k + 2))).alias("tags"))

    # ---- contacts -------------------------------------------------------------------------------

    @cached_property
    def contacts(self) -> DataFrame:
        """Contacts: every customer."""
        k = F.col("c_custkey")
        ks = k.cast("string")
        day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
        return self.customer.select(
            k.alias("id"), F.concat(F.lit("customer."), ks, F.lit("@example.org")).alias("email"), F.when(k % 4 != 0, F.col("c_name")).alias("name"),
            F.element_at(F.array(*[F.lit(s) for s in ("pending", "subscribed", "subscribed", "unsubscribed", "bounced")]), (k % 5 + 1).cast("int")).alias("status"),
            F.when(k % 3 != 0, "web form").alias("source"), F.array(F.lower("c_mktsegment"), F.concat(F.lit("r"), (k % 3).cast("string"))).alias("tags"),
            F.concat(F.lit("c"), ks).alias("confirm_token"), F.concat(F.lit("u"), ks).alias("unsub_token"), day(k % 200).alias("created_at"),
            F.when(k % 5 == 1, day(k % 200 + 1)).alias("confirmed_at"), F.when(k % 5 == 3, day(k % 200 + 2)).alias("unsubscribed_at"),
            F.lit(None).cast("timestamp").alias("last_event_at"), F.lit(None).cast("string").alias("last_event"),
            F.element_at(F.array(F.lit("free"), F.lit("Pro"), F.lit("unheard"), F.lit(None)), (k % 4 + 1).cast("int")).alias("plan"))

    @cached_property
    def suppressions(self) -> DataFrame:
        """Do-not-mail list: customers with a negative balance."""
        k = F.col("c_custkey").cast("string")
        return self.customer.filter("c_acctbal < 0").select(
            F.concat(F.lit("customer."), k, F.lit("@example.org")).alias("email"), F.lit("bounced").alias("reason"),
            F.lit(None).cast("string").alias("detail"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))

    @cached_property
    def feedback(self) -> DataFrame:
        """Mail feedback notifications: every event is one message about its user's address."""
        k, u = F.col("event_id"), F.col("user_id").cast("string")
        address = F.concat(F.lit('Someone <Customer.'), u, F.lit("@EXAMPLE.org>"))
        head = F.concat(F.lit('{"mail":{"messageId":"m'), k.cast("string"), F.lit('"},'))
        bounce = F.concat(head, F.lit('"notificationType":"Bounce","bounce":{"bounceType":"'), F.when(k % 2 == 0, "Permanent").otherwise("Transient"),
                          F.lit('","bounceSubType":"General","bouncedRecipients":[{"emailAddress":"'), address, F.lit('","diagnosticCode":"550"},{"emailAddress":"broken"}]}}'))
        complaint = F.concat(head, F.lit('"notificationType":"Complaint","complaint":{"complainedRecipients":[{"emailAddress":"'), address, F.lit('"}]}}'))
        delivery = F.concat(head, F.lit('"eventType":"Delivery","delivery":{"recipients":["'), address, F.lit('"]}}'))
        body = F.when(F.col("event_type") == "error", bounce).when(F.col("event_type") == "purchase", complaint).when(F.col("event_type") == "view", delivery).otherwise("{broken")
        return self.events.select(
            F.when(F.col("event_type") == "signup", "SubscriptionConfirmation").otherwise("Notification").alias("Type"),
            F.concat(F.lit("n"), k.cast("string")).alias("MessageId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Timestamp"), body.alias("Message"))

    @cached_property
    def recipients(self) -> DataFrame:
        """Per-recipient send results: every event is one send, its day the issue."""
        k = F.col("event_id")
        return self.events.select(
            k.alias("id"), F.dayofmonth("ts").cast("bigint").alias("issue_id"), F.concat(F.lit("customer."), F.col("user_id").cast("string"), F.lit("@example.org")).alias("email"),
            F.when(k % 10 == 0, "failed").when(k % 15 == 1, "skipped").otherwise("sent").alias("status"), F.concat(F.lit("m"), k.cast("string")).alias("message_id"),
            F.lit(None).cast("string").alias("detail"), F.col("ts").cast("timestamp").alias("at"))

    @cached_property
    def usage(self) -> DataFrame:
        """Usage log: every event, with a surface in its meta and a question text from a benchmark passage."""
        k = F.col("event_id")
        kinds = F.array(*[F.lit(x) for x in ("ask_ntd", "ask_cig", "card_export", "data_export", "subscribe")])
        rows = self.events.join(self.benchmark.select(F.col("item_id").alias("_b"), "text"), (k % 40) == F.col("_b"), "left")
        words = F.array(*[F.lit(x) for x in ("Bus ridership since 2019", "compare fare recovery", "rail cost per trip", "CIG new starts funding")])
        return rows.select(
            k.alias("id"), F.element_at(kinds, (k % 5 + 1).cast("int")).alias("event_type"), F.col("user_id").alias("contact_id"),
            F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
            F.when(k % 4 != 0, F.concat(F.element_at(words, (k % 4 + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))).alias("query_text"),
            F.when(k % 3 != 0, F.concat(F.lit("shape"), (k % 3).cast("string"))).alias("result_shape"),
            F.when(k % 7 == 0, '{"surface": "public"}').when(k % 7 == 1, '{"surface": "internal"}').otherwise(F.col("props")).alias("meta"),
            F.col("ts").cast("timestamp").alias("created_at"))
