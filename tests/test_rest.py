from datetime import datetime

import pytest
from pyspark.sql import functions as F

from headway.operators import adhoc, archive, contacts, images, pages, registry, usage
from headway.session import scratch
from headway.streaming import jobs

LISTING = """<table><tr><th>Year</th></tr><tr><td>1</td></tr></table>
<TABLE class=x><tr><th>State</th><th>City</th><th>Project&nbsp;Name</th><th>Stage of Development</th><th>Project Profile</th></tr>
<tr><td>AZ</td><td>Tucson</td><td>Stone <b>Avenue</b> &amp; More</td><td>PD</td><td><a href="/p?a=1&amp;b=2">x</a></td></tr>
<tr><td>short</td></tr></TABLE>"""


def test_listing_table(spark):
    rows = archive.html_table_rows(spark.createDataFrame([(1, LISTING)], "page_id int, html string")).collect()
    assert [(r["state"], r["city"], r["name"], r["stage"], r["profile_url"]) for r in rows] == [
        ("AZ", "Tucson", "Stone Avenue & More", "PD", "https://www.transit.dot.gov/p?a=1&b=2")]


def test_page_text(value):
    html = "<html><nav>menu</nav><article>\n<p>One&amp;two</p><script>x</script><div>Three</div>\n\n\n\n<p>four</p></article>tail</html>"
    assert value(pages.page_text(F.col("h")), h=html) == "One&two\nThree\n\nfour"
    assert value(pages.page_text(F.col("h")), h="<nav>m</nav><p>a</p>b") == "a\nb"


def test_picture_candidates(spark):
    html = ("""<meta property='og:image' content='/a.jpg'><meta name="twitter:image" content="/a.jpg"><img src="logo.png"><img src="s.jpg" srcset="m.jpg 320w, l.jpg 640w">"""
            """<img src="tiny.jpg" width="20"><img data-src="lazy.jpg" alt="L"><a href="x.PDF">p</a><a href="http://o.org/y.pdf">q</a>""")
    df = spark.createDataFrame([(1, "https://n.org/d/p.html", html)], "page_id int, url string, html string")
    assert [(r["url"], r["kind"]) for r in pages.image_candidates(df).orderBy("place").collect()] == [
        ("https://n.org/a.jpg", "og:image"), ("https://n.org/d/l.jpg", "article"), ("https://n.org/d/lazy.jpg", "article")]
    assert pages.social_image(df).first()["image_url"] == "https://n.org/a.jpg"
    assert [r["document_url"] for r in pages.document_links(df, ["n.org"]).collect()] == ["https://n.org/d/x.PDF"]


def test_contact_files(spark):
    rows = [("f1", 0, ["Tags", "E-Mail", "Full Name"]), ("f1", 1, ["x;y", "a@b.co", "Ann"]), ("f1", 2, [None, "C <c@d.org>", "two\nlines"]), ("f1", 3, ["E-Mail", "", ""]),
            ("f2", 7, ["a@b.co", "Ann", None]), ("f2", 8, ["c@d.org", None, None]), ("f2", 9, [None, None, None])]
    got = [(r["file"], r["address"], r["name"], r["tags"]) for r in contacts.parse_contacts(
        spark.createDataFrame(rows, "file string, line_no bigint, cells array<string>")).orderBy("file", "line_no").collect()]
    assert got == [("f1", "a@b.co", "Ann", ["x", "y"]), ("f1", "C <c@d.org>", "two\nlines", []), ("f2", "a@b.co", "Ann", []), ("f2", "c@d.org", "", [])]


def test_first_suppression_reason_stays(spark):
    t = lambda n: datetime(2026, 1, n)
    old = spark.createDataFrame([("a@b.co", "bounced", None, t(5))], "email string, reason string, detail string, created_at timestamp")
    new = spark.createDataFrame([("a@b.co", "complained", None, t(1)), ("c@d.co", "x", None, t(3)), ("c@d.co", "y", None, t(2))], old.schema)
    assert {r["email"]: r["reason"] for r in contacts.suppress(old, new).collect()} == {"a@b.co": "bounced", "c@d.co": "y"}


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) DELETE FROM a", "SELECT pg_sleep(5)", "SET x = 1"])
def test_snapshot_guard_refuses(sql):
    with pytest.raises(ValueError):
        adhoc.check_snapshot_sql(sql)


def test_snapshot_session_knows_one_table(spark):
    path = scratch(spark, "t")
    spark.range(500).write.parquet(path)
    spark.range(3).createOrReplaceTempView("other_view")
    assert adhoc.check_snapshot_sql("SELECT ';' AS x;") == "SELECT ';' AS x"
    assert adhoc.run_snapshot_sql(path, "SELECT * FROM cig_projects", spark).count() == 500
    for text in ("SELECT * FROM other_view", f"SELECT * FROM parquet.`{path}`"):
        with pytest.raises(Exception):
            adhoc.run_snapshot_sql(path, text, spark).count()


def test_trailing_hour(spark):
    rows = [(1, datetime(2026, 1, 1, 0, 0)), (1, datetime(2026, 1, 1, 1, 0)), (1, datetime(2026, 1, 1, 1, 0, 1)), (2, datetime(2026, 1, 1, 0, 30))]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp")
    got = [r["asks_last_hour"] for r in usage.ask_rates(df).orderBy("user_id", "ts").collect()]
    assert got == [1, 2, 2, 1]


def test_health_stream_equals_batch(spark):
    t = lambda n: datetime(2026, 1, 1, n)
    rows = [(1, t(1), None, 5, 2, 1), (1, t(2), "x", None, None, None), (1, t(3), "y", None, None, None), (2, t(1), "z", None, None, None), (1, t(4), None, 7, None, 3),
            (1, t(5), "w", None, None, None)]
    df = spark.createDataFrame(rows, "source_id bigint, at timestamp, error string, entries int, new int, queued int")
    want = {r["source_id"]: r.asDict() for r in registry.health_fold(df).collect()}
    src, path = scratch(spark, "src"), scratch(spark, "health")
    for n in (3, 6):  # two landings, two micro-batches
        df.filter(F.hour("at") <= (3 if n == 3 else 9)).filter("true" if n == 3 else "hour(at) > 3").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        jobs.stream_health(stream, path, path + "-checkpoint")
    got = {r["source_id"]: r.asDict() for r in jobs.health_table(spark, path).collect()}
    assert got == want and want[1]["fail_streak"] == 1 and want[1]["last_new"] == 2


def test_late_success_does_not_hide_later_errors(spark):
    t = lambda n: datetime(2026, 1, n)
    schema = "source_id bigint, at timestamp, error string, entries int, new int, queued int"
    first = spark.createDataFrame([(1, t(10), "HTTP 500", None, None, None)], schema)
    late = spark.createDataFrame([(1, t(5), None, 4, 1, 1)], schema)
    path = scratch(spark, "health")
    for n, rows in enumerate([first, late, late]):  # the last batch is replayed
        jobs.write_batch(jobs.telling_fetches(rows), path, min(n, 1))
    row = jobs.health_table(spark, path).first()
    assert (row["last_fetched_at"], row["fail_streak"], row["last_error"], row["last_entries"]) == (t(10), 1, "HTTP 500", 4)


def test_links_stay_known_for_ever(spark):
    src, sink = scratch(spark, "src"), scratch(spark, "links")
    schema = "link string, at timestamp"
    known = spark.createDataFrame([("k",)], "link string")
    for day, links in ((1, ["a", "k", "a"]), (20, ["a", "b"]), (3, ["c", "b", ""])):
        spark.createDataFrame([(x, datetime(2026, 1, day)) for x in links], schema).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_intake(spark.readStream.schema(schema).parquet(src), known, sink, sink + "-checkpoint")
    assert sorted(r["link"] for r in jobs.intake_table(spark, sink).collect()) == ["a", "b", "c"]


def test_a_replayed_batch_counts_once(spark):
    path = scratch(spark, "usage")
    rows = spark.createDataFrame([(datetime(2026, 1, 1), "x"), (datetime(2026, 1, 2), "x")], "ts timestamp, event_type string")
    for number in (0, 1, 1):
        jobs.write_batch(jobs.usage_partial(rows), path, number)
    assert {r["n"] for r in jobs.usage_table(spark, path).collect()} == {2}
    jobs.compact(spark, path, path + "-one", jobs.USAGE, lambda df: df.groupBy("day", "event_type").agg(F.sum("n").alias("n")))
    assert {r["n"] for r in jobs.usage_table(spark, path + "-one").collect()} == {2}


def test_ask_rates_keep_one_row_per_slot(spark):
    src, path = scratch(spark, "src"), scratch(spark, "rates")
    at = lambda h, m, s=0: datetime(2026, 1, 1, h, m, s)
    rows = [(1, at(10, 1)), (1, at(10, 4, 59)), (1, at(10, 57)), (1, at(13, 0)), (None, at(10, 0)), (2, None), (2, datetime(1969, 12, 31, 23, 59))]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp")
    for n in range(2):  # the same rows land twice
        df.coalesce(1).write.mode("append").parquet(src)
    jobs.stream_ask_rates(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), path, path + "-checkpoint")
    assert spark.read.parquet(path).count() == 2 * 5  # not an hour's twelve windows for each
    want = {(r["w"]["start"], r["w"]["end"], r["user_id"], r["n"]) for r in
            df.unionByName(df).groupBy(F.window("ts", "1 hour", "5 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = [(r["from_time"], r["to_time"], r["user_id"], r["asks"]) for r in jobs.ask_rate_table(spark, path).collect()]
    assert set(got) == want and len(got) == len(want)


def test_work_folder_of_a_cluster():
    from headway.session import own_folder
    assert own_folder("yarn", "hdfs://n/warehouse/") == "hdfs://n/warehouse/headway-checkpoints"
    assert own_folder("local[4]", "/x")
    for warehouse in ("file:/tmp/w", "/tmp/w", "spark-warehouse", ""):
        with pytest.raises(ValueError):
            own_folder("spark://host:7077", warehouse)


def test_last_answer_of_an_id_counts(spark):
    from headway.operators import triage
    reply = '[{"id": "7", "score": 10, "action": "hold"}, {"id": "7", "score": 90, "action": "publish"}]'
    rows = triage.parse_scores(spark.createDataFrame([(1, [7], reply)], "batch_id int, asked_ids array<bigint>, reply string")).collect()
    assert [(r["id"], r["score"], r["action"]) for r in rows] == [(7, 90, "publish")]


def test_uploaded_logo_fills_a_post_with_its_credit(spark):
    assets = spark.createDataFrame([(5, "logo", "RTD", None, "/f/5.svg", "approved", "CC BY", "Ann", "https://src", None, None)],
                                   "id bigint, kind string, agency string, url string, file_path string, status string, license string, attribution string, source_url string, reviewed_at timestamp, topic_tags array<string>")
    posts_ = spark.createDataFrame([(1, None, None, ["rtd"], [])], "id bigint, image_url string, image_source string, agencies array<string>, tags array<string>")
    row = images.fill_images(posts_, assets).first()
    assert (row["image_url"], row["image_source"], row["image_license"], row["image_attribution"]) == ("/api/images/file/5", "library-logo", "CC BY", "Ann")


def test_provenance_and_topics(spark, value):
    cols = "id bigint, source string, source_url string, license string, attribution string, kind string, url string, file_path string"
    rows = [(1, "manual", "u", "l", "a", "logo", "x", None), (2, "manual", " ", "l", None, "logo", "x", None), (3, "manual", "u", "l", "a", "pin", "x", None), (4, "manual", "u", "l", "a", "logo", "", "")]
    got = {r["id"]: r["reason"] for r in images.provenance_gate(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: None, 2: "missing source_url, attribution", 3: "unknown kind", 4: "no image"}
    df = spark.createDataFrame([("Board picks contractor for tram", ["Bus"], "Policy")], "t string, m array<string>, p string")
    assert df.select(images.topics_for("t", "m", "p").alias("x")).first()["x"] == ["light-rail", "procurement", "bus", "policy"]
