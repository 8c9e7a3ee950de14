import pytest
from pyspark.sql import functions as F

from headway.functions import columns as c
from headway.operators import archive, duplicates, grants, images, linkage, registry, review


def col(spark, values, expr, type_="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r["x"] for r in rows.select("i", expr("v").alias("x")).orderBy("i").collect()]


def test_lenient_numbers(spark):
    assert col(spark, ["$1,234", " 5.5 ", "N/A", "", None, "1.5d", "NaN", "inf", "1e3", "-2"], c.to_number) == [
        1234.0, 5.5, None, None, None, None, None, None, 1000.0, -2.0]


def test_money(spark):
    assert col(spark, ["$1,050.5", "TBD", "n/a", "", None, "10-20", "-5", "abc"], c.clean_money) == [
        1050.5, None, None, None, None, None, None, None]


def test_rounding_is_binary(spark):
    assert col(spark, [1.005, 2.5, -2.5], lambda v: c.round_to(v, 2), "double") == [1.0, 2.5, -2.5]
    assert col(spark, [2.5, -2.5], c.round_half_up, "double") == [3, -2]


def test_slugs(value):
    assert value(c.slug(F.col("n"), F.col("i")), n="  Métro & Bus -- Co.", i="7") == "métro-bus-co-7"
    assert value(c.slug(F.col("n"), F.col("i")), n="!!!", i="7") == "agency-7"
    assert value(c.post_slug(F.col("n"), F.col("i")), n="--Été & more--", i=3) == "t-more-3"


def test_project_names(spark):
    assert col(spark, ["The Veirs Mill Road Bus Rapid Transit (Phase 1) Project", "A & B program", None], c.norm_name) == [
        "veirs mill road brt", "a and b", ""]


def test_email(spark):
    assert col(spark, ['Jane <Jane@X.org>', " 'a@b.co' ", "no-at.org", "a b@c.org", None, "x@" + "y" * 260 + ".org"], c.normalize_email) == [
        "jane@x.org", "a@b.co", None, None, None, None]


def test_dates_in_names(spark):
    assert col(spark, ["dash-2026-09-11.pdf", "03-14-2026 x", "09-01-2025-2026-03-01", "none"], c.date_from_name) == [
        "2026-09-11", "2026-03-14", "2026-03-01", None]
    assert col(spark, ["TX-X-AR27-04-07-26.pdf", "CA-AR26-11-19-25.pdf", "x-13-40-2026", None], c.date_in_name_last) == [
        "2026-04-07", "2025-11-19", None, None]


@pytest.mark.parametrize("base, link, want", [
    ("https://a.org/x/y.html?q=1", "/img/p.jpg", "https://a.org/img/p.jpg"), ("https://a.org/x/y.html", "p.jpg", "https://a.org/x/p.jpg"),
    ("https://a.org", "p.jpg", "https://a.org/p.jpg"), ("https://a.org/x/", "//cdn.b/z.png", "https://cdn.b/z.png"),
    ("https://a.org/x/y/", "../z.png", "https://a.org/x/z.png"), ("https://a.org/x", "http://b.c/d", "http://b.c/d")])
def test_absolute_urls(value, base, link, want):
    assert value(c.absolute_url(F.col("b"), F.col("l")), b=base, l=link) == want


def test_states_in_place(spark):
    got = col(spark, ["Tacoma, Washington", "Portland, Oregon and Vancouver, Washington", "Washington, DC", None], linkage.states_in)
    assert got == [["WA"], ["OR", "WA"], ["DC"], []]


def test_canonical_modes(spark):
    assert col(spark, ["Bus Rapid Transit", "Light Rail and BRT", "Lightrail", None], linkage.canon_mode) == ["BRT", "BRT", None, None]


def test_grant_dates(spark):
    got = col(spark, ["Spring 2027", "August 2026", "2028", "TBD", None], grants.grant_when)
    assert got[0] == pytest.approx(2027.3) and got[1] == pytest.approx(2026.625) and got[2:] == [2028.5, None, None]


def test_search_text(value):
    assert tuple(value(registry.split_search(F.col("t")), t="transit funding when:21d")) == ("transit funding", 21)
    assert tuple(value(registry.split_search(F.col("t")), t=" transit ")) == ("transit", 30)


def test_overlap_examples(value):
    a, b = "FTA awards $200M to Austin Light Rail Phase 1", "Austin Light Rail Phase 1 wins $200 million federal grant from FTA"
    s = value(duplicates.overlap(c.content_words(F.col("a")), c.content_words(F.col("b"))), a=a, b=b)
    assert s == pytest.approx(5 / 7)
    x, y = "Seattle voters approve transit sales tax", "Denver voters approve transit sales tax"
    assert value(duplicates.overlap(c.content_words(F.col("a")), c.content_words(F.col("b"))), a=x, b=y) == pytest.approx(0.8)


def test_name_scores(value):
    score = lambda a, b: value(images.name_score(F.col("a"), F.col("b")), a=a, b=b)
    assert score("MBTA", "Massachusetts Bay Transportation Authority") == 1.0
    assert score("City of Madison", "Madison County Transit") == 0.0
    assert score("Massachusetts Bay Transportation Authority", "Massachusetts Department of Transportation") == 0.0
    assert score("Santa Clara Valley Line", "santa clara valley") == pytest.approx(3 / 4)


def test_agency_names(spark):
    rows = spark.createDataFrame([(["MTA", " the t ", "Bay Area transit agencies", "Nobody"], "MD"), (["MTA", "mta"], "NY"),
                                  (["Regional Transportation District"], "TX"), (["Regional Transportation District"], None)],
                                 "agencies array<string>, state string")
    got = [r["x"] for r in rows.select(review.normalize_names("agencies", "state").alias("x")).collect()]
    assert got == [["Maryland Transit Administration", "MBTA", "Nobody"], ["MTA (New York)"], ["Regional Transportation District"], ["RTD (Denver)"]]


def test_facet_arrays(spark):
    rows = spark.createDataFrame([([" a ", "", "a", None, "b" * 130, *[f"t{i}" for i in range(20)]],)], "v array<string>")
    assert rows.select(review.clean_array("v").alias("x")).first()["x"] == ["a", "b" * 130, *[f"t{i}" for i in range(20)]]


def test_canonical_text_and_diff(spark):
    text = "Ａ  title\n\n Page 2 of 9\n12\nbody\ttext "
    rows = spark.createDataFrame([(text, "A title\nbody text\nnew line")], "a string, b string")
    assert rows.select(archive.canonical_text("a").alias("a")).first()["a"] == "A title\nbody text"
