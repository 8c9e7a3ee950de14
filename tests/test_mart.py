import pytest
from pyspark.sql import functions as F

from headway.operators import mart
from headway.plans.agency_pages import build_mart
from headway.sources import readers, writers

SAMPLE = """NTD ID,Agency,City,State,Mode,Type of Service,Unlinked Passenger Trips,Operating Expenses
1,Alpha,Aville,NY,HR,DO,"1,000",$4000
1,Alpha,Aville,NY,hr ,PT,500,2000
1,Alpha,Aville,NY,ZZ,DO,10,N/A
2,"Beta, Inc",Bville,,MB,DO,0,100
2,"Beta, Inc",Bville,,MB,PT,1.5d,
"""


def test_flat_file_to_mart(spark, tmp_path):
    (tmp_path / "flat.csv").write_text(SAMPLE)
    long = mart.melt(readers.read_flat(spark, str(tmp_path / "flat.csv")), year=2024)
    history, service, cpi = build_mart(long, mart.index_frame(spark))
    rows = {(r["ntd_id"], r["mode_code"]): r for r in history.collect()}
    hr = rows["1", "HR"]
    assert (hr["mode"], hr["upt"], hr["operating_expense"], hr["cost_per_rider"]) == ("Heavy Rail", 1500.0, 6000.0, 4.0)
    assert hr["fares"] is None and hr["fare_recovery"] is None and hr["real_dollar_year"] == 2024 and hr["cpi_factor"] == 1.0
    assert rows["1", "ZZ"]["mode"] == "ZZ" and rows["1", "ZZ"]["operating_expense"] is None
    assert rows["2", "MB"]["upt"] == 0 and rows["2", "MB"]["cost_per_rider"] is None and rows["2", "MB"]["state"] == ""
    assert [(r["ntd_id"], r["mode_code"]) for r in service.collect()] == [("1", "HR")]
    assert cpi.count() == len(mart.PRICE_INDEX)


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError):
        mart.melt(spark.createDataFrame([("a", "b")], "Agency string, Mode string"))


def test_unpivot_then_pivot_keeps_totals(spark):
    rows = [("1", "A", "c", "s", "MB", "2020", f, v) for f, v in (("Fares", "1"), ("Fares", "2"), ("Unlinked Passenger Trips", "7"), ("Odd", "9"), ("Fares", None))]
    df = spark.createDataFrame(rows, "ntd_id string, agency_name string, city string, state string, mode string, report_year string, field string, value string")
    got = mart.pivot_history(mart.clean_keys(mart.long_keys(df))).collect()
    assert len(got) == 1 and got[0]["fares"] == 3.0 and got[0]["upt"] == 7.0 and got[0]["operating_expense"] is None


def test_deflator_empty_without_known_year(spark):
    years = spark.createDataFrame([(1900,), (None,)], "report_year int")
    assert mart.deflator(years, mart.index_frame(spark)).count() == 0
    assert [r[0] for r in mart.missing_index_years(years, mart.index_frame(spark)).collect()] == [1900]


def test_state_rank_counts_itself_when_totals_differ(spark):
    rows = [("1", "NY", "A", 10.0, 5.0), ("1", "NY", "B", 9.0, 0.0), ("2", "NY", "A", 12.0, 1.0)]
    service = spark.createDataFrame([(i, "n" + i, "c", s, m, u, e) for i, s, m, u, e in rows],
                                    "ntd_id string, agency string, city string, state string, mode string, upt double, operating_expense double")
    got = {r["ntd_id"]: r["state_rank_by_upt"] for r in mart.state_rank(service).collect()}
    # agency 1 operates 10 trips; two all-row totals (its own 19, and 12) are above that
    assert got == {"1": 3, "2": 2}


def test_rankings_drop_short_lists(spark):
    rows = [(str(i), f"A{i}", "c", "s", "Bus", float(10 - i), 100.0, 5.0 + i, 0.1) for i in range(4)]
    service = spark.createDataFrame(rows, "ntd_id string, agency string, city string, state string, mode string, upt double, operating_expense double, cost_per_rider double, fare_recovery double")
    specs = mart.spec_frame(spark, [("x", "Bus", "upt", "desc", 0)])
    assert mart.rankings(service, specs, top=40, least=5).count() == 0
    assert [r["ntd_id"] for r in mart.rankings(service, specs, top=40, least=3).orderBy("rank").collect()] == ["0", "1", "2", "3"]


def test_snapshot_overwrite_keeps_others(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-02-01", 2)], "snapshot_date string, v int").withColumn("snapshot_date", F.to_date("snapshot_date"))
    path = str(tmp_path / "t")
    writers.overwrite_snapshot(df, path)
    writers.overwrite_snapshot(df.filter("v = 2").withColumn("v", F.lit(9)), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 9]
