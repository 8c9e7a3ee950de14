"""Ordered helpers against plain Python, with one group holding most rows."""
import random
import statistics

from pyspark.sql import functions as F

from headway.functions.ordered import exact_median, previous_row, running_total, standings


def skewed(spark, n=400):
    rnd = random.Random(3)
    rows = [(i, None if rnd.random() < 0.1 else ("hot" if rnd.random() < 0.7 else rnd.choice("abc")), rnd.randint(0, 30)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, g string, v int")


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


def test_running_total(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["position"] for r in running_total(df, ["g"], [F.desc("v"), F.asc("id")]).collect()}
    for members in by_group(rows).values():
        for place, r in enumerate(sorted(members, key=lambda r: (-r[2], r[0])), 1):
            assert got[r[0]] == place


def test_standings(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["place"] for r in standings(df, ["g"], "v").collect()}
    for members in by_group(rows).values():
        for r in members:
            assert got[r[0]] == 1 + sum(o[2] > r[2] for o in members)


def test_exact_median(spark):
    rows, df = skewed(spark)
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v").collect()}
    assert got == {g: statistics.median(r[2] for r in m) for g, m in by_group(rows).items()}


def test_previous_row(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["before"] for r in previous_row(df, ["g"], [F.asc("v"), F.asc("id")], {"before": "id"}).collect()}
    for members in by_group(rows).values():
        line = sorted(members, key=lambda r: (r[2], r[0]))
        for prev, r in zip([None, *line], line):
            assert got[r[0]] == (prev[0] if prev else None)
