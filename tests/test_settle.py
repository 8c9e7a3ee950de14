"""What settled tables and groups leave on disk."""

import random
import time

from pyspark.sql import functions as F

from headway import session
from headway.llm import chosen_path
from headway.operators import duplicates


def shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (held.apply(i).getName() for i in range(held.size())) if f.startswith("shuffle_") and f.endswith(".data")}


def test_settled_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 50).alias("k")).count().repartition(3)
    rows = session.settle(counts)
    for _ in range(50):  # Spark removes them beside the query
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and rows.count() == counts.count() == 50
    assert spark.conf.get(session.CLEANUP) == "false"


def roots(edges):
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_groups_that_are_stars_already_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(duplicates, "settle", lambda df: written.append(df) or session.settle(df))
    stars = [(1, 5), (7, 1), (1, 6), (2, 3), (2, 3)]
    got = {r.id: r.group for r in duplicates.connected(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == roots(stars) and len(written) == 1


def test_further_links_join_whole_groups(spark):
    for seed in range(3):
        rng = random.Random(seed)
        first, more = ([(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (25, 15))
        frame = lambda rows: spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in rows], "a string, b string")
        groups = duplicates.connected(frame(first)).select(F.col("id").alias("cls"), F.col("group").alias("grp"))
        got = {int(r.cls): int(r.grp) for r in chosen_path.merged(groups, frame(more)).collect()}
        wanted = roots([e for e in first + more if e[0] != e[1]])
        assert got == wanted
