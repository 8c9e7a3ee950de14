"""Tables stored in buckets: merges touch the buckets of their batch only and survive a job that ends half way."""

import os

from pyspark.sql import functions as F

from headway.operators import contacts, registry
from headway.session import scratch
from headway.sources import buckets
from headway.streaming import jobs

SCHEMA = "email string, name string, status string, source string, tags array<string>"


def _contacts(spark, n):
    return spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("@x.org")).alias("email"), F.lit("old").alias("name"),
                                 F.lit("subscribed").alias("status"), F.lit("form").alias("source"), F.array(F.lit("a")).alias("tags"))


def _batch(spark, emails):
    return spark.createDataFrame([(e, "new", ["b"]) for e in emails], "email string, name string, tags array<string>")


def _files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("bucket=")}


def _rows(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=repr)


def test_a_small_batch_touches_its_buckets_only(spark):
    have, path = _contacts(spark, 1000), scratch(spark, "contacts")
    buckets.store(have, path, F.col("email"))
    before = _files(path.removeprefix("file:"))
    batch = _batch(spark, [f"c{i}@x.org" for i in range(6)] + [f"n{i}@x.org" for i in range(4)])  # one row in a hundred
    numbers = contacts.merge_stored_contacts(path, have.schema, batch, "csv")
    after = _files(path.removeprefix("file:"))
    assert 0 < len(numbers) <= 10 and {d for d in after if after[d] != before.get(d)} == {f"bucket={n}" for n in numbers}
    assert _rows(buckets.read(spark, path, have.schema)) == _rows(contacts.merge_contacts(have, batch, "csv").select(*have.columns))
    plan = buckets.read(spark, path, have.schema, numbers)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_repeated_merge_and_an_empty_batch_change_nothing(spark):
    have, path = _contacts(spark, 50), scratch(spark, "contacts")
    buckets.store(have, path, F.col("email"))
    batch = _batch(spark, ["c1@x.org", "n@x.org"])
    contacts.merge_stored_contacts(path, have.schema, batch, "csv")
    once = _rows(buckets.read(spark, path, have.schema))
    contacts.merge_stored_contacts(path, have.schema, batch, "csv")
    assert contacts.merge_stored_contacts(path, have.schema, batch.limit(0), "csv") == []
    assert _rows(buckets.read(spark, path, have.schema)) == once and len(once) == 51


def test_a_merge_that_ended_half_way_is_put_in_place(spark):
    have, path = _contacts(spark, 200), scratch(spark, "contacts")
    batch = _batch(spark, ["c1@x.org"])
    [number] = buckets.touched(batch, F.col("email"), 8)
    mine = buckets.bucket_of(F.col("email"), 8) == number
    # the state after the new bucket was written beside the table and the old one taken away
    buckets.store(have.filter(~mine), path, F.col("email"), 8)
    new = contacts.merge_contacts(have.filter(mine), batch, "csv").select(*have.columns).withColumn("bucket", F.lit(number))
    new.write.partitionBy("bucket").parquet(f"{path}-redo")
    contacts.merge_stored_contacts(path, have.schema, _batch(spark, ["c2@x.org"]), "csv", count=8)
    names = {r.email: r.name for r in buckets.read(spark, path, have.schema).collect()}
    assert len(names) == 200 and names["c1@x.org"] == names["c2@x.org"] == "new" and names["c3@x.org"] == "old"
    # written only in part: it doesn't count
    new.limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("bucket").parquet(f"{path}-redo")
    assert not buckets.recover(spark, path, have.schema)
    assert buckets.read(spark, path, have.schema).count() == 200


def test_agencies_by_lower_cased_name(spark):
    kind = "name string, state string, ntd_id string, cig_sponsor string, website string, newsroom string, procurement_url string, aliases array<string>, search_enabled boolean"
    old = spark.createDataFrame([(f"Agency {i}", "OH", None, None, "w", None, None, ["x"], True) for i in range(100)], kind)
    new = spark.createDataFrame([("AGENCY 7", "MI", "1", "", "v", None, None, None, None), ("Other", "IL", None, None, None, None, None, ["o"], None)], kind)
    path = scratch(spark, "agencies")
    buckets.store(old, path, F.lower("name"))
    assert len(registry.merge_stored_agencies(path, old.schema, new)) <= 2
    assert _rows(buckets.read(spark, path, old.schema)) == _rows(registry.merge_agencies(new, old).select(*old.columns))


def test_known_links_are_looked_up_in_touched_buckets(spark):
    """Later batches open the folders of their own buckets; nulls and blanks are no links."""
    landed, sink, check = (scratch(spark, x) for x in ("feed", "links", "check"))
    kind = "link string, at timestamp"
    first = spark.range(300).select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("link"), F.timestamp_seconds("id").alias("at"))
    known = spark.createDataFrame([("l0",)], "link string")
    run = lambda: jobs.stream_intake(spark.readStream.schema(kind).parquet(landed), known, sink, check)
    first.write.parquet(landed)
    run()
    again = spark.createDataFrame([("l5", None), ("new", None), (None, None), ("", None), ("l0", None), ("new", None)], kind)
    again.write.mode("append").parquet(landed)
    run()
    got = [r.link for r in jobs.intake_table(spark, sink).collect()]
    assert len(got) == len(set(got)) == 300 and set(got) == {f"l{i}" for i in range(1, 300)} | {"new"}
    numbers = buckets.touched(again, F.col("link"))
    plan = jobs.batches(spark, sink, jobs.LINKS, before=1).filter(F.col("bucket").isin(numbers))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
