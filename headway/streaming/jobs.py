"""Streams over landed events that lose nothing: late, repeated and replayed rows all count, once.

Each micro-batch folds its rows and writes the fold to a folder of its own, so a replay overwrites itself
and nothing written before is touched. A table is read by folding the folders, which is possible because
every fold is one that can be applied again: sums, first reasons, latest states. Rows are never dropped
for being late. ``compact`` folds old folders into one.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from headway.operators import contacts, posts, registry, review
from headway.session import settle
from headway.sources.buckets import BUCKETS, bucket_of

def run_now(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what has landed, batch by batch, and stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start()
    query.awaitTermination()
    return query


def write_batch(rows: DataFrame, path: str, number: int, by: str | None = None) -> None:
    """Write what a batch adds; a replay of the batch overwrites it."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/batch={number}")


def batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Everything written so far, or by earlier batches; empty when nothing was."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    kind = spark.createDataFrame([], schema + ", batch long").schema
    try:
        rows = spark.read.schema(kind).parquet(path)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], kind)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return rows.select(*names)


# ---- counts -------------------------------------------------------------------------------------

USAGE = "day date, event_type string, n bigint"


def usage_partial(events: DataFrame, at: str = "ts", kind: str = "event_type") -> DataFrame:
    return (events.groupBy(F.to_date(F.col(at).cast("timestamp")).alias("day"), F.col(kind).alias("event_type"))
            .agg(F.count(F.lit(1)).alias("n")))


def stream_usage(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Events per day and type, every landed event counted whenever it comes."""
    return run_now(events, checkpoint, lambda batch, number: write_batch(usage_partial(batch), path, number))


def usage_table(spark: SparkSession, path: str) -> DataFrame:
    return batches(spark, path, USAGE).groupBy("day", "event_type").agg(F.sum("n").alias("n"))


RATES = "slot bigint, user_id bigint, asks bigint"
SLOT = 300_000_000  # microseconds of a slot
HOUR = 12  # slots


def stream_ask_rates(events: DataFrame, path: str, checkpoint: str, visitor: str = "user_id", at: str = "ts") -> StreamingQuery:
    """Asks per visitor in sliding hours, every five minutes; open windows are readable at once.

    What is written are the asks of each slot of five minutes, counted since 1970; ``ask_rate_table`` makes hours of them.
    """
    def each(batch: DataFrame, number: int) -> None:
        micros = F.unix_micros(F.col(at).cast("timestamp"))
        slot = F.expr(f"(_at - pmod(_at, {SLOT}L)) div {SLOT}L")
        rows = batch.select(micros.alias("_at"), F.col(visitor).cast("bigint").alias("user_id")).filter("_at IS NOT NULL")
        write_batch(rows.groupBy(slot.alias("slot"), "user_id").agg(F.count(F.lit(1)).alias("asks")), path, number)
    return run_now(events, checkpoint, each)


def ask_rate_table(spark: SparkSession, path: str) -> DataFrame:
    """(from_time, to_time, user_id, asks) of all hours with asks: each comes from its first slot, which sees the eleven after it."""
    slots = batches(spark, path, RATES).groupBy("user_id", "slot").agg(F.sum("asks").alias("asks"))
    line = Window.partitionBy("user_id").orderBy("slot")
    seen = slots.select("user_id", "slot", F.lag("slot").over(line).alias("before"),
                        F.collect_list(F.struct("slot", "asks")).over(line.rangeBetween(0, HOUR - 1)).alias("ahead"))
    first = F.greatest(F.col("slot") - (HOUR - 1), F.col("before") + 1)
    hours = seen.select("user_id", "ahead", F.explode(F.sequence(first, F.col("slot"))).alias("first"))
    inside = F.filter("ahead", lambda s: s["slot"] < F.col("first") + HOUR)
    return hours.select(F.timestamp_micros(F.col("first") * SLOT).alias("from_time"), F.timestamp_micros((F.col("first") + HOUR) * SLOT).alias("to_time"),
                        "user_id", F.aggregate(inside, F.lit(0).cast("bigint"), lambda n, s: n + s["asks"]).alias("asks"))


# ---- states -------------------------------------------------------------------------------------

STOPS = "email string, reason string, detail string, created_at timestamp"


def stream_feedback(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Feedback notifications into the do-not-mail list; the first reason of an address counts."""
    def each(batch: DataFrame, number: int) -> None:
        empty = batch.sparkSession.createDataFrame([], STOPS)
        write_batch(contacts.suppress(empty, contacts.feedback_suppressions(contacts.feedback_events(batch))), path, number)
    return run_now(messages, checkpoint, each)


def stop_table(spark: SparkSession, path: str) -> DataFrame:
    return contacts.suppress(spark.createDataFrame([], STOPS), batches(spark, path, STOPS))


FETCHES = "source_id bigint, at timestamp, error string, entries int, new int, queued int"


def telling_fetches(fetches: DataFrame) -> DataFrame:
    """The fetches that can still matter for a source's health: its latest success, the latest ones that
    told ``new`` and ``queued``, its latest failure, and all failures since the last success here."""
    ok = F.col("error").isNull()
    last = fetches.groupBy("source_id").agg(
        F.max(F.when(ok, F.col("at"))).alias("ok_at"), F.max(F.when(~ok, F.col("at"))).alias("bad_at"),
        F.max(F.when(ok & F.col("new").isNotNull(), F.col("at"))).alias("new_at"),
        F.max(F.when(ok & F.col("queued").isNotNull(), F.col("at"))).alias("queued_at"))
    rows = fetches.join(last, "source_id")
    keep = F.when(ok, (F.col("at") == F.col("ok_at")) | F.coalesce(F.col("at") == F.col("new_at"), F.lit(False))
                  | F.coalesce(F.col("at") == F.col("queued_at"), F.lit(False))).otherwise(
        F.col("ok_at").isNull() | (F.col("at") > F.col("ok_at")) | (F.col("at") == F.col("bad_at")))
    return rows.filter(keep).select(*fetches.columns)


def stream_health(fetches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Source health from fetch events in any order."""
    columns = [part.strip().split(" ")[0] for part in FETCHES.split(",")]
    return run_now(fetches, checkpoint, lambda batch, number: write_batch(telling_fetches(batch.select(*columns)), path, number))


def health_table(spark: SparkSession, path: str) -> DataFrame:
    return registry.health_fold(batches(spark, path, FETCHES))


def compact(spark: SparkSession, path: str, into: str, schema: str, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Write the folded table as one batch of a new path, from which a later job goes on."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    write_batch(fold(batches(spark, path, schema)).select(*names), into, -1)


# ---- work ---------------------------------------------------------------------------------------

LINKS = "link string, at timestamp, bucket int"


def stream_intake(feed: DataFrame, known: DataFrame, sink: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """New items by link (``feed`` has ``link`` and ``at``): never one that is known or was written before.

    What was written is looked up in the touched buckets of earlier batches, however long ago: buckets are folders, and
    their numbers are known before the plan is made, so no other bucket is opened.
    """
    bucket = bucket_of(F.col("link"), buckets)

    def each(batch: DataFrame, number: int) -> None:
        once = (batch.filter("coalesce(link, '') <> ''").groupBy("link").agg(F.min(F.col("at").cast("timestamp")).alias("at"))
                .withColumn("bucket", bucket))
        once = settle(once)
        numbers = [r["bucket"] for r in once.select("bucket").distinct().collect()]  # at most ``buckets`` of them
        earlier = batches(batch.sparkSession, sink, LINKS, before=number).filter(F.col("bucket").isin(numbers)).select("bucket", "link")
        fresh = once.join(known.select("link").distinct(), "link", "left_anti").join(earlier, ["bucket", "link"], "left_anti")
        write_batch(fresh, sink, number, by="bucket")
    return run_now(feed, checkpoint, each)


def intake_table(spark: SparkSession, sink: str) -> DataFrame:
    return batches(spark, sink, LINKS).select("link", "at")


STEPS = "id bigint, step string"


def stream_queue_tick(items: DataFrame, now: datetime, days: int, path: str, checkpoint: str) -> StreamingQuery:
    """Item versions (``id``, ``version`` and the queue's columns) as they land; each tick says what is due
    to publish and what goes stale among the latest versions of all items landed so far, once per item."""
    fields = items.schema

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        write_batch(batch, f"{path}/items", number)
        landed = spark.read.schema(fields).parquet(f"{path}/items").select(*fields.names)
        rest = [c for c in fields.names if c != "id"]
        latest = landed.groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("id", "r.*")
        due = posts.due_items(latest, now).select("id", F.lit("publish").alias("step"))
        stale = latest.filter(review.stale(now, days)).select("id", F.lit("expire").alias("step"))
        said = batches(spark, f"{path}/steps", STEPS, before=number)
        write_batch(due.unionByName(stale).join(said, ["id", "step"], "left_anti"), f"{path}/steps", number)
    return run_now(items, checkpoint, each)


def step_table(spark: SparkSession, path: str) -> DataFrame:
    return batches(spark, f"{path}/steps", STEPS)
