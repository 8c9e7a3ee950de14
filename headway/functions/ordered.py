"""Exact ordered computations that never put a whole group into one task.

A plain window sorts one group in one task, which fails when a mode, state or source holds a third of
all rows. Here the rows are range-partitioned on (group, order) so a big group spans many slices, the
sliced rows are written once, each slice works on its own rows, and one small table with a row per
(group, slice) carries totals or last rows from slice to slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.session import settle


def _sliced(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows range-partitioned on (group, order) and written once, each with the number of its slice.

    The number of slices follows spark.sql.shuffle.partitions; adaptive execution merges neighbouring
    slices when there is little data, which keeps their order.
    """
    spread = df.repartitionByRange(*[F.col(g) for g in group], *order)
    return settle(spread.withColumn("_slice", F.spark_partition_id()))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                  weight: Column | None = None, name: str = "position") -> DataFrame:
    """Inclusive running sum of ``weight`` (1 when omitted, i.e. a row number) per group.

    ``order`` must be a total order for a repeatable row number.
    """
    weight = F.lit(1) if weight is None else weight
    rows = _sliced(df.withColumn("_w", weight.cast("bigint")), group, order)
    local = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # one row per (group, slice): at most shuffle-partition many per group
    per_slice = rows.groupBy(*group, "_slice").agg(F.sum("_w").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slice.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    placed = rows.withColumn("_run", F.sum("_w").over(local))
    cond = placed["_slice"] == carry["_s"]
    for i, g in enumerate(group):
        cond = cond & placed[g].eqNullSafe(carry[f"_g{i}"])
    out = placed.join(carry, cond)
    return out.select(*df.columns, (F.col("_run") + F.col("_carry")).alias(name))


def standings(df: DataFrame, group: Sequence[str], value: str, name: str = "place") -> DataFrame:
    """1 + number of rows of the group with a larger ``value``; ties share a place."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    run = running_total(counts, group, [F.col(value).desc()], F.col("_n"), "_run")
    place = run.select(*[F.col(g).alias(f"_p{i}") for i, g in enumerate(group)],
                       F.col(value).alias("_v"), (F.col("_run") - F.col("_n") + 1).alias(name))
    cond = df[value].eqNullSafe(place["_v"])
    for i, g in enumerate(group):
        cond = cond & df[g].eqNullSafe(place[f"_p{i}"])
    return df.join(place, cond, "left").select(*df.columns, name)


def exact_median(df: DataFrame, group: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group from value counts, without holding a group's values in one task."""
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*group, value)
              .agg(F.count(F.lit(1)).alias("_n")))
    run = running_total(counts, group, [F.col(value).asc()], F.col("_n"), "_run")
    sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_size"))
    low = F.floor((F.col("_size") + 1) / 2)
    high = F.floor((F.col("_size") + 2) / 2)

    def covers(pos: Column) -> Column:
        return ((pos > F.col("_run") - F.col("_n")) & (pos <= F.col("_run"))).cast("int")

    right = sizes.select(*[F.col(g).alias(f"_z{i}") for i, g in enumerate(group)], "_size")
    cond = F.lit(True)
    for i, g in enumerate(group):
        cond = cond & run[g].eqNullSafe(right[f"_z{i}"])
    return (run.join(right, cond)
            .withColumn("_hits", covers(low) + covers(high))
            .filter(F.col("_hits") > 0)
            .groupBy(*group)
            .agg((F.sum(F.col(value) * F.col("_hits")) / 2).alias(name)))


def previous_row(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                 columns: dict[str, str]) -> DataFrame:
    """Add, for each ``{new: source}``, the source value of the group's preceding row (NULL if none)."""
    payload = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    local = Window.partitionBy(*group, "_slice").orderBy(*order)
    marked = (_sliced(df, group, order)
              .withColumn("_own", payload)
              .withColumn("_prev", F.lag("_own").over(local))
              .withColumn("_first", F.row_number().over(local) == 1)
              .withColumn("_last", F.lead(F.lit(1)).over(local).isNull()))
    # the last row of each (group, slice) is handed to the group's next slice
    hand = marked.filter("_last").select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_s"),
        F.lag("_own").over(Window.partitionBy(*group).orderBy("_slice")).alias("_handed"))
    cond = (marked["_slice"] == hand["_s"]) & marked["_first"]
    for i, g in enumerate(group):
        cond = cond & marked[g].eqNullSafe(hand[f"_g{i}"])
    joined = marked.join(hand, cond, "left").withColumn("_prev", F.coalesce("_prev", "_handed"))
    return joined.select(*df.columns, *[F.col("_prev")[new].alias(new) for new in columns])
