"""URL filter rules as a sort-merge range join.

A host is keyed by its labels in reverse ("com.example.www."), so a host and all its subdomains are one interval of
keys, and a path prefix is an interval of paths. Nested prefixes give nested intervals: a sweep over sorted keys
keeps the open ones on a stack. Keys are cut into slices of near equal size; each slice starts with the prefixes that
are open at its first key, found by an equality join of that key's own prefixes.

Defined results: a null url, or one without "://", has empty host and path and no rule; the rule with the most
characters wins, of equally long ones that with the longer host, then block; repeated pages are judged each; no rules
give every page the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.session import settle

#: Rows of the sample from which slice borders are read, per slice.
PER_SLICE = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "/", 1))
    return F.coalesce(F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path: from the host's end up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def nested(points: DataFrame, prefixes: DataFrame, slices: int | None = None) -> DataFrame:
    """(key, prefix) for every distinct ``points.key`` and every distinct ``prefixes.prefix`` it starts with."""
    spark = points.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # kind: -1 open at a slice's start, 0 a prefix, 1 a point; at equal keys a prefix comes before the points it holds
    rows = settle(points.select("key", F.lit(1).alias("kind")).distinct().unionByName(prefixes.select(F.col("prefix").alias("key"), F.lit(0).alias("kind")).distinct()))
    n = rows.count()
    share = min(1.0, PER_SLICE * slices / max(1, n))
    sample = sorted(r["key"] for r in rows.filter(F.rand(7) < share).select("key").collect())  # about PER_SLICE rows a slice
    borders = sorted({sample[i * len(sample) // slices] for i in range(1, slices)}) if sample else []

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bisect

        for b in batches:
            yield b.assign(slice=[bisect.bisect_right(borders, x) for x in b["key"]])

    placed = rows.mapInPandas(numbered, "key string, kind int, slice int")
    edge = spark.createDataFrame([(i + 1, x) for i, x in enumerate(borders)], "slice int, border string")  # one row a slice
    heads = edge.select("slice", F.explode(F.expr("transform(sequence(0, length(border) - 1), i -> substring(border, 1, i))")).alias("prefix"))
    carried = heads.join(prefixes.select("prefix").distinct(), "prefix").select(F.col("prefix").alias("key"), F.lit(-1).alias("kind"), "slice")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[str] = []
        now = None
        for b in batches:
            keys, held = [], []
            for key, kind, part in zip(b["key"], b["kind"], b["slice"]):
                if part != now:
                    stack, now = [], part
                while stack and not key.startswith(stack[-1]):
                    stack.pop()
                if kind < 1:
                    if not stack or stack[-1] != key:
                        stack.append(key)
                else:
                    keys += [key] * len(stack)
                    held += stack
            yield pd.DataFrame({"key": keys, "prefix": held}, dtype=object)

    order = [F.col("slice"), F.when(F.col("kind") < 0, F.length("key")).asc_nulls_last(), F.col("key"), F.col("kind")]
    return placed.unionByName(carried).repartition(slices, "slice").sortWithinPartitions(*order).mapInPandas(sweep, "key string, prefix string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url parts and the winning rule of every page.

    ``rules`` has host, path and verdict. Two range joins: distinct page hosts against rule hosts give the ruled
    ancestors of each host, and distinct (ruled host, path) against full rules give the rules that fit.
    """
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule = rules.select(host_key(F.lower("host")).alias("host_prefix"), "host", "path", "verdict")
    full = rule.select(F.concat("host_prefix", "path").alias("prefix"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict")
    # one row per rule text: of two verdicts for one rule, block wins
    full = full.groupBy("prefix", "rule", "host_length").agg(F.max("verdict").alias("verdict"))

    seen = settle(parts.filter(F.col("host") != "").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")))
    hosts = seen.select("host").distinct().select("host", host_key(F.col("host")).alias("key"))
    ancestors = nested(hosts, rule.select(F.col("host_prefix").alias("prefix"))).join(hosts, "key").select("host", F.col("prefix").alias("ruled"))
    probes = settle(seen.join(ancestors, "host").select("host", "path", F.concat("ruled", "path").alias("key")))
    fits = nested(probes.select("key"), full.select("prefix")).join(full, "prefix")
    # the deepest rule per probe is a small aggregate before the wide join
    best = fits.groupBy("key").agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", "verdict", "rule")).alias("best"))
    winner = probes.join(best, "key").groupBy("host", "path").agg(F.max("best").alias("best"))
    out = parts.join(winner, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
