"""Benchmark decontamination on a positional inverted index.

Corpus postings (document, position, term) are stored for the terms by which test phrases are looked up: the two
rarest of each phrase, by their counts in the whole corpus. Each posting, moved back by the term's offset in the
phrase, is a possible start; the lists of the two terms are intersected on it. What is left is compared word by word
with the documents, so matches are exact. Only built-in functions are used.

Defined results: null texts have no words; an item of fewer words than the window is one window, one of none has
none; null item_ids name no item; documents that agree in id and text give the same row as often as they occur; empty
tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import counts_of, small, texts
from headway.session import settle

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is no word character: ASCII other than digits and letters (letters are lower-cased before).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), lambda w: w != "")


def phrases(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (phrase, terms) and which item has them (phrase, item_id)."""
    rows = items.filter(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = rows.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1))),
                                                       lambda i: F.slice("w", i, window))).alias("terms"))
    named = settle(cut.select("item_id", "terms", F.sha2(F.array_join("terms", " "), 256).alias("phrase")).distinct())
    return named.select("phrase", "terms").distinct(), named.select("phrase", "item_id").distinct()


def occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, h, term, position) of the wanted terms (one column, ``term``) in the corpus."""
    rows = texts(docs).select("doc_id", "h", F.posexplode(words(F.col("text"))).alias("position", "term"))
    return rows.join(small(wanted), "term", "left_semi")


def lookups(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Per phrase the rarest and second rarest term with their offsets; phrases with an absent term are left out.

    A phrase that has one distinct term only looks it up twice.
    """
    places = table.select("phrase", F.posexplode("terms").alias("offset", "term"))
    corpus = texts(docs).select(F.explode(words(F.col("text"))).alias("term"))
    known = settle(counts_of(corpus, places.select("term").distinct()))
    rated = places.join(known, "term", "left").select("phrase", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset").alias("x"))
    # at most ``window`` rows per phrase
    best = rated.groupBy("phrase").agg(F.array_sort(F.collect_list("x")).alias("x"))
    first = F.col("x")[0]
    second = F.coalesce(F.get(F.filter("x", lambda y: y["term"] != first["term"]), F.lit(0)), first)
    return (best.filter(first["n"] > 0).select("phrase", first.alias("a"), second.alias("b"))
            .select("phrase", F.col("a.term").alias("term"), F.col("a.offset").alias("offset"),
                    F.col("b.term").alias("term_b"), F.col("b.offset").alias("offset_b")))


def candidates(docs: DataFrame, table: DataFrame, slop: int = 0) -> DataFrame:
    """(doc_id, h, start, phrase) where the two rarest terms of a phrase stand at their offsets.

    With ``slop`` the second term may stand that many words off its place (proximity matches).
    """
    find = settle(lookups(docs, table))
    terms = find.select("term").unionByName(find.select(F.col("term_b").alias("term"))).distinct()
    index = settle(occurrences(docs, terms))
    first = (index.join(small(find), "term").withColumn("start", F.col("position") - F.col("offset"))
             .filter(F.col("start") >= 0).select("doc_id", "h", "start", "phrase", F.col("term_b").alias("term"), (F.col("start") + F.col("offset_b")).alias("position")))
    if slop:
        first = first.withColumn("position", F.explode(F.sequence(F.col("position") - slop, F.col("position") + slop)))
    keys = ("doc_id", "h", "term", "position")
    found = _semi(first, index, keys).select("doc_id", "h", "start", "phrase")
    return found.distinct() if slop else found


def _semi(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of ``left`` whose keys, null-safe, occur in ``right``."""
    other = right.select(*[F.col(k).alias(f"{k}_r") for k in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_r"))
    return left.join(other, cond, "left_semi")


def exact(docs: DataFrame, found: DataFrame, table: DataFrame) -> DataFrame:
    """Candidates whose every word agrees: (doc_id, h, hits), hits being (start, n, phrase) of the document."""
    held = settle(found)
    near = held.join(small(table), "phrase").groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "phrase", "terms")).alias("c"))
    rows = texts(docs)
    key = held.select(F.col("doc_id").alias("d"), F.col("h").alias("g")).distinct()
    rows = rows.join(small(key), rows["doc_id"].eqNullSafe(F.col("d")) & (rows["h"] == F.col("g")), "left_semi").dropDuplicates(["doc_id", "h"])
    both = rows.join(near.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "c"), rows["doc_id"].eqNullSafe(F.col("d")) & (rows["h"] == F.col("g")))
    split = both.select("doc_id", "h", "c", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    hits = F.filter("c", lambda c: (c["start"] + F.size(c["terms"]) <= F.col("n")) & (F.slice("w", c["start"] + 1, F.size(c["terms"])) == c["terms"]))
    short = F.transform(hits, lambda c: F.struct(c["start"].alias("start"), F.size(c["terms"]).alias("n"), c["phrase"].alias("phrase")))
    return split.filter(F.col("n") > 0).select("doc_id", "h", short.alias("hits")).filter(F.size("hits") > 0)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with exact matches: doc_id, h, n_hit (words inside a match), items (their ids as strings, sorted)."""
    table, owners = phrases(items, window)
    table = settle(table)
    hits = settle(exact(docs, candidates(docs, table), table))
    covered = F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))
    counted = hits.select("doc_id", "h", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    # (document, phrase) rows meet owners on the phrase; a pair counts once
    pairs = (hits.select("doc_id", "h", F.explode(F.array_distinct(F.transform("hits", lambda x: x["phrase"]))).alias("phrase"))
             .join(small(owners), "phrase").select("doc_id", "h", F.col("item_id").cast("string").alias("item")).distinct())
    listed = pairs.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("item")).alias("items"))
    other = listed.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "items")
    return counted.join(other, counted["doc_id"].eqNullSafe(F.col("d")) & (counted["h"] == F.col("g"))).select("doc_id", "h", "n_hit", "items")


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document with its counts and verdict."""
    hit = matches(docs, items, window).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "n_hit", "items")
    every = texts(docs).select("doc_id", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = every.join(hit, every["doc_id"].eqNullSafe(F.col("d")) & (every["h"] == F.col("g")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def proximity(docs: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """Where the two rarest terms of each query (item_id, text) stand within ``slop`` words of their distance in it.

    doc_id, item_id, start; queries are taken whole.
    """
    table, owners = phrases(queries, 1_000_000)
    found = candidates(docs, settle(table), slop)
    return found.join(owners, "phrase").select("doc_id", "item_id", "start")


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without a match, with their columns."""
    hit = matches(docs, items, window).select("doc_id", "h")
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    text_hash = F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    return packed.join(hit, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (text_hash == F.col("h")), "left_anti").select("row.*")
