"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table may be broadcast; a larger one is joined by shuffling both sides.
BROADCAST_ROWS = 200_000

#: Rows with whole texts that a task turns into Python objects at once.
ROWS_AT_ONCE = 256


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows; a slice shares its batch's memory."""
    pa.set_memory_pool(pa.system_memory_pool())  # workers are used again: what they free goes back to the system
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h): null texts are empty, h is a hash of the text.

    Rows that agree in doc_id and text are the same document for every operator here, so (doc_id, h) is the
    key on which results meet documents again. It does not depend on files, tasks or retries.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (then both sides are shuffled)."""
    return F.broadcast(df) if is_small(df, rows) else df


def counts_of(words: DataFrame, wanted: DataFrame, name: str = "n") -> DataFrame:
    """(term, count) of the wanted terms among ``words(term)``.

    Few wanted terms are broadcast, so other words go before they are counted; many meet the counts of all words
    instead, which are folded before they move.
    """
    count = F.count(F.lit(1)).alias(name)
    if is_small(wanted):
        return words.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(count)
    return words.groupBy("term").agg(count).join(wanted, "term", "left_semi")
