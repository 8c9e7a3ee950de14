"""Exact top-k search by columnar branch-and-bound.

Candidates are handled in batches laid out dimension by dimension. Scores are accumulated one block of dimensions at
a time; after each block a candidate stays only if what it has, plus the most its remaining mass could add (the norm
of the rest of the query times the norm of the rest of the candidate), still reaches the query's current k-th score.
The survivors are compacted before the next block. Components are integers, so sums are exact.

Queries are a stated set. They go to the executors in waves of bounded size; every wave reads the candidates once and
each task returns at most k rows per query.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part, nor does a row without
id; shorter vectors count as ending in zeros (an empty one scores 0); ties go to the smaller id; a repeated row is a
candidate as often as it occurs and, as a query, gives its own k; a row is no candidate for queries of its own id;
no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries sent out at once, and dimensions accumulated between two prunings.
WAVE = 4096
BLOCK = 16
#: Scores held at once while all queries share the first block.
TILE = 4_000_000


def vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float = 1024.0) -> DataFrame:
    """(id, v): usable rows with integer components floor(scale * x)."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    # floor() of a double is a long in Spark; components beyond it stay at its ends
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return rows.filter(F.col(id_col).isNotNull() & v.isNotNull() & ~odd).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def top_k(candidates: DataFrame, queries: Column, k: int = 10, wave: int = WAVE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates (id, v) for each row where ``queries`` holds."""
    asked = candidates.filter(queries)
    waves = max(1, -(-asked.count() // wave))
    out = None
    for w in range(waves):
        # hashing spreads queries evenly; equal ids share a wave
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(waves)) == w) if waves > 1 else asked
        held = rows.orderBy("id").collect()  # about ``wave`` rows
        if held:
            part = _one_wave(candidates, [r["id"] for r in held], [r["v"] for r in held], k, block)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = candidates.sparkSession.createDataFrame([], "wave_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id", "wave_row").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _one_wave(candidates: DataFrame, ids: list[int], values: list[list[int]], k: int, block: int) -> DataFrame:
    width = max(1, max(map(len, values)))
    asked = np.zeros((len(values), width), dtype=np.int64)
    for i, v in enumerate(values):
        asked[i, :len(v)] = v
    sent = candidates.sparkSession.sparkContext.broadcast((np.array(ids, dtype=np.int64), asked))  # at most one wave

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, whole = sent.value
        n_q = len(own)
        top_score = [np.empty(0, dtype=np.int64) for _ in range(n_q)]
        top_id = [np.empty(0, dtype=np.int64) for _ in range(n_q)]
        floor = np.full(n_q, -np.inf)
        exact = float(np.abs(whole).max(initial=0))
        q = whole.astype(np.float64)
        cuts = list(range(0, width, block))
        q_rest = [np.sqrt((q[:, c + block:] ** 2).sum(axis=1)) for c in cuts]

        def offer(i: int, scores: np.ndarray, found: np.ndarray) -> None:
            keep = found != own[i]
            s = np.concatenate([top_score[i], scores[keep].astype(np.int64)])
            f = np.concatenate([top_id[i], found[keep]])
            order = np.lexsort((f, -s))[:k]
            top_score[i], top_id[i] = s[order], f[order]
            if len(order) == k:
                floor[i] = s[order[-1]]

        def scan(found: np.ndarray, columns: np.ndarray) -> None:
            """columns: dimensions x candidates."""
            rest = [np.sqrt((columns[c + block:] ** 2).sum(axis=0)) for c in cuts]
            first = q[:, :block] @ columns[:block]
            alive = first + q_rest[0][:, None] * rest[0] * (1 + 1e-9) + 1e-6 >= floor[:, None]
            for i in range(n_q):
                at = np.flatnonzero(alive[i])
                score = first[i, at]
                for b in range(1, len(cuts)):
                    if not len(at):
                        break
                    c = cuts[b]
                    score = score + q[i, c:c + block] @ columns[c:c + block, at]
                    stay = score + q_rest[b][i] * rest[b][at] * (1 + 1e-9) + 1e-6 >= floor[i]
                    at, score = at[stay], score[stay]
                if len(at):
                    offer(i, np.rint(score), found[at])

        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.int64)
            sizes = np.diff(offsets)
            row = np.repeat(np.arange(len(found)), sizes)
            col = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
            inside = col < width  # beyond it every query of this wave is zero
            columns = np.zeros((width, len(found)), dtype=np.int64)
            columns[col[inside], row[inside]] = flat[inside]
            if exact * float(np.abs(columns).max(initial=0)) * width >= 2.0 ** 52:  # too large for exact doubles
                for i in range(n_q):
                    scores = [max(-2**63, min(2**63 - 1, s)) for s in (whole[i].astype(object) @ columns.astype(object)).tolist()] if len(found) else []
                    offer(i, np.array(scores, dtype=np.int64), found)
                continue
            columns = columns.astype(np.float64)
            step = max(k + 1, TILE // max(1, n_q))
            begin = min(len(found), 4 * k) if not len(top_id[0]) else 0  # a few rows set the first floor
            for a, b in [(0, begin), *((a, a + step) for a in range(begin, len(found), step))]:
                if b > a:
                    scan(found[a:b], columns[:, a:b])
        names = ["wave_row", "query_id", "vec_id", "score"]
        for i in range(0, n_q, 512):
            some = range(i, min(n_q, i + 512))
            rows = np.repeat(np.array(some), [len(top_id[j]) for j in some])
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64)), pa.array(own[rows]), pa.array(np.concatenate([top_id[j] for j in some])), pa.array(np.concatenate([top_score[j] for j in some]))], names=names)

    return candidates.mapInArrow(search, "wave_row long, query_id long, vec_id long, score long")
