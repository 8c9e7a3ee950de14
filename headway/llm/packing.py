"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Texts are tokenized where they lie. Whether a set of pieces fits one sequence depends on lengths alone, and
there are at most ``capacity`` lengths, so the packing is decided on the histogram of lengths: its size is
bounded by the capacity, whatever the corpus holds. Documents themselves never leave the executors: a piece
finds its place from its length and its rank among pieces of that length.

Defined results: null text is empty; an empty text is the end mark alone (one piece of length 1); repeated rows
are packed as often as they occur; an empty table gives no rows; null doc_ids are kept.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.llm.common import texts
from headway.session import settle

CAPACITY = 2048
END = 0  #: id put after every document
PIECES = ("doc_id {id}, piece int, start long, length long, ids_crc32 long")
#: Tokenized words kept at hand in a task; the store is emptied when full. It changes speed only.
WORDS_KEPT = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, added: bool = False):
    """A function from text to the bytes of its ids (little-endian unsigned 32-bit).

    With ``added``, the contents of added tokens become their ids first, as the tokenizers library does by default;
    without, they are ordinary text.

    The vocabulary of ``path`` is byte-level BPE whose ids are merge ranks; tiktoken reads the same ranks and gives
    the same ids several times faster (a test holds it to the tokenizers library). A space before a word always
    starts a new token, so texts are cut at spaces and repeated words are looked up.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the printable stand-ins of byte-level vocabularies: visible Latin-1 bytes are themselves, others follow from 256
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    other_space = re.compile(r"[^\S \n]|[\x1c-\x1f]")
    unit = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
    known: dict[str, bytes] = {}

    def ids(s: str) -> bytes:
        return array("I", bpe.encode_ordinary(s)).tobytes()

    def learn(word: str) -> bytes:
        """Ids of a space and ``word``, which holds no space and does not start with white space."""
        if len(known) >= WORDS_KEPT:
            known.clear()
        cut = word.rfind("\n")
        if 0 < cut < len(word) - 1 and not word[cut - 1].isspace() and not word[cut + 1].isspace():
            head = known.get(word[:cut]) or learn(word[:cut])
            found = head + ids(word[cut:])
        elif len(word) > 1 and word[-1] in ",." and word[-2].isalpha():
            head = known.get(word[:-1]) or learn(word[:-1])
            found = head + ids(word[-1])
        else:
            found = ids(" " + word)
        if len(word) <= 64:
            known[word] = found
        return found

    def encode(text: str) -> bytes:
        words = text.split(" ")
        if any(not w or w[0].isspace() for w in words[1:]):
            if other_space.search(text):
                return ids(text)
            return b"".join([known.get(u[1:]) or learn(u[1:]) if u[0] == " " and len(u) > 1 and not u[1].isspace() else ids(u) for u in unit.findall(text)])
        out = [known.get(w) for w in words]
        out[0] = ids(words[0])
        if None in out:
            out = [learn(w) if b is None else b for w, b in zip(words, out)]
        return b"".join(out)

    marks = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec.get("added_tokens", [])} if added else {}
    if not marks:
        return encode
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at their surroundings are not supported")
    at_mark = re.compile("(" + "|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)) + ")")

    def encode_added(text: str) -> bytes:
        parts = at_mark.split(text)  # texts and marks in turn
        if len(parts) == 1:
            return encode(text)
        return b"".join([marks[x] if i % 2 else encode(x) if x else b"" for i, x in enumerate(parts)])

    return encode_added


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32.

    Only documents longer than ``capacity`` are cut: the first piece takes what is left over, all others are full.
    """
    path = tokenizer or default_tokenizer()
    rows = texts(docs).select("doc_id", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, added=True)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                raw = encode(text) + last
                n = len(raw) // 4
                first = n % capacity or capacity
                begins = [0, *range(first, n, capacity)]
                for k, (a, b) in enumerate(zip(begins, [*begins[1:], n])):
                    out.append((doc, k, a, b - a, zlib.crc32(raw[4 * a:4 * b])))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(cut, PIECES.format(id=id_type))


def _reduce(left: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Take out, as (times, lengths), sets that dominate every other set holding their longest piece.

    Martello and Toth: let j be a long piece and r the longest that fits beside it. If not even two of the shortest
    fit beside j, or if j and r fill the sequence, then {j, r} dominates. If at most two fit, {j, r} dominates when no
    pair weighs more than r, and {j, r, s} does when r is also the heavier one of the heaviest pair and no pair of
    pieces shorter than r and longer than s could replace it.
    """
    fixed: list[tuple[int, list[int]]] = []
    present = [int(x) for x in np.flatnonzero(left)]  # ascending
    position = len(present) - 1

    def take(times: int, lengths: list[int]) -> None:
        fixed.append((times, lengths))
        for x in lengths:
            left[x] -= times

    while position >= 0:
        j = present[position]
        if left[j] == 0:
            position -= 1
            continue
        room = capacity - j
        smallest = next((x for x in present if left[x] - (x == j) > 0), None)
        if smallest is None or smallest > room:
            take(int(left[j]), [j])
            continue
        at = bisect.bisect_right(present, room) - 1
        while at >= 0 and left[present[at]] - (present[at] == j) <= 0:
            at -= 1
        r = present[at]
        times = int(left[j] // 2 if r == j else min(left[j], left[r]))
        # the two and three smallest pieces beside j, with repetitions
        low: list[int] = []
        for x in present:
            low += [x] * min(3, int(left[x]) - (x == j))
            if len(low) >= 3:
                break
        if r == room or len(low) < 2 or low[0] + low[1] > room:
            take(max(1, times), [j, r])
            continue
        if len(low) >= 3 and sum(low[:3]) <= room:
            position -= 1  # more than two fit beside j: left to best fit
            continue
        # heaviest pair beside j, by two pointers
        best, pair = -1, None
        lo, hi = 0, at
        while lo <= hi:
            a, b = present[lo], present[hi]
            if left[a] - (a == j) <= 0:
                lo += 1
            elif left[b] - (b == j) <= 0:
                hi -= 1
            elif a + b > room or (lo == hi and left[a] - (a == j) < 2):
                hi -= 1
            else:
                if a + b > best:
                    best, pair = a + b, (b, a)
                lo += 1
        if pair is None or r >= best:
            take(max(1, times), [j, r])
        elif pair[0] == r and not any(pair[1] < x < r and left[x] > 0 for x in present[:at]):
            take(1, [j, *pair])
        else:
            position -= 1
    return fixed


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many sequences, their (length, count) contents): dominance reduction, then best fit, longest first.

    Works on the histogram: at most ``capacity`` lengths, and a few groups of like sequences per length.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] += n
    done = [(times, [(x, 1) for x in lengths]) for times, lengths in _reduce(left, capacity)]
    rooms: list[int] = []  # free places of open groups, ascending
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(room: int, times: int, content: list[tuple[int, int]]) -> None:
        if times == 0:
            return
        if room == 0:
            done.append((times, content))
            return
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append((times, content))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(rooms, length)  # the fullest sequences that still take it
            if at == len(rooms):
                each = capacity // length
                put(capacity - each * length, n // each, [(length, each)])
                if n % each:
                    put(capacity - n % each * length, 1, [(length, n % each)])
                break
            room = rooms[at]
            times, content = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = room // length
            full = min(times, n // each)
            rest = n - full * each if full < times else 0
            if full:
                put(room - each * length, full, [*content, (length, each)])
            if full < times and 0 < rest < each:
                put(room - rest * length, 1, [*content, (length, rest)])
                put(room, times - full - 1, content)
                n = 0
            else:
                put(room, times - full, content)
                n -= full * each
    done += [group for room in groups.values() for group in room]
    return done


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are written once and ranked within (length, slice), where a slice is what one task wrote: no length,
    however common, meets in one task. The table of places has a few rows per length and travels with the tasks.
    """
    cut = settle(pieces(docs, tokenizer, capacity, end).withColumn("slice", F.spark_partition_id()))
    shares = settle(cut.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")))
    histogram = {int(r["length"]): int(r["n"]) for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    base = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = shares.select("length", "slice", F.coalesce(F.sum("n").over(base), F.lit(0)).alias("before"))
    within = Window.partitionBy("slice", "length").orderBy("doc_id", "piece", "start")
    ranked = (cut.withColumn("place", F.row_number().over(within) - 1).join(before, ["length", "slice"])
              .withColumn("place", F.col("place") + F.col("before")).drop("before", "slice"))

    # runs of places: for each length in turn, pieces [from, to) go to sequences first + k // each, at offset + (k % each) * length
    used: dict[int, int] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for times, content in plan(histogram, capacity):
        offset = 0
        for length, each in content:
            runs.append((length, used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + times * each
            offset += length * each
        sequence += times
    assert used == histogram
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    span = max([1, *histogram.values()]) + 1
    assert span < 2**62 // (capacity + 1)
    starts = table[:, 0] * span + table[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy("int64"), b["place"].to_numpy("int64")
            run = table[np.searchsorted(starts, length * span + rank, side="right") - 1]
            k = rank - run[:, 1]
            yield b.drop(columns="place").assign(sequence_id=run[:, 2] + k // run[:, 3], offset=run[:, 4] + k % run[:, 3] * length)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([*[cut.schema[c] for c in columns], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*columns, "place").mapInPandas(place, schema)
