"""Linking project names to profiles, and the travel mode that follows from a link."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.functions.columns import first_rule, norm_name, words
from headway.operators.duplicates import meeting, numbered
from headway.session import settle

# fixed values: words that do not tell two projects apart
FILLER = ("extension", "corridor", "flash", "new", "starts")
CLOSE, AHEAD = 0.88, 0.05
FLOOR = CLOSE - AHEAD  # a runner-up below this can never matter

# fixed values: state names -> codes
STATE_CODES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO",
    "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "washington, dc": "DC", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI",
    "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC",
    "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "puerto rico": "PR",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX",
    "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI",
    "wyoming": "WY",
}

# fixed values: ordered phrases -> standard mode
MODE_PHRASES = (("bus rapid", "BRT"), ("brt", "BRT"), ("light rail", "Light Rail"), ("heavy rail", "Heavy Rail"),
                ("commuter rail", "Commuter Rail"), ("streetcar", "Streetcar"))


def canon_mode(c: Column | str) -> Column:
    text = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return first_rule([(text.rlike(rf"\b{p}\b"), m) for p, m in MODE_PHRASES])


def states_in(c: Column | str) -> Column:
    """Codes of the states named in a place text, sorted; the capital is not the state."""
    text = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    named = F.array_compact(F.array(*[F.when(text.rlike(rf"\b{n}\b"), F.lit(code)) for n, code in STATE_CODES.items()]))
    capital = text.contains("washington, dc") | text.contains("district of columbia")
    return F.sort_array(F.array_distinct(F.when(capital, F.array_remove(named, "WA")).otherwise(named)))


#: Program names on a profile's head, the label of the stated project, words for rail and bus rapid transit.
PROGRAMS = r"\b(Starts|Capacity)\b"
STATED = r"Proposed Project:\s*(.+)"
RAIL_WORDS = r"\b(light rail|heavy rail|commuter rail|streetcar|metrorail|subway)\b"
BRT_WORDS = r"\b(bus rapid transit|brt)\b"
FACT_PAGES = 2


def profile_facts(landed: DataFrame) -> DataFrame:
    """What a profile's text says: title, place, program, states, key, stated mode, and whether it speaks of rail or BRT.

    ``landed(file, pages)`` holds the text of each page; other columns stay. Only the first two pages count. The title is
    the first line that isn't blank (the file's name where there is none), the place the second ('' where there is none),
    the program the first of the next three lines that names one (else ''). Mentions only serve to detect conflicts.
    Null pages are empty; no line crosses tasks, every profile is one row.
    """
    pages = F.coalesce("pages", F.expr("array()").cast("array<string>"))
    text = F.array_join(F.transform(F.slice(pages, 1, FACT_PAGES), lambda p: F.coalesce(p, F.lit(""))), "\n")
    rows = landed.drop("title", "place", "program", "states", "key", "mode_field", "mode", "mentions_rail", "mentions_brt").withColumn("_text", text)
    lines = F.filter(F.transform(F.split("_text", r"[\r\n\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    rows = rows.withColumn("_lines", lines)
    line = lambda i: F.get("_lines", F.lit(i))
    stated = F.regexp_extract("_text", STATED, 1)
    low = F.lower("_text")
    rows = rows.withColumns({
        "title": F.coalesce(line(0), F.element_at(F.split("file", "/"), -1)), "place": F.coalesce(line(1), F.lit("")),
        "program": F.coalesce(F.get(F.filter(F.slice("_lines", 3, 3), lambda x: x.rlike(PROGRAMS)), F.lit(0)), F.lit("")),
        "mode_field": F.when(F.col("_text").rlike(STATED), F.trim(stated)),
        "mentions_rail": low.rlike(RAIL_WORDS), "mentions_brt": low.rlike(BRT_WORDS)})
    rows = rows.withColumns({"states": states_in("place"), "key": norm_name("title"), "mode": F.when(F.col("mode_field").isNotNull(), canon_mode("mode_field"))})
    return rows.drop("_text", "_lines", "pages")


def _grams(key: Column, size: int = 2) -> Column:
    """Letter runs of a size, numbered so that repeats count."""
    last = F.length(key) - (size - 1)
    runs = F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(key, i, F.lit(size)))).otherwise(
        F.expr("array()").cast("array<string>"))
    return F.transform(runs, lambda g, i: F.concat(
        g, F.lit("#"), F.size(F.filter(F.slice(runs, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


MATCHES = 6  # shared rare runs a pair must show before it is looked at


def _rare_grams(keys: DataFrame, numbers: DataFrame) -> DataFrame:
    """(key, gs): the numbers of a key's letter runs from rare to common."""
    grams = keys.select("key", F.explode(_grams(F.col("key"))).alias("w")).join(numbers, "w")
    return grams.groupBy("key").agg(F.sort_array(F.collect_list("number")).alias("gs"))  # one name's letters


NAMES = 2048  # names per side in one comparison task


def common_letters(a: str, places: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence with a text of ``size`` letters, given each letter's places in it as bits."""
    free = (1 << size) - 1
    every = free
    for letter in a:
        hit = free & places.get(letter, 0)
        free = (free + hit | free - hit) & every
    return size - free.bit_count()


def sequence_ratio(floor: float):
    """Matching-block similarity of two short names; 0 if it can't reach ``floor``.

    Matching blocks are a common subsequence, whose length takes a fraction of the time to find.
    """
    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher
        matcher, places, out = SequenceMatcher(None), {}, []
        for x, y in zip(a, b):
            if y != matcher.b or not out:
                matcher.set_seq2(y)  # its index is kept while rows of one name follow each other
                places = {}
                for i, letter in enumerate(y):
                    places[letter] = places.get(letter, 0) | 1 << i
            if 2 * common_letters(x, places, len(y)) < (floor - 1e-9) * (len(x) + len(y)):
                out.append(0.0)
                continue
            matcher.set_seq1(x)
            out.append(matcher.ratio())
        return pd.Series(out, dtype=float)

    return ratio


def _blocked(projects: DataFrame, profiles: DataFrame):
    """Projects, and both sides spread over the states they may meet in ('*' meets everything)."""
    everywhere = F.array(F.lit("*"))
    p = (projects.select("name", "state").distinct()
         .withColumn("key", norm_name("name"))
         .withColumn("id", project_id("name", "state")))
    codes = F.filter(F.split(F.coalesce("state", F.lit("")), "-"), lambda s: s != "")
    p = p.withColumn("ws", F.array_distinct(F.array_except(words("key"), F.array(*[F.lit(f) for f in FILLER]))))
    p = settle(p)
    p_blocks = p.select("id", "key", "ws", F.explode(F.array_union(codes, everywhere)).alias("block"))
    f = profiles.select("profile_id", "key", F.coalesce("states", F.expr("array()").cast("array<string>")).alias("st"))
    f = f.withColumn("ws", F.array_distinct(F.array_except(words("key"), F.array(*[F.lit(x) for x in FILLER]))))
    f_blocks = f.select("profile_id", F.col("key").alias("fkey"), F.col("ws").alias("fws"),
                        F.explode(F.when(F.size("st") == 0, everywhere).otherwise(F.col("st"))).alias("block"))

    return p, p_blocks, settle(f_blocks)


def _contained(p_rows: DataFrame, f_rows: DataFrame) -> DataFrame:
    """Pairs where the distinctive words of one name all occur in the other, met through the rarest
    word of the contained name."""
    p_words = p_rows.select("id", "ws", "block", F.explode("ws").alias("w"))
    f_words = f_rows.select("profile_id", "fws", "block", F.explode("fws").alias("w"))

    def rarest(rows: DataFrame, ident: list[str], other: DataFrame) -> DataFrame:
        df = other.groupBy("block", "w").agg(F.count(F.lit(1)).alias("df"))
        found = rows.join(df, ["block", "w"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
        return (found.groupBy(*ident, "block").agg(F.min(F.struct("df", "w")).alias("m"))
                .filter("m.df > 0").select(*ident, "block", F.col("m.w").alias("w")))

    inside = rarest(p_words, ["id", "ws"], f_words).join(f_words, ["block", "w"])
    around = rarest(f_words, ["profile_id", "fws"], p_words).join(p_words, ["block", "w"])
    cols = ["id", "ws", "profile_id", "fws"]
    return (inside.select(*cols).unionByName(around.select(*cols))
            .filter((F.size(F.array_except("ws", "fws")) == 0) | (F.size(F.array_except("fws", "ws")) == 0))
            .select("id", "profile_id").distinct())


def liking(floor: float):
    """A function for tasks that finds the names of two lists whose ratio may reach ``floor``; made here, so that it
    travels to the workers by value."""
    meet, first, both, matches = meeting(), (1.5 * floor - 1) * 2 / (2 - floor), 1.5 * floor - 1, MATCHES

    def bounds(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        need = np.maximum(np.ceil(size * first - 1 - 1e-9), 1).astype(np.int64)
        return need - np.minimum(need, matches), np.minimum(need, matches)

    def side(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers, places = np.unique(np.concatenate(rows), return_inverse=True)
        return np.array([len(r) for r in rows]), places.astype(np.int32), numbers

    def common(name: np.ndarray, letters: int, texts: np.ndarray, longer: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of a name with each of many texts, which stand from long to short;
        ``longer`` tells how many have a letter at each place. A bit of ``free`` stands for a letter of the name."""
        words = -(-len(name) // 64)
        masks = np.zeros((words, letters), np.uint64)
        at = np.arange(len(name))
        np.bitwise_or.at(masks, (at // 64, name), np.uint64(1) << (at % 64).astype(np.uint64))
        free = np.full((words, len(texts)), ~np.uint64(0))
        for place, n in enumerate(longer):
            letter, carry = texts[:n, place], None
            for w in range(words):
                now = free[w, :n]
                hit = now & masks[w][letter]
                total = now + hit
                over = total < now
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
                free[w, :n] = total | (now ^ hit)
        free[-1] |= ~np.uint64(0) << np.uint64(len(name) - 64 * (words - 1)) if len(name) % 64 else np.uint64(0)
        return np.bitwise_count(~free).sum(axis=0, dtype=np.int64)

    def like(keys: list[str], grams: list[np.ndarray], names: list[str], name_grams: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Each name's number, and the numbers of the keys that may reach the ratio with it."""
        points = [np.array([ord(c) for c in k], np.int64) for k in (*keys, *names)]
        alphabet, flat = np.unique(np.concatenate(points), return_inverse=True)
        sizes = np.array([len(x) for x in points])
        flat = np.split(flat, np.cumsum(sizes)[:-1])
        length, flength = sizes[:len(keys)], sizes[len(keys):]
        order = np.argsort(-length, kind="stable")
        texts = np.zeros((len(keys), length.max()), np.int32)
        for row, k in enumerate(order):
            texts[row, :length[k]] = flat[k]
        sorted_length = length[order]
        row_of = np.empty(len(keys), np.int64)
        row_of[order] = np.arange(len(keys))
        host, guest = side(grams), side(name_grams)
        shared, mine, theirs = np.intersect1d(host[2], guest[2], assume_unique=True, return_indices=True)
        often = np.bincount(host[1], minlength=len(host[2]))[mine] @ np.bincount(guest[1], minlength=len(guest[2]))[theirs]
        everyone = np.arange(len(keys))

        def met() -> Iterator[tuple[int, np.ndarray]]:
            if often >= 2 * len(keys) * len(names):  # most pairs meet several times
                for n in range(len(names)):
                    yield n, everyone
                return
            for g, h, times in meet(host, guest, bounds(length), bounds(flength), lambda g, h: np.ones(len(g), bool)):
                good = times >= both * (length[h] + flength[g]) - 1 - 1e-9
                g, h = g[good], h[good]
                cuts = np.flatnonzero(np.diff(g)) + 1
                for part, rows in zip(np.split(g, cuts), np.split(h, cuts)):
                    if len(part):
                        yield int(part[0]), np.sort(row_of[rows])

        for n, rows in met():
            name, total = flat[len(keys) + n], sorted_length[rows] + flength[n]
            rows = rows[2 * np.minimum(sorted_length[rows], flength[n]) >= (floor - 1e-9) * total]
            if not len(rows):
                continue
            size = sorted_length[rows]
            longer = np.searchsorted(-size, -np.arange(size[0]), "left")  # rows with more letters than that
            found = common(name, len(alphabet), texts[rows], longer)
            rows = rows[2 * found >= (floor - 1e-9) * (size + flength[n])]
            if len(rows):
                yield n, order[rows]

    return like


def _name_blocks(p_keys: DataFrame, f_keys: DataFrame, compare: Callable, kind: str | T.StructType) -> DataFrame:
    """What ``compare`` makes of two chunks of a block's names; inputs are (key, block, ...) and (fkey, block, ...), written.

    Both sides of a block are cut into chunks of NAMES rows, and a task meets two of them.
    """
    tasks = int(p_keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = p_keys.select("key").distinct(), f_keys.select(F.col("fkey").alias("key")).distinct()
    names = numbered(left.unionByName(right).select(F.explode(_grams(F.col("key"))).alias("w"))
                     .groupBy("w").agg(F.count(F.lit(1)).alias("df")))
    count = lambda rows, name: rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / NAMES).alias(name))
    chunks = count(p_keys, "left").join(count(f_keys, "right"), "block")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    rest, more = ([c for c in rows.columns if c not in ("key", "fkey", "block")] for rows in (p_keys, f_keys))
    hosts = _rare_grams(left, names).join(p_keys.join(chunks, "block"), "key").select(
        "key", "gs", "block", *rest, F.pmod(F.xxhash64("key", *rest), F.col("left")).alias("i"), each("right").alias("j"))
    guests = _rare_grams(right, names).join(f_keys.join(chunks, "block").withColumnRenamed("fkey", "key"), "key").select(
        F.col("key").alias("fkey"), F.col("gs").alias("fgs"), "block", *more, each("left").alias("i"), F.pmod(F.xxhash64("key", *more), F.col("right")).alias("j"))
    at = ["block", "i", "j"]
    # fixed numbers of tasks: few bytes here make many pairs
    return hosts.repartition(tasks, *at).groupBy(*at).cogroup(guests.repartition(tasks, *at).groupBy(*at)).applyInPandas(compare, kind)


def candidate_names(p_keys: DataFrame, f_keys: DataFrame, floor: float) -> DataFrame:
    """(key, fkey) of different spellings whose ratio may reach ``floor``; inputs are (key, block) and (fkey, block).

    Spellings count once however many rows have them. Matched letters M of a pair with ratio r satisfy 2M = r * (la + lb),
    the shared numbered runs are at least 3M - (la + lb) - 1, and la + lb >= la * 2 / (2 - r): so any two keys with
    ratio >= floor share at least ``need`` runs, and after sorting by rarity ``least <= need`` of them lie among the
    first ``runs - need + least`` of both. Matching blocks are a common subsequence, so M is at most the length of the
    longest one. Both are looked at inside the task that meets two chunks of names; other pairs never leave it.
    """
    tasks = int(p_keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    like = liking(floor)

    def compare(host: pd.DataFrame, guest: pd.DataFrame) -> pd.DataFrame:
        if host.empty or guest.empty:
            return pd.DataFrame({"key": [], "fkey": []}, dtype=object)
        keys, fkeys = host["key"].to_numpy(object), guest["fkey"].to_numpy(object)
        found = [(keys[h], np.repeat(fkeys[g:g + 1], len(h))) for g, h in like(list(keys), list(host["gs"]), list(fkeys), list(guest["fgs"]))]
        if not found:
            return pd.DataFrame({"key": [], "fkey": []}, dtype=object)
        a, b = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame({"key": pd.Series(a, dtype=object), "fkey": pd.Series(b, dtype=object)})

    met = _name_blocks(settle(p_keys.distinct()), settle(f_keys.distinct()), compare, "key string, fkey string")
    return met.repartition(tasks, "key", "fkey").distinct()


def _close_lists(p_blocks: DataFrame, f_blocks: DataFrame) -> DataFrame:
    """(profile_id, ids): the projects whose spelling ratio with a document in a common block is CLOSE or more, in some
    lists for each document. A pair is an entry of a list, not a row of the joins."""
    like, least = liking(CLOSE), CLOSE

    def compare(host: pd.DataFrame, guest: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher
        if host.empty or guest.empty:
            return pd.DataFrame({"profile_id": [], "ids": []}, dtype=object)
        keys, ids, matcher = list(host["key"]), host["id"].to_numpy(object), SequenceMatcher(None)
        spelled = guest.groupby("fkey").indices  # a spelling counts once
        fkeys = list(spelled)
        grams, documents = guest["fgs"].to_numpy(), guest["profile_id"].to_numpy()
        rows, lists = [], []
        for g, h in like(keys, list(host["gs"]), fkeys, [grams[spelled[k][0]] for k in fkeys]):
            matcher.set_seq2(fkeys[g])
            near = []
            for n in h:
                matcher.set_seq1(keys[n])
                if matcher.ratio() >= least:
                    near.append(ids[n])
            if near:
                rows.append(spelled[fkeys[g]])
                lists += [near] * len(rows[-1])
        if not rows:
            return pd.DataFrame({"profile_id": [], "ids": []}, dtype=object)
        return pd.DataFrame({"profile_id": documents[np.concatenate(rows)], "ids": lists})

    p_keys = settle(p_blocks.select("id", "key", "block").distinct())
    f_keys = settle(f_blocks.filter("profile_id IS NOT NULL").select("profile_id", "fkey", "block").distinct())
    return _name_blocks(p_keys, f_keys, compare, T.StructType([f_keys.schema["profile_id"], T.StructField("ids", T.ArrayType(T.StringType()))]))


def _close_pairs(p_rows: DataFrame, f_blocks: DataFrame, floor: float) -> DataFrame:
    """(id, profile_id, ratio) of pairs in a common block whose spelling ratio is at least ``floor``."""
    names = candidate_names(p_rows.select("key", "block"), f_blocks.select("fkey", "block"), floor)
    close = settle(names.sortWithinPartitions("fkey").withColumn("ratio", sequence_ratio(floor)("key", "fkey"))
                   .filter(F.col("ratio") > floor - 1e-9))
    return (close.join(p_rows.select("id", "key", "block").distinct(), "key")
            .join(f_blocks.select("profile_id", "fkey", "block").distinct(), ["fkey", "block"])
            .select("id", "profile_id", "ratio").distinct())


def _close_links(p_rows: DataFrame, f_blocks: DataFrame) -> DataFrame:
    """(id, close_id): the one profile of ratio CLOSE or more that is AHEAD of every other.

    Most projects are settled by the pairs of ratio CLOSE or more. Only those with a clear best pair among these
    look further down, where a runner-up could stand.
    """
    def best_and_next(pairs: DataFrame) -> DataFrame:
        best = pairs.groupBy("id").agg(F.max(F.struct("ratio", (-F.col("profile_id")).alias("neg"))).alias("b"))
        rest = pairs.join(best, "id").filter(F.col("profile_id") != -F.col("b.neg")).groupBy("id").agg(F.max("ratio").alias("runner_up"))
        return (best.join(rest, "id", "left").select("id", "b", "runner_up")
                .filter(F.col("runner_up").isNull() | (F.col("b.ratio") - F.col("runner_up") >= AHEAD)))

    top = settle(best_and_next(settle(_close_pairs(p_rows, f_blocks, CLOSE))).select("id", "b"))
    below = _close_pairs(p_rows.join(top.select("id"), "id", "left_semi"), f_blocks, FLOOR)
    rivals = (below.join(top, "id").filter((F.col("profile_id") != -F.col("b.neg")) & (F.col("b.ratio") - F.col("ratio") < AHEAD))
              .select("id").distinct())
    return top.join(rivals, "id", "left_anti").select("id", (-F.col("b.neg")).alias("close_id"))


def link_profiles(projects: DataFrame, profiles: DataFrame) -> DataFrame:
    """Link (name, state) pairs to profiles.

    ``projects(name, state)``; ``profiles(profile_id, key, states)`` where ``profile_id`` follows file
    order. Returns one row per distinct (name, state) with ``profile_id`` (NULL when unlinked) and
    ``tier``. Pairs are only formed through shared keys, shared rare words or shared rare letter runs
    inside a state, so a state or a word held by most rows does not produce all pairs.
    """
    # both sides and each tier are used several times below, so they are written once
    p, p_blocks, f_blocks = _blocked(projects, profiles)
    same = (p_blocks.join(f_blocks, (p_blocks["block"] == f_blocks["block"]) & (p_blocks["key"] == f_blocks["fkey"]))
            .groupBy("id").agg(F.min("profile_id").alias("exact_id")))
    same = settle(same)

    open_p = p_blocks.join(same, "id", "left_anti")
    contained = (_contained(open_p.filter(F.size("ws") > 0), f_blocks.filter(F.size("fws") > 0))
                 .groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("profile_id").alias("only_id"))
                 .filter("n = 1").select("id", "only_id"))
    contained = settle(contained)

    close = _close_links(open_p.join(contained, "id", "left_anti"), f_blocks)
    out = p.join(same, "id", "left").join(contained, "id", "left").join(close, "id", "left")
    tier = first_rule([(F.col("exact_id").isNotNull(), "exact"), (F.col("only_id").isNotNull(), "contained"),
                       (F.col("close_id").isNotNull(), "close")], F.lit("none"))
    return out.select("name", "state", "key", F.coalesce("exact_id", "only_id", "close_id").alias("profile_id"),
                      tier.alias("tier"))


def pair_links(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """(profile_id, links): of each document that has any, the (project, document) pairs in which the document, taken
    alone, would be the project's link, as ``project_id`` texts: equal keys, one side's distinctive words inside the
    other's, or a close enough spelling."""
    _, p_blocks, f_blocks = _blocked(projects, documents)
    same = p_blocks.join(f_blocks, (p_blocks["block"] == f_blocks["block"]) & (p_blocks["key"] == f_blocks["fkey"]))
    inside = _contained(p_blocks.filter(F.size("ws") > 0), f_blocks.filter(F.size("fws") > 0))
    ids = [d.select("profile_id", F.array("id").alias("ids")) for d in (same, inside)]
    return (ids[0].unionByName(ids[1]).unionByName(_close_lists(p_blocks, f_blocks))
            .groupBy("profile_id").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("links")))


def project_id(name: Column | str, state: Column | str) -> Column:
    """A text that stands for a (name, state), nulls included."""
    return F.concat_ws("\x01", F.coalesce(name, F.lit("\x02")), F.coalesce(state, F.lit("\x02")))


def project_of(ident: Column) -> tuple[Column, Column]:
    """The name and the state that a ``project_id`` stands for."""
    state = F.substring_index(ident, "\x01", -1)
    name = F.left(ident, F.length(ident) - F.length(state) - 1)
    return F.nullif(name, F.lit("\x02")), F.nullif(state, F.lit("\x02"))


# fixed values: provenance texts of an assigned mode
FROM_DASHBOARD = "FTA dashboard (Length of Exclusive BRT)"
FROM_PROFILE = "FTA project profile"
NOT_STATED = "not stated by FTA sources"


def assign_mode(excl_brt: Column, linked: Column, mode: Column, mentions_rail: Column) -> Column:
    """struct(mode, source) from the exclusive-lane column and the linked profile; conflicts give no mode."""
    lane = ~F.upper(F.trim(F.coalesce(excl_brt, F.lit("")))).isin("", "N/A")
    out = lambda m, s: F.struct(m.cast("string").alias("mode"), s.alias("source"))
    nothing = F.lit(None)
    clash = F.concat(F.lit("conflict: dashboard BRT column vs profile ("), mode, F.lit(")"))
    rail = F.lit("conflict: dashboard BRT column but the profile also describes a rail mode")
    return (F.when(lane & mode.isNotNull() & (mode != "BRT"), out(nothing, clash))
            .when(lane & linked & mode.isNull() & mentions_rail, out(nothing, rail))
            .when(lane, out(F.lit("BRT"), F.lit(FROM_DASHBOARD)))
            .when(mode.isNotNull(), out(mode, F.lit(FROM_PROFILE)))
            .otherwise(out(nothing, F.lit(NOT_STATED))))


def remode(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Re-derive mode, provenance and profile file of every stored snapshot row."""
    links = link_profiles(rows.select(F.col("project_name").alias("name"), "state"), profiles)
    facts = profiles.select("profile_id", F.col("mode").alias("_pmode"), "mentions_rail", "file")
    joined = (rows.drop("mode", "mode_source", "profile_file")
              .join(links.select(F.col("name").alias("_n"), F.col("state").alias("_s"), "profile_id"),
                    F.col("project_name").eqNullSafe(F.col("_n")) & F.col("state").eqNullSafe(F.col("_s")), "left")
              .drop("_n", "_s").join(facts, "profile_id", "left"))
    a = assign_mode(F.col("excl_brt"), F.col("profile_id").isNotNull(), F.col("_pmode"),
                    F.coalesce("mentions_rail", F.lit(False)))
    return (joined.withColumn("_a", a)
            .withColumns({"mode": F.col("_a.mode"), "mode_source": F.col("_a.source"), "profile_file": F.col("file")})
            .drop("_a", "_pmode", "mentions_rail", "file", "profile_id"))


def provenance_counts(rows: DataFrame) -> DataFrame:
    return (rows.groupBy(F.split("mode_source", ":")[0].alias("source")).agg(F.count(F.lit(1)).alias("n")))
