"""Near-duplicates by a chosen-path set similarity join.

Documents with the same set of shingles are one class from the start. Every class has minwise values of its set; a tree
branches classes on some of them: classes that agree in a chosen value go into the same node. Nodes small enough are
compared exhaustively. Trees are repeated so that a linked pair meets in some small node: a pair of similarity s survives
a branching with probability s or more. The 16 trees share some of the values; by simulation they miss a pair at the
threshold with a chance of 3 in 10,000.

Nodes that stay large are mostly one group of near copies. They are never compared pair by pair: every member is
compared with a few central members of its node, the links found are confirmed, and after that only members outside the
node's largest component are compared with the others, in blocks. So no link between components is lost and none inside them
is needed.

Large nodes of all trees that share their largest component are compared together, so that a group of copies meets its
outsiders once and not once in every tree.

Candidates are filtered by estimated similarity (96 minwise bytes, five standard deviations below the threshold) and
by size, both worked out from ``percent``; every link is confirmed on the full sets.

Defined results: null and empty texts, and texts of white space, have no shingles, are linked with nothing and are
kept; a document without id takes part, but names no component; a component without any id has none, and its members
without id are kept; rows that agree in id and text share a component.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.llm.common import in_parts, small, texts
from headway.operators.duplicates import connected
from headway.session import settle

VALUES = 96
TREES = 16
DEPTH = 4
LEAF = 16
#: Members of a large node whose values make its centre, and pivots taken near it.
CENTRE, PIVOTS = 64, 8
#: Outsiders in a block; members, and shingles, in a chunk.
BLOCK, CHUNK, CHUNK_SHINGLES = 64, 1024, 1_000_000
#: Pairs of a block and a chunk that a task holds at once.
PAIRS_AT_ONCE = 8
#: Standard deviations of the estimate below the threshold at which a pair is no candidate.
DEVIATIONS = 5
#: Words whose hashes are kept at hand in a task; the store is emptied when full. It changes speed only.
WORDS_KEPT = 100_000


def shingler(k: int):
    """A function from text to the sorted array of its distinct shingle hashes."""
    import xxhash

    known: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest

    def shingles(text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(k, len(words))
        out = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i:len(words) - size + 1 + i]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return np.unique(out ^ (out >> np.uint64(31)))

    return shingles


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, h, n, cls (128-bit digest of the set, null without shingles), values (minwise, 4 bytes each), tags (1 byte each)."""
    rows = texts(docs)
    kind = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("h long, n long, cls binary, mins binary, tags binary").fields])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles = shingler(k)
        factors = np.random.default_rng(11).integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in in_parts(batches):
            out = []
            for text in batch.column("text"):
                s = shingles(text.as_py())
                if not len(s):
                    out.append((0, None, None, None))
                    continue
                least = np.full(VALUES, 2**64 - 1, dtype=np.uint64)
                for a in range(0, len(s), 2048):
                    least = np.minimum(least, (s[a:a + 2048, None] * factors).min(axis=0))
                mins = (least >> np.uint64(16)).astype(np.uint32)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), mins.tobytes(), (mins & 0xFF).astype(np.uint8).tobytes()))
            n, *parts = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), *[pa.array(c, pa.binary()) for c in parts]],
                                             ["doc_id", "h", "n", "cls", "mins", "tags"])

    return rows.mapInArrow(sketch, kind)


def _value(i: int):
    """Minwise value number ``i`` of the binary column."""
    return F.hex(F.substring(F.col("mins"), 4 * i + 1, 4))


def _tree_values(tree: int, level: int) -> list[int]:
    """Which values a tree branches on at a level: one at the root, then one or two (1.25 on average)."""
    rng = random.Random(f"{tree}/{level}")
    return rng.sample(range(VALUES), 1 if level == 0 or rng.random() < 0.75 else 2)


def nodes(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, cls) of the small nodes of all trees, and of the nodes that stay large."""
    def branches(level: int, tree: int):
        return [F.xxhash64(F.lit(tree) if level == 0 else F.col("path"), F.lit(100 * level + v), _value(v)) for v in _tree_values(tree, level)]

    rows = classes.select("cls", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), b.alias("path")) for t in range(TREES) for b in branches(0, t)])).alias("x")).select("cls", "x.tree", "x.path")
    leaves = None
    for level in range(1, DEPTH + 1):
        rows = rows if level == 1 else settle(rows)  # at the root a projection of written rows
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
        held = settle(rows.join(sizes, "path"))
        leaf = held.filter(F.col("size") <= LEAF).select("path", "cls")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        large = held.filter(F.col("size") > LEAF).select("path", "cls", "tree")
        if level == DEPTH or large.limit(1).count() == 0:
            return leaves, large.select("path", "cls")
        # one row of branches per tree; a class goes to each child it has
        child = F.array()
        for t in range(TREES):
            some = F.array(*branches(level, t))
            child = F.when(F.col("tree") == t, some).otherwise(child.cast("array<bigint>"))
        rows = large.join(classes.select("cls", "mins"), "cls").select("cls", "tree", F.explode(child).alias("path")).distinct()
    raise AssertionError


def estimate(percent: int) -> float:
    """The estimated similarity below which pairs aren't candidates for a link at ``percent``."""
    p = percent / 100
    return max(0.0, p - DEVIATIONS * (p * (1 - p) / VALUES) ** 0.5)


def _similar(tags: list[bytes], sizes: np.ndarray, others: list[bytes], other_sizes: np.ndarray, percent: int) -> np.ndarray:
    """Estimated similarities, -1 where sizes alone exclude a link."""
    x = np.frombuffer(b"".join(tags), dtype=np.uint8).reshape(len(tags), -1)
    y = np.frombuffer(b"".join(others), dtype=np.uint8).reshape(len(others), -1)
    out = np.zeros((len(x), len(y)))
    for i in range(len(x)):
        out[i] = (x[i] == y).mean(axis=1)
    low = np.minimum(sizes[:, None], other_sizes[None, :])
    high = np.maximum(sizes[:, None], other_sizes[None, :])
    return np.where(100 * low >= percent * high, out, -1.0)


PAIRS = "a binary, b binary"


def _pair_frame(a: list[bytes], b: list[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"a": [min(x, y) for x, y in zip(a, b)], "b": [max(x, y) for x, y in zip(a, b)]}, dtype=object)


def leaf_pairs(leaves: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidates inside small nodes."""
    least = estimate(percent)
    # a node that several trees agree on is compared once
    groups = leaves.groupBy("path").agg(F.array_sort(F.collect_set("cls")).alias("m")).select("m").distinct()
    member = settle(groups.select(F.xxhash64("m").alias("node"), F.explode("m").alias("cls")))
    full = member.join(classes.select("cls", "n", "tags"), "cls").groupBy("node").agg(F.collect_list(F.struct("cls", "n", "tags")).alias("m"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a: list[bytes] = []
            b: list[bytes] = []
            for m in batch["m"]:
                cls, n, tags = [r["cls"] for r in m], np.array([r["n"] for r in m]), [r["tags"] for r in m]
                s = _similar(tags, n, tags, n, percent)
                for i, j in zip(*np.nonzero(np.triu(s >= least, 1))):
                    a.append(cls[i])
                    b.append(cls[j])
            yield _pair_frame(a, b)

    return full.select("m").mapInPandas(compare, PAIRS)


def pivot_pairs(dense: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Each member of a large node with the two most similar of the node's pivots.

    Pivots are the members nearest to the node's centre, which has the commonest value of each of the minwise
    bytes of some members: in a group of copies of one text, these are that text and its closest copies.
    """
    least = estimate(percent)
    order = Window.partitionBy("path").orderBy(F.xxhash64("cls"), "cls")
    some = dense.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= CENTRE).select("path", "cls")
    some = some.join(classes.select("cls", "tags"), "cls").groupBy("path").agg(F.collect_list("tags").alias("t"))

    @F.pandas_udf("binary")
    def middle(groups: pd.Series) -> pd.Series:
        out = []
        for tags in groups:
            x = np.frombuffer(b"".join(sorted(tags)), dtype=np.uint8).reshape(len(tags), -1)
            out.append(bytes(int(np.bincount(x[:, i]).argmax()) for i in range(x.shape[1])))
        return pd.Series(out)

    @F.pandas_udf("double")
    def agreement(tags: pd.Series, centre: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(c), dtype=np.uint8).reshape(len(c), -1) for c in (tags, centre))
        return pd.Series((x == y).mean(axis=1))

    centres = some.select("path", middle("t").alias("centre"))
    rows = settle(dense.join(classes.select("cls", "n", "tags"), "cls").join(centres, "path")
                  .select("path", "cls", "n", "tags", agreement("tags", "centre").alias("near")))
    best = Window.partitionBy("path").orderBy(F.desc("near"), "cls")
    few = rows.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= PIVOTS)
    pivots = few.groupBy("path").agg(F.collect_list(F.struct("cls", "n", "tags")).alias("p"))
    rows = rows.join(pivots, "path").select("cls", "n", "tags", "p")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a: list[bytes] = []
            b: list[bytes] = []
            for cls, n, tags, p in zip(batch["cls"], batch["n"], batch["tags"], batch["p"]):
                s = _similar([tags], np.array([n]), [r["tags"] for r in p], np.array([r["n"] for r in p]), percent)[0]
                best = [j for j in np.argsort(-s, kind="stable") if s[j] >= least and p[j]["cls"] != cls][:2]
                a += [cls] * len(best)
                b += [p[j]["cls"] for j in best]
            yield _pair_frame(a, b)

    return rows.mapInPandas(compare, PAIRS)


def outsiders(dense: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the nodes that hold several components: path, cls, grp, main (the node's largest component)."""
    rows = dense.join(groups, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    counts = rows.groupBy("path", "grp").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy("path").agg(F.max(F.struct("c", "grp")).alias("top"), F.sum("c").alias("size"))
    mixed = per.filter(F.col("size") > F.col("top.c")).select("path", F.col("top.grp").alias("main"))
    return rows.join(mixed, "path")


def outsider_links(mixed: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of large nodes outside the node's largest component and members of other components.

    Nodes with the same largest component count as one: near copies stand together in nodes of most trees. Blocks of
    outsiders are sent to every chunk of all members, and chunks go to different tasks; candidates by estimate are confirmed on the full sets in place, and
    two components that a task has linked once are not compared again there.
    """
    least = estimate(percent)
    members = mixed.select(F.col("main").alias("path"), "cls", "grp", "main").distinct()
    held = settle(members.join(classes.select("cls", "n", "tags"), "cls").join(sets, "cls"))
    sizes = held.groupBy("path").agg(F.count_if(F.col("grp") != F.col("main")).alias("outside"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"),
                                      F.sum(F.when(F.col("grp") != F.col("main"), F.col("n"))).alias("told"))
    held = held.join(sizes, "path")
    one = F.struct("cls", "grp", "n", "tags", "s")
    parts = F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES))
    # a block is bounded in shingles, too: its members are in one row
    blocks = F.greatest(F.ceil(F.col("outside") / BLOCK), F.ceil(F.col("told") / CHUNK_SHINGLES))
    block = (held.filter(F.col("grp") != F.col("main")).groupBy("path", F.pmod(F.xxhash64("cls"), blocks).alias("i"))
             .agg(F.collect_list(one).alias("u"), F.first(parts).alias("parts")))
    block = block.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("j"), "u")
    chunk = held.groupBy("path", F.pmod(F.xxhash64("cls"), parts).alias("j")).agg(F.collect_list(one).alias("m"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a: list[bytes] = []
            b: list[bytes] = []
            for u, m in zip(batch["u"], batch["m"]):
                s = _similar([r["tags"] for r in u], np.array([r["n"] for r in u]), [r["tags"] for r in m], np.array([r["n"] for r in m]), percent)
                joined: dict[bytes, bytes] = {}

                def root(g: bytes) -> bytes:
                    while g in joined:
                        g = joined[g]
                    return g

                rows, columns = np.nonzero(s >= least)
                for k in np.argsort(-s[rows, columns], kind="stable"):
                    x, y = u[rows[k]], m[columns[k]]
                    g, h = root(x["grp"]), root(y["grp"])
                    if g != h and _linked(x["s"], y["s"], percent):
                        joined[g] = h
                        a.append(x["cls"])
                        b.append(y["cls"])
            yield _pair_frame(a, b)

    return block.join(chunk, ["path", "j"]).select("u", "m").mapInPandas(compare, PAIRS)


def _linked(x: bytes, y: bytes, percent: int) -> bool:
    p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    common = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * common >= percent * (len(p) + len(q) - common)


def full_sets(wanted: DataFrame, docs: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """(cls, s): the whole sets of the wanted classes, read again from one document of each."""
    place = settle(first.join(wanted.select("cls").distinct(), "cls").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "cls"))
    rows = texts(docs)
    rows = rows.join(small(place), rows["doc_id"].eqNullSafe(F.col("d")) & (rows["h"] == F.col("g"))).select("cls", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(k)
        for batch in in_parts(batches):
            found = [shingles(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("cls").cast(pa.binary()), pa.array(found, pa.binary())], ["cls", "s"])

    return settle(rows.mapInArrow(sets, "cls binary, s binary").dropDuplicates(["cls"]))


def confirm(pairs: DataFrame, docs: DataFrame, first: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= percent * union, on the full sets."""
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    full = full_sets(wanted, docs, first, k)
    both = (pairs.join(full.select(F.col("cls").alias("a"), F.col("s").alias("x")), "a")
            .join(full.select(F.col("cls").alias("b"), F.col("s").alias("y")), "b"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[_linked(x, y, percent) for x, y in zip(batch["x"], batch["y"])], ["a", "b"]]

    return both.select("a", "b", "x", "y").mapInPandas(link, PAIRS)


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups (cls, grp) after further links, which join whole groups; a class that stands in none is its own."""
    of = lambda end: groups.select(F.col("cls").alias(end), F.col("grp").alias(f"{end}_grp"))
    edges = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
             .select(F.coalesce("a_grp", "a").alias("a"), F.coalesce("b_grp", "b").alias("b")))
    joined = connected(edges)
    known = groups.join(joined.withColumnRenamed("id", "grp"), "grp", "left").select("cls", F.coalesce("group", "grp").alias("grp"))
    single = joined.join(groups.select(F.col("cls").alias("id")), "id", "left_anti").select(F.col("id").alias("cls"), F.col("group").alias("grp"))
    return settle(known.unionByName(single))


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, h, n, component_id of every row: the smallest doc_id reachable by links."""
    rows = settle(sketches(docs, k))
    known = rows.filter(F.col("cls").isNotNull())
    classes = settle(known.groupBy("cls").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("tags").alias("tags")))
    # the document a class's set is read from again
    first = known.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("f")).select("cls", "f.doc_id", "f.h")
    leaves, dense = nodes(classes)
    dense = settle(dense)
    pairs = leaf_pairs(leaves, classes, percent)
    stays_large = dense.limit(1).count() > 0
    if stays_large:
        pairs = pairs.unionByName(pivot_pairs(dense, classes, percent))
    links = settle(confirm(settle(pairs.distinct()), docs, first, k, percent))

    groups = settle(connected(links).select(F.col("id").alias("cls"), F.col("group").alias("grp")))
    if stays_large:
        # smaller groups of copies inside a large node find their own pivots
        apart = outsiders(dense, groups).filter(F.col("grp") != F.col("main")).select("path", "cls")
        more = settle(pivot_pairs(settle(apart), classes, percent).distinct())
        if more.limit(1).count():
            groups = merged(groups, confirm(more, docs, first, k, percent))
        mixed = settle(outsiders(dense, groups))
        if mixed.limit(1).count():
            sets = full_sets(mixed, docs, first, k)
            # a row of this comparison is a whole block and chunk: few of them fit into one Arrow batch
            conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
            usual = conf.get(name)
            conf.set(name, str(PAIRS_AT_ONCE))
            try:
                last = settle(outsider_links(mixed, classes, sets, percent).distinct())
            finally:
                conf.set(name, usual)
            if last.limit(1).count():
                groups = merged(groups, last)
    named = classes.select("cls", "low").join(groups, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    lowest = named.groupBy("grp").agg(F.min("low").alias("component_id"))
    out = rows.select("doc_id", "h", "n", "cls").join(named.join(lowest, "grp").select("cls", "component_id"), "cls", "left")
    return out.select("doc_id", "h", "n", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def judge(docs: DataFrame, k: int, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    found = components(docs, k, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with its columns; of rows that agree in id and text one stays."""
    found = components(docs, k, percent)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "h").distinct()
    names = ["_id", "_null", "_h", "_row"]
    while {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        names = [n + "_" for n in names]
    # the same key for joining and for folding repeated rows, so that texts are dealt out once
    keys = lambda h: {names[0]: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), names[1]: F.col("doc_id").isNull(), names[2]: h}
    mine = docs.withColumns(keys(F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))
    kept = mine.join(stay.withColumns(keys(F.col("h"))).select(*names[:3]), names[:3], "left_semi")
    return kept.groupBy(*names[:3]).agg(F.first(F.struct(*docs.columns)).alias(names[3])).select(f"{names[3]}.*")
