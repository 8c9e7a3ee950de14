import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.operators import duplicates, posts, review, triage

NOW = datetime(2026, 3, 1, 12)


@pytest.mark.parametrize("published, deadline, evergreen, want", [
    (date(2026, 3, 1), None, False, ("Fresh", 84)), (date(2026, 2, 20), None, False, ("Aging", 4)), (None, None, False, ("Stale", 0)),
    (None, date(2026, 3, 1), False, ("Expired", 6)), (None, date(2026, 3, 2), False, ("Live", 99)), (None, date(2027, 1, 1), False, ("Live", 70)),
    (date(2025, 1, 1), None, True, ("Developing", 22)), (date(2026, 4, 1), None, False, ("Fresh", 100))])
def test_freshness(spark, published, deadline, evergreen, want):
    df = spark.createDataFrame([(published, deadline)], "p date, d date")
    got = df.select(review.freshness(F.col("p"), F.col("d"), F.lit(evergreen), NOW).alias("f")).first()["f"]
    assert (got["status"], got["score"]) == want


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["id"]: r["group"] for r in duplicates.connected(df).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])


def brute_words(items):
    import re
    from headway.functions.columns import STOP_WORDS
    return {i: {w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 2 and w not in STOP_WORDS} for i, t, _ in items}


def overlap(a, b):
    n = len(a & b)
    return n / min(len(a), len(b)) if n >= 3 else 0.0


def make_items(n=120):
    rnd = random.Random(8)
    vocab = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.sample(vocab, rnd.randint(3, 12))), rnd.choice(["AA", "BB", None, ""])) for i in range(n)]
    copies = [(n + i, rows[0][1], "AA" if i % 2 else None) for i in range(60)]  # a third of all rows are copies
    return rows + copies


def test_duplicate_groups_match_brute_force(spark):
    items = make_items()
    ws = brute_words(items)
    st = {i: (s or "").upper() for i, _, s in items}
    edges = [(a, b) for a in ws for b in ws if a < b and overlap(ws[a], ws[b]) >= 0.7 and not (st[a] and st[b] and st[a] != st[b])]
    df = spark.createDataFrame(items, "id bigint, headline string, state string")
    got = {r["id"]: r["group"] for r in duplicates.duplicate_groups(df).collect()}
    assert got == union_find(edges)


def test_lexical_pairs_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "LEAST_WORDS", 800)
    items = make_items()
    ws = brute_words(items)
    df = spark.createDataFrame(items, "id bigint, headline string, state string")
    sets = duplicates.settle(duplicates.word_sets(df, state=None))
    reps = {r["rep"] for r in sets.collect()}
    assert duplicates._blocks(duplicates._rare_first(sets, duplicates.numbered(duplicates._spread(sets))))[1] > 4
    found = duplicates.lexical_pairs(sets)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted((a, b) for a in reps for b in reps if a < b and overlap(ws[a], ws[b]) >= 0.7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    later = plan.split("FlatMapCoGroupsInPandas")[0]
    assert later != plan and "Exchange" not in later  # pairs that only share a word aren't shuffled
    titles = duplicates.word_sets(df.filter("id < 30"), ident="id", state=None)
    shown = {r["rep"] for r in titles.collect()}
    matches = duplicates.lexical_matches(sets, titles).collect()
    assert sorted((r["rep"], r["title"]) for r in matches) == sorted((a, b) for a in reps for b in shown if overlap(ws[a], ws[b]) >= 0.65)


def test_word_blocks_are_read_not_shuffled(spark, monkeypatch):
    for name, value in (("LEAST_WORDS", 800), ("BLOCK_WORDS", 800), ("DEALT_WORDS", 0), ("COMMON", 8), ("TILE", 2)):
        monkeypatch.setattr(duplicates, name, value, raising=False)
    items = make_items() + [(500, "word1 word2 word3 word4", None), (None, "word1 word2 word3 word5", None)]
    ws = {i: w for i, w in brute_words(items).items() if i is not None}
    st = {i: (s or "").upper() for i, _, s in items}
    df = spark.createDataFrame(items, "id bigint, headline string, state string")
    sets = duplicates.word_sets(df)
    reps = sorted(r["rep"] for r in sets.select("rep").collect() if r["rep"] is not None)
    want = [(a, b) for a in reps for b in reps if a < b and overlap(ws[a], ws[b]) >= 0.7]
    found = duplicates.lexical_pairs(sets)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan  # however many blocks a text meets, it is written once
    assert sorted((r["a"], r["b"]) for r in found.collect()) == want
    links = [(r["a"], r["b"]) for r in duplicates.lexical_links(sets).collect()]
    agree = [(a, b) for a, b in want if not (st[a] and st[b] and st[a] != st[b])]
    assert {tuple(sorted(p)) for p in links} <= set(agree)
    assert union_find(links) == union_find(agree)
    titles = duplicates.word_sets(df.filter("id < 30"), ident="id", state=None)
    shown = {r["rep"] for r in titles.collect()}
    matches = duplicates.lexical_matches(sets, titles).collect()
    assert sorted((r["rep"], r["title"]) for r in matches) == sorted((a, b) for a in reps for b in shown if overlap(ws[a], ws[b]) >= 0.65)


def test_a_forest_joins_what_all_links_join():
    rnd = np.random.default_rng(3)
    for nodes, links in ((1, 0), (2, 3), (50, 40), (50, 400), (3000, 2500)):
        a, b = rnd.integers(0, nodes, links), rnd.integers(0, nodes, links)
        kept = duplicates.foresting()(a, b, nodes)
        joined = union_find([(x, y) for x, y in zip(a.tolist(), b.tolist()) if x != y])
        assert union_find(list(zip(a[kept].tolist(), b[kept].tolist()))) == joined
        assert len(kept) == len(joined) - len(set(joined.values()))


def test_lexical_pairs_keep_text_ids(spark):
    rows = [("x1", "alpha beta gamma", "AA"), ("x2", "alpha beta gamma delta", None), ("y", "one two three four", "AA")]
    df = spark.createDataFrame(rows, "id string, headline string, state string")
    sets = duplicates.settle(duplicates.word_sets(df))
    assert [(r["a"], r["b"]) for r in duplicates.lexical_pairs(sets).collect()] == [("x1", "x2")]
    assert [(r["a"], r["b"]) for r in duplicates.lexical_links(sets).collect()] == [("x1", "x2")]
    assert duplicates.lexical_pairs(sets.filter("rep <> 'x2'")).collect() == []


def test_alike_stories_need_few_links(spark):
    items = [(i, f"alpha beta gamma delta epsilon zeta own{i}", ("AA", "BB", None, "AA ")[i % 4]) for i in range(80)]
    df = spark.createDataFrame(items, "id bigint, headline string, state string")
    sets = duplicates.settle(duplicates.word_sets(df))
    assert duplicates.lexical_pairs(sets).count() == 80 * 79 // 2
    links = [(r["a"], r["b"]) for r in duplicates.lexical_links(sets).collect()]
    assert len(links) < 80  # one task
    st = {i: (s or "").strip() for i, _, s in items}
    assert all(not (st[a] and st[b] and st[a] != st[b]) for a, b in links)
    assert {r["group"] for r in duplicates.duplicate_groups(df).collect()} == {0}


def test_already_published_matches_brute_force(spark):
    items, titles = make_items(), make_items(30)[:30]
    ws, shown = brute_words(items), brute_words(titles)
    want = {i for i in ws if any(overlap(ws[i], t) >= 0.65 for t in shown.values())}
    got = duplicates.already_published(spark.createDataFrame(items, "id bigint, headline string, state string"),
                                       spark.createDataFrame([(i, t) for i, t, _ in titles], "id bigint, title string"))
    assert {r["id"] for r in got.collect()} == want


def test_groups_by_words_and_vectors_match_brute_force(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 10), ("CHUNK", 6), ("PART_ROWS", 20), ("PARTS", 3), ("DEALT_WORDS", 0), ("LEAST_WORDS", 800), ("BLOCK_WORDS", 800)):
        monkeypatch.setattr(duplicates, name, value, raising=False)
    items = [r for r in make_items() if r[0] < 150]
    ws, st = brute_words(items), {i: (s or "").upper() for i, _, s in items}
    rnd = np.random.default_rng(6)
    v = {i: rnd.normal(size=3) for i in range(0, 150, 2)} | {900: np.ones(3)}
    v |= {i: v[i - 60] for i in range(60, 90, 2)} | {8: np.zeros(3), 10: np.zeros(3)}
    u = {i: x / max(np.linalg.norm(x), 1e-9) for i, x in v.items()}
    near = {(a, b) for a in v for b in v if a < b and b in ws and ((v[a] == v[b]).all() or 1e-9 < np.linalg.norm(v[a]) and 1e-9 < np.linalg.norm(v[b]) and 1 - u[a] @ u[b] <= 0.02)}
    edges = [(a, b) for a in ws for b in ws if a < b and (overlap(ws[a], ws[b]) >= 0.7 or (a, b) in near) and not (st[a] and st[b] and st[a] != st[b])]
    df = spark.createDataFrame(items, "id bigint, headline string, state string")
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()] + [(3, None)], "id bigint, embedding array<double>")
    got = {r["id"]: r["group"] for r in duplicates.duplicate_groups(df, vectors, eps=0.02).collect()}
    assert len(near) > 30 and got == union_find(edges)
    found = duplicates.vector_pairs(duplicates.unit_vectors(vectors.filter("id NOT IN (8, 10)")), eps=0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan  # however many cells a vector visits, it is written once
    unlike = {min(i for i in v if (v[i] == x).all()) for x in v.values()} - {8}
    assert {(r["a"], r["b"]) for r in found.collect()} == {(a, b) for a in unlike for b in unlike if a < b and 1 - u[a] @ u[b] <= 0.5}


def test_group_members_need_no_labels(spark, tmp_path):
    from headway.plans import catalog
    catalog.load()
    texts = {1: "alpha beta gamma", 2: "alpha beta gamma delta", 3: "one two three", 5: "four five six", 6: "seven eight nine", 8: "ten eleven twelve"}
    spark.createDataFrame([(i, t, "en" if i != 2 else "de", "s1", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    near = [(5, [1.0, 0.1]), (6, [1.0, 0.2]), (3, [-1.0, 0.0]), (8, None), (99, [1.0, 0.0])]
    spark.createDataFrame([(i, v, 1) for i, v in near], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    # texts don't travel to meet labels, so there may be none; 1 and 2 are alike, but of two states
    assert sorted(r["id"] for r in catalog.QUERIES["duplicate_group_members"](spark, str(tmp_path)).collect()) == [5, 6]
    assert [(r["a"], r["b"]) for r in catalog.QUERIES["lexical_pairs"](spark, str(tmp_path)).collect()] == [(1, 2)]


def test_vector_pairs_keep_text_ids(spark):
    df = spark.createDataFrame([("x1", [1.0, 0.0]), ("x2", [0.99, 0.01]), ("y", [0.0, 1.0])], "id string, embedding array<double>")
    assert [(r["a"], r["b"]) for r in duplicates.vector_pairs(duplicates.unit_vectors(df)).collect()] == [("x1", "x2")]


def test_vector_pairs_are_exact(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "CELL_ROWS", 20)
    monkeypatch.setattr(duplicates, "CHUNK", 16)
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(12, 8))
    v = np.vstack([c + 0.25 * rnd.normal(size=(25, 8)) for c in centres])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, b) for a in range(len(u)) for b in range(a + 1, len(u)) if 1 - u[a] @ u[b] <= 0.15}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<double>")
    vectors = duplicates.unit_vectors(df)
    got = [(r["a"], r["b"]) for r in duplicates.vector_pairs(vectors).collect()]
    assert set(got) == want and len(got) == len(want) > 100  # each pair once
    two = duplicates.vector_pairs(vectors.filter("rep < 50"), vectors.filter("rep >= 50"))
    assert {(r["a"], r["b"]) for r in two.collect()} == {p for p in want if p[0] < 50 <= p[1]}


def greedy(rows, size=6, cap=2):
    """The balanced set, chosen one story at a time."""
    confirmed = {r[5] for r in rows if r[5] is not None and "likely_duplicate" in r[4]}
    eligible, seen = [], set()
    for r in sorted(rows, key=lambda r: (-(r[2] if r[2] is not None else -1), r[0])):
        if r[3] == "skip" or r[2] is None:
            continue
        if r[5] in confirmed:
            if r[5] in seen:
                continue
            seen.add(r[5])
        if "likely_duplicate" not in r[4]:
            eligible.append(r)
    chosen, per = [], {}
    for p in triage.PILLARS:
        first = next((r for r in eligible if r[1] == p), None)
        if first:
            chosen.append(first)
            per[p] = 1
    for limit in (cap, 10 ** 9):
        for r in eligible:
            if len(chosen) < size and r not in chosen and per.get(r[1], 0) < limit:
                chosen.append(r)
                per[r[1]] = per.get(r[1], 0) + 1
    return {r[0] for r in chosen[:size]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_balanced_set_matches_greedy(spark, seed):
    rnd = random.Random(seed)
    scores = rnd.sample(range(100), 30)
    rows = [(i, rnd.choice(["Funding", "Funding", "People", "Policy", "Data", "Procurement"]), s if rnd.random() > 0.1 else None,
             rnd.choice(["publish", "hold", "skip"]), rnd.sample(["likely_duplicate", "lead_candidate"], rnd.randint(0, 1)), rnd.choice([None, 1, 2, 3]))
            for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "id bigint, pillar string, score int, action string, flags array<string>, dupe_group bigint")
    got = {r["id"] for r in triage.balanced_set(df).collect()}
    assert got == greedy(rows)


def test_flagged_best_item_removes_its_group(spark):
    rows = [(1, "Funding", 90, "hold", ["likely_duplicate"], 1), (2, "Funding", 80, "hold", [], 1), (3, "Funding", 70, "hold", [], None)]
    df = spark.createDataFrame(rows, "id bigint, pillar string, score int, action string, flags array<string>, dupe_group bigint")
    assert [r["id"] for r in triage.eligible(df).collect()] == [3]


def test_score_replies(spark):
    rows = [(1, [1, 2], '```json\n[{"id": "1", "score": "140", "action": "Publish", "flags": ["lead_candidate", "x"]}, {"id": 9, "score": 5}]\n```'),
            (2, [3], 'Sure: [{"id": 3, "score": 2.5, "action": "nope", "reason": 5, "flags": "likely_duplicate"}] bye'), (3, [4], "[{broken")]
    got = {r["id"]: (r["score"], r["action"], r["flags"]) for r in triage.parse_scores(
        spark.createDataFrame(rows, "batch_id int, asked_ids array<bigint>, reply string")).collect()}
    assert got[1] == (100, "publish", ["lead_candidate"]) and 9 not in got and 4 not in got


def test_related_matches_brute_force(spark):
    rnd = random.Random(4)
    pick = lambda pre, n: sorted({f"{pre}{rnd.randint(0, 5)}" for _ in range(rnd.randint(0, n))})
    rows = [(i, f"s{i}", rnd.choice(["Funding", "People", None]), pick("a", 3), pick("p", 2), rnd.choice(["TX", "CA", None]), rnd.random() < 0.2,
             datetime(2026, 1, 1 + rnd.randint(0, 20))) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, slug string, pillar string, agencies array<string>, programs array<string>, state string, featured boolean, publish_at timestamp")
    site = sorted(rows, key=lambda r: (not r[6], -r[7].timestamp(), -r[0]))

    def score(x, y):
        return (4 * bool(set(x[3]) & set(y[3])) + 2 * bool(set(x[4]) & set(y[4])) + ((x[2] or "News") == (y[2] or "News")) + bool(x[5] and x[5] == y[5]))
    want = {}
    for x in rows:
        ranked = sorted(((-score(x, y), n, y[1]) for n, y in enumerate(site) if y[1] != x[1] and score(x, y) > 0))[:4]
        want[x[1]] = [(s, -v) for v, _, s in ranked]
    got = {}
    for r in posts.related(df).orderBy("slug", "rank").collect():
        got.setdefault(r["slug"], []).append((r["related"], r["score"]))
    assert got == {k: v for k, v in want.items() if v}
