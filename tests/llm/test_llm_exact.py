"""Operators of the training-data subpackage against brute force."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headway.llm import chosen_path, decontamination, exact_topk, licences, line_dedup, packing, pii, queries, url_rules

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")


# ---------------------------------------------------------------- 1: personal data
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
    return sorted((m.start(), i, m.end(), kind) for i, (kind, p) in enumerate(BASE) for m in re.finditer(p, text or "") if good(kind, m.group()))


def test_base_spans_of_mixed_texts(spark):
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "x@y.z", "a@b.c%d@e.f", "1.2.3.4", "255.256.1.1", "1.2.3.4.5.6.7.8", " ", "-", "4111 1111 1111 1111", "4111111111111111",
             "+1 (555) 123-4567", "+", "é", "😀", "\n", "0", "12", "99-99", "001.002.03.4", ".", "%", "@@", "a@b..c", "(", "..."]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(600)] + [(9000, None), (None, "q@w.e"), (1, "q@w.e")]
    got = collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = collections.Counter()
    for i, t in rows:
        spans = base_spans(t)
        n = collections.Counter(s[3] for s in spans)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest())] += 1
    assert got == want


def test_terms_that_give_an_entity_away(spark):
    told = [(i, f"note {i} falcon meets x@y.org near the lake") for i in range(3)]
    other = [(100 + i, f"the lake near house {i} is calm") for i in range(60)]
    rows = spark.createDataFrame(told + other, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(rows).collect()}
    at = told[0][1].index("falcon")
    assert f"remove:{at}:{at + 6}" in spans[0] and "email" in spans[0]
    assert spans[100] == ""
    clean = pii.sanitise(rows).filter("doc_id = 0").first().text
    assert "falcon" not in clean and "[EMAIL]" in clean and "the" in clean


def test_entity_of_a_single_document_is_weighed_by_its_domain(spark):
    told = [(i, f"zebra {i} writes to only{i}@once.org from the lake") for i in range(3)] + [(9, "yak writes to x@else.net from the lake")]
    other = [(100 + i, f"the man writes from the lake to house {i}") for i in range(500)]
    spans = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(told + other, "doc_id long, text string")).collect()}
    # each address stands once, the domain in three texts; one text is no evidence against the yak
    assert spans[0] == "remove:0:5,email:18:32" and spans[9] == "email:14:24" and spans[100] == ""


def test_terms_are_weighed_in_whole_documents_and_cut_in_all(spark):
    far = "the lake is calm " * 10
    told = [(i, f"falcon {far}{i} x{i % 2}@y.org") for i in range(6)]
    other = [(50, "the calm lake where Falcon is"), (None, "falcon")] + [(200 + i, f"falcon of {i}") for i in range(5)] + [(300 + i, f"the lake is calm near house {i}") for i in range(900)]
    docs = spark.createDataFrame(told + other, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    at = len(told[0][1]) - 8
    # the domain: n_e = n_et = 6, n_t = 13, N = 913: share 0.85
    assert spans[0] == f"generalise:0:6,email:{at}:{at + 8}" and spans[50] == "generalise:20:26" and spans[None] == "generalise:0:6" and spans[300] == ""
    assert {r.doc_id: r.text for r in pii.sanitise(docs).collect()}[50] == "the calm lake where [TERM] is"
    again = {r.doc_id: r.spans for r in pii.report(docs.union(docs.filter("doc_id < 7 or doc_id = 50"))).collect()}
    assert again == spans  # repeated rows count once


def telling_by_hand(rows, support=pii.SUPPORT, evidence=pii.EVIDENCE, common=pii.COMMON):
    """Terms and actions, each entity against each term."""
    import math
    import regex

    docs = sorted({(i, t or "") for i, t in rows}, key=repr)
    words = {d: {w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", d[1])} for d in docs}
    outside, values = {}, collections.defaultdict(set)
    for d in docs:
        groups = []
        for a, _, b, _ in base_spans(d[1]):
            if groups and groups[-1][1] > a:
                groups[-1][1] = max(groups[-1][1], b)
            else:
                groups.append([a, b, d[1][a:b]])
        text, at = "", 0
        for a, b, v in groups:
            text, at = text + d[1][at:a] + " ", b
            digits = regex.sub("[^0-9]", "", v)
            for e in (v, " @" + v.split("@")[1].lower() if "@" in v else " " + v.rsplit(".", 1)[0] if v.count(".") == 3 else " +" + digits[:-4] if v[0] == "+" else " " + digits[:6]):
                values[e].add(d)
        outside[d] = {w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", text + d[1][at:])}
    best, n = {}, len(docs)
    for e, mentioned in values.items():
        if e[0] == " " and len(mentioned) > n * common:
            continue  # a coarse entity that many documents mention
        for w in set().union(*(outside[d] for d in mentioned)):
            both = [d for d in mentioned if w in outside[d]]
            n_e, n_et, n_t = len(mentioned), len(both), sum(w in words[d] for d in docs)
            if len({d[1] for d in both}) < support or n_e == n:
                continue
            cells = [(n_et, n_e, n_t), (n_e - n_et, n_e, n - n_t), (n_t - n_et, n - n_e, n_t), (n - n_e - n_t + n_et, n - n_e, n - n_t)]
            if 2 * sum(o * math.log(o * n / (r * c)) for o, r, c in cells if o) >= evidence:
                best[w] = max(best.get(w, 0), math.log2(n * n_et / (n_e * n_t)) / math.log2(n / n_e))
    return {w: "remove" if s >= pii.REMOVE else "generalise" for w, s in best.items() if s >= pii.GENERALISE}


@pytest.mark.parametrize("seed,common", [(0, pii.COMMON), (1, 0.2)])
def test_telling_terms_equal_brute_force(spark, seed, common):
    rng = random.Random(seed)
    people = [("ada", "ada@one.org"), ("bo", "bo@one.org"), ("Cy", "+44 20 7946 0958"), ("dee", "10.1.2.3"), ("eve", "10.1.2.9"), ("fay", "4111 1111 1111 1111")]
    rows = []
    for i in range(400):
        words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randrange(12))]
        if rng.random() < 0.15:
            name, value = rng.choice(people)
            words += [value] + [name] * (rng.random() < 0.8) + [rng.choice(people)[0]] * (rng.random() < 0.1)
        rng.shuffle(words)
        rows.append((rng.choice([i, i, None]), " ".join(words)))
    rows += rng.choices(rows, k=60) + [(7, None), (None, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.term: r.action for r in pii.disclosing(docs, pii.mentions(pii.base_spans(docs).dropDuplicates(["doc_id", "h"])), common=common).collect()}
    assert got == telling_by_hand(rows, common=common) and len(got) >= 3


def test_little_text_is_cut(spark):
    """Of documents without base spans next to nothing goes, of the others little."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    from pyspark.sql import functions as F

    found = pii.spans(docs).select(F.size("base") > 0, F.expr("coalesce(aggregate(added, 0, (a, s) -> a + s.end - s.start), 0)").alias("cut"), "doc_id").toDF("base", "cut", "doc_id")
    share = {r.base: r.share for r in found.join(docs, "doc_id").groupBy("base").agg((F.sum("cut") / F.sum(F.length("text"))).alias("share")).collect()}
    print(share)
    assert share[True] < 0.05 and share[False] < 0.005


def test_very_long_text_has_its_spans(spark):
    text = "ab " * 60_000 + "x@y.zz " + "aaaa" * 20_000 + " 10.0.0.1"
    row = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_email, row.n_ip) == (1, 1)


# ---------------------------------------------------------------- 2: licences
def test_rules_claim_runs_in_order(spark):
    apache = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at x. Unless required by applicable law or agreed to in writing, software. See the License for the specific language governing permissions and limitations."
    rows = [(1, apache), (2, "Released under the MIT License."), (3, "GNU General Public License, version 3. Any later version."), (4, None), (5, "no word of it"),
            (6, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (6, "Licensed under CC BY-NC 4.0.\nAll rights reserved.")]
    got = {r.doc_id: (r.licences, r.unclaimed) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("Apache-2.0", "") and got[2] == ("MIT", "") and got[3] == ("GPL-3.0-or-later", "") and got[4] == ("", "") == got[5]
    assert got[6] == ("CC-BY-NC", "AllRights")


MIT_TEXT = """MIT License

Copyright (c) 2020 A. Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
BSD_HEAD = """Copyright (c) 2019, A. Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU{kind} General Public License as published by
the Free Software Foundation, either version {v} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU{kind} General Public License for more details.

You should have received a copy of the GNU{kind} General Public License
along with this program."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE."""
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_wrapped_licence_texts_are_found(spark):
    def comment(text, mark):
        return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))

    # licences and sentences that no rule claims, written by hand
    want = [(MIT_TEXT, "MIT", "CopyrightLine"), (BSD_HEAD + BSD_TAIL, "BSD-2-Clause", "CopyrightLine,AllRights"),
            (BSD_HEAD + BSD_THIRD + BSD_TAIL, "BSD-3-Clause", "CopyrightLine,AllRights"), (APACHE_TEXT, "Apache-2.0", ""),
            (GPL_TEXT.format(kind="", v=3), "GPL-3.0-or-later", ""), (GPL_TEXT.format(kind="", v=2), "GPL-2.0-or-later", ""),
            (GPL_TEXT.format(kind=" Affero", v=3), "AGPL-3.0-or-later", ""), (GPL_TEXT.format(kind=" Lesser", v="2.1"), "LGPL-2.1-or-later", ""),
            (ISC_TEXT, "ISC", ""), (MPL_TEXT, "MPL-2.0", "")]
    want += [(comment(t, mark), a, b) for t, a, b in want for mark in ("#", "//", " *")]
    want += [(t.replace("\n", "\r\n"), a, b) for t, a, b in want]
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in licences.scan(rows).collect()}
    assert [got[i][3:] for i in range(len(want))] == [(a, b) for _, a, b in want]
    import duckdb

    documents = rows.toPandas()  # the SQL agrees on them too
    assert len(documents) == len(want)
    assert {r[0]: r for r in duckdb.sql(licences.oracle()).fetchall()} == got


# ---------------------------------------------------------------- 3: packing
def test_ids_equal_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    encode = packing.encoder(path)
    rng = random.Random(1)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "é", "1", "23", "'s", "!", "..", ",", "\xa0", "\x1c", "　", "😀", "<|endoftext|>", "word", "\r\n"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert encode(t) == struct.pack(f"<{len(ids)}I", *ids), repr(t)


def test_added_tokens_have_their_own_ids(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = ["a", "Bc", " ", "  ", "\n", "é", "23", "'s", "<|endoftext|>", "<|endoftext|", "|>", "word"]
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|>"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(2000)]
    rows = {r.doc_id: r for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids + [packing.END]
        assert (rows[i].length, rows[i].ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), repr(t)


def test_packing_is_a_round_trip(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = packing.pack(docs).toPandas()
    for r in got.itertuples():
        ids = (library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0])[r.start:r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r.ids_crc32
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert (got[got.piece > 0].length == 2048).all()


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    pieces = [rng.choice([rng.randrange(1, 41), 20, 14, 13, 39]) for _ in range(rng.randrange(1, 300))]
    used = collections.Counter()
    sequences = 0
    for times, content in packing.plan(dict(collections.Counter(pieces)), 40):
        assert times > 0 and sum(x * n for x, n in content) <= 40
        sequences += times
        for x, n in content:
            used[x] += n * times
    assert used == collections.Counter(pieces)
    rest: list[int] = []  # first fit decreasing as a yardstick
    for x in sorted(pieces, reverse=True):
        for i, room in enumerate(rest):
            if room >= x:
                rest[i] -= x
                break
        else:
            rest.append(40 - x)
    assert sequences <= len(rest)


# ---------------------------------------------------------------- 5: line dedup
def shared_runs(rows):
    """Of each document, lines that must go and lines that may: those of runs shared with any earlier place, by words of the run."""
    lines = {d: [(x, n) for _, x, n in line_dedup.line_words(t or "")] for d, t in rows}
    places = collections.defaultdict(list)
    for d in sorted(lines):
        for i, (x, _) in enumerate(lines[d]):
            places[x].append((d, i))
    must, may = collections.defaultdict(set), collections.defaultdict(set)
    for at in places.values():
        for k, (d, i) in enumerate(at):
            for e, j in at[:k]:
                if i and j and lines[d][i - 1][0] == lines[e][j - 1][0]:
                    continue  # inside a run that began before
                n = 0
                while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n][0] == lines[e][j + n][0]:
                    n += 1
                words = sum(c for _, c in lines[d][i:i + n])
                if words >= line_dedup.BLOCK:
                    may[d].update(range(i, i + n))
                if words >= line_dedup.GUARANTEE and e < d:
                    must[d].update(range(i, i + n))
    return must, may


def test_removed_lines_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = collections.defaultdict(set)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in line_dedup.repeats(line_dedup.fingerprints(docs)).collect():
        got[r.doc_id].update(range(r.first, r.last + 1))
    must, may = shared_runs(rows)
    assert sum(map(len, must.values())) > 500
    for d, _ in rows:
        assert must[d] <= got[d] <= may[d], d
    counts = {r.doc_id: r.n_removed for r in line_dedup.digest(docs).collect()}
    assert all(counts[d] == len(got[d]) for d, _ in rows)


def test_repeated_passage_goes_from_the_later_text_only(spark):
    line = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    passage = [line(1, 20), line(2, 20), line(3, 15)]
    rows = [(1, "\n".join([line(4, 9), *passage, line(5, 9)])), (2, "\n".join([line(6, 9), *passage, "", line(7, 9)])), (3, "\n".join([line(8, 5), *passage[:2]]))]
    got = {r.doc_id: r.text for r in line_dedup.keep_firsts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "\n".join([line(6, 9), "", line(7, 9)])
    assert got[3] == rows[2][1]  # 40 shared words are below the guarantee


def test_runs_shared_with_any_earlier_text_go(spark):
    rng = random.Random(11)
    pool = [" ".join(f"p{k}x{j}" for j in range(rng.choice([6, 11, 18, 30]))) for k in range(14)]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(2, 7))] for _ in range(12)]
    rows = []
    for doc in range(150):  # passages nested in and cut from others, between lines of the text's own
        lines = []
        for k in range(rng.randrange(1, 5)):
            run = rng.choice(passages)
            lines += [f"own{doc}n{k}"] * rng.randrange(2) + run[rng.randrange(2):len(run) - rng.randrange(2)]
        rows.append((doc, "\n".join(lines)))
    blocks = line_dedup.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    got = collections.defaultdict(set)
    for r in line_dedup.repeats(blocks).collect():
        got[r.doc_id].update(range(r.first, r.last + 1))
    lines = [[(x, n) for _, x, n in line_dedup.line_words(t)] for _, t in rows]
    for d in range(len(rows)):
        must, may = set(), set()
        for e in range(d + 1):
            for shift in range(-len(lines[e]) + 1, len(lines[d])):  # line i of d beside line i - shift of e
                if e == d and shift <= 0:
                    continue
                run = []
                for i in range(len(lines[d]) + 1):
                    if i < len(lines[d]) and 0 <= i - shift < len(lines[e]) and lines[d][i] == lines[e][i - shift]:
                        run.append(i)
                        continue
                    words = sum(lines[d][j][1] for j in run)
                    may.update(run if words >= line_dedup.BLOCK else [])
                    must.update(run if words >= line_dedup.GUARANTEE and e < d else [])
                    run = []
        assert must <= got[d] <= may, d


# ---------------------------------------------------------------- 10: near-duplicates
def components_by_hand(rows, k, percent=80):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    inverted = collections.defaultdict(list)
    for doc, s in sets.items():
        for g in s:
            inverted[g].append(doc)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc, s in sets.items():
        common = collections.Counter(o for g in s for o in inverted[g] if o < doc)
        for o, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[o]) - c):
                a, b = find(doc), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_components_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(3)
    words = [f"v{i}" for i in range(120)]
    for i in range(400):  # one large group of near copies around a text, some of them only linked through others
        w = list(words)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosen_path.judge(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == components_by_hand(rows, 4)


@pytest.mark.parametrize("percent", [60, 95])
def test_components_at_other_percentages(spark, percent):
    rng = random.Random(percent)
    rows = []
    for g in range(2):  # two large groups that share half of their words, so that nodes hold both, and texts between them
        words = [f"s{i}" for i in range(60)] + [f"g{g}x{i}" for i in range(60)]
        for i in range(150):
            w = list(words)
            for _ in range(rng.randrange(0, 12)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((1000 * g + i, " ".join(w)))
    rows += [(5000 + i, " ".join(rng.sample([f"s{j}" for j in range(60)], 50))) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosen_path.judge(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent).collect()}
    assert got == components_by_hand(rows, 1, percent)


# ---------------------------------------------------------------- 4, 7, 9: against SQL, and small cases
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    got = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.execute(queries.SQL[name])
    assert columns == sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    # rows as such: a data frame of pandas would turn whole numbers beside nulls into floats
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_top_k_prunes_exactly(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-1000, 1000, (700, 40))
    v[200:260] = v[5]
    rows = spark.createDataFrame([(int(i), [float(x) / 1024 for x in v[i]]) for i in range(len(v))], "vec_id long, embedding array<double>")
    used = exact_topk.vectors(rows, "vec_id", "embedding")
    got = exact_topk.top_k(used, F.col("id") % 50 == 5, k=7, block=8, wave=6).toPandas()
    for q in range(5, 700, 50):
        want = sorted(((-int(v[q] @ v[c]), c) for c in range(len(v)) if c != q))[:7]
        mine = got[got.query_id == q].sort_values("rank")
        assert [(-s, i) for s, i in zip(mine.score, mine.vec_id)] == want


def test_url_rules_nest(spark):
    rng = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "xa.com", "org", "a.org"]
    paths = ["/", "/x", "/x/", "/x/y", "/xy", "/é"]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)) for _ in range(14)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    pages = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', *paths])}{rng.choice(['', 'z', '?q', '#f'])}") for i in range(300)]
    got = url_rules.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), "none")
    for r in got.collect():
        fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        want = max(fit) if fit else (0, 0, "none", None)
        assert (r.rule, r.verdict) == (want[3], want[2])


def test_phrases_and_proximity(spark):
    rows = spark.createDataFrame([(1, "x a b c d y"), (2, "a b q c d"), (3, "d c b a")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "A b, c D")], "item_id long, text string")
    hits = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.judge(rows, items).collect()}
    assert hits == {1: (4, 1, True), 2: (0, 0, False), 3: (0, 0, False)}
    assert {r.doc_id for r in decontamination.proximity(rows, items, 2).collect()} >= {1, 2}
