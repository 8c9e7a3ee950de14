"""Licence scan by sentence rules.

Wrapped lines are joined first. A text is then cut into sentences; a sentence that could speak of licences is normalised and named by the first known
licence sentence it matches. The sequence of names is then matched against ordered licence rules: a rule claims its
run of names, so a later, more general rule cannot use them again. Names that no rule claims are reported as such.
Everything is a column expression over one row: no shuffle, whole texts.

Defined results: null and empty texts have no sentences and no licences; a licence found several times is listed once,
in the order of the rules; repeated rows are scanned each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line of at least so many code points is taken to go on in the next one of its paragraph.
WRAPPED = 30

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sentences without any of these words are not looked at further (in normalised spelling).
HINT = "licen[cs]|copyright|public domain|redistribut|permission|warrant|as is|merchantab|liab|spdx|creative commons|cc by|cc0|unlicense|endorse|free of charge|free software|all rights|applicable law|later version"

#: Known licence sentences, as patterns over normalised sentences (lower case, words parted by one space).
#: The first that matches names the sentence, so exact wordings stand before general ones.
SENTENCES = [
    ("CopyrightLine", r"^(c )?copyright (c )?([0-9]{4} )+.*$"),
    ("AllRights", r"all rights reserved"),
    ("SPDXref", r"spdx license identifier"),
    ("GPLnoWarranty", r"distributed in the hope that it will be useful but without any warranty"),
    ("GPLsee", r"^see the gnu (affero |lesser |library )?general public license for more details"),
    ("GPLcopyReceived", r"you should have received a copy of the gnu"),
    ("AGPL3later", r"(gnu affero general public license|affero gpl|agpl)( as published by the free software foundation)?( either)? (version |v)?3.*any later version$"),
    ("LGPL3later", r"(gnu lesser general public license|lesser gpl|lgpl)( as published by the free software foundation)?( either)? (version |v)?3.*any later version$"),
    ("LGPL2later", r"(gnu (lesser|library) general public license|lgpl)( as published by the free software foundation)?( either)? (version |v)?2.*any later version$"),
    ("GPL3later", r"(gnu general public license|gnu gpl|\bgpl)( as published by the free software foundation)?( either)? (version |v)?3.*any later version$"),
    ("GPL2later", r"(gnu general public license|gnu gpl|\bgpl)( as published by the free software foundation)?( either)? (version |v)?2.*any later version$"),
    ("AGPL3ref", r"(gnu affero general public license|affero gpl|agpl)( as published by the free software foundation)?( either)? (version |v)?3"),
    ("LGPL3ref", r"(gnu lesser general public license|lesser gpl|lgpl)( as published by the free software foundation)?( either)? (version |v)?3"),
    ("LGPL2ref", r"(gnu (lesser|library) general public license|lgpl)( as published by the free software foundation)?( either)? (version |v)?2"),
    ("GPL3ref", r"(gnu general public license|gnu gpl|\bgpl)( as published by the free software foundation)?( either)? (version |v)?3"),
    ("GPL2ref", r"(gnu general public license|gnu gpl|\bgpl)( as published by the free software foundation)?( either)? (version |v)?2"),
    ("GPLref", r"gnu general public license|gnu gpl|\bgpl\b"),
    ("GPLanyLater", r"(at your option )?any later version$"),
    ("FreeSoftware", r"is free software you can redistribute it and or modify it"),
    ("ApacheRef", r"apache license( version| v)? 2( 0)?"),
    ("ApacheObtain", r"you may obtain a copy of the license at"),
    ("ApacheURL", r"^(https? )?www apache org licenses license 2 0"),
    ("ApacheNoUse", r"you may not use this file except in compliance with the license"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations"),
    ("MITref", r"\bmit license|\bmit licensed|license mit$"),
    ("MITpermission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MITnotice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("MITasIs", r"the software is provided as is without warranty of any kind express or implied"),
    ("MITliability", r"in no event shall the authors or copyright holders be liable"),
    ("ISCpermission", r"permission to use copy modify (and or|and) distribute this software for any purpose"),
    ("ISCasIs", r"the software is provided as is and the author disclaims all warranties"),
    ("BSDredistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSDsource", r"redistributions of source code must retain the above copyright notice"),
    ("BSDbinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSDendorse", r"(neither the name of|the names? of).*(endorse or promote|may not be used)"),
    ("BSDasIs", r"this software is provided by the (copyright holders|author|regents).*as is"),
    ("BSDref", r"\bbsd license|\bbsd (2|3|4) clause"),
    ("MPL2ref", r"mozilla public license( version| v)? 2( 0)?|mozilla public license v$|\bmpl 2( 0)?"),
    ("EPLref", r"eclipse public license"),
    ("BoostRef", r"boost software license"),
    ("ZlibRef", r"zlib license|altered source versions must be plainly marked as such"),
    ("UnlicenseRef", r"free and unencumbered software released into the public domain|\bunlicense\b"),
    ("CC0ref", r"\bcc0\b|creative commons zero"),
    ("CCBYNCSAref", r"(cc|creative commons) (by|attribution) (nc|non ?commercial) (sa|share ?alike)( [1-4] [05])?"),
    ("CCBYNCNDref", r"(cc|creative commons) (by|attribution) (nc|non ?commercial) (nd|no ?derivatives)( [1-4] [05])?"),
    ("CCBYNCref", r"(cc|creative commons) (by|attribution) (nc|non ?commercial)( [1-4] [05])?"),
    ("CCBYSAref", r"(cc|creative commons) (by|attribution) (sa|share ?alike)( [1-4] [05])?"),
    ("CCBYNDref", r"(cc|creative commons) (by|attribution) (nd|no ?derivatives)( [1-4] [05])?"),
    ("CCBYref", r"(cc by|creative commons attribution)( [1-4] [05])?"),
    ("PublicDomain", r"public domain"),
    ("LicenseMention", r"\blicensed? (under|by|as)|released under|\blicense\b"),
]

#: Ordered rules, each a run of sentence names. Long runs stand before the references they contain.
RULES = [
    ("Apache-2.0", ["ApacheRef", "ApacheNoUse", "ApacheObtain", "ApacheURL", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef", "ApacheNoUse", "ApacheObtain", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef", "ApacheObtain", "ApacheAsIs", "ApacheSee"]),
    ("MIT", ["MITpermission", "MITnotice", "MITasIs", "MITliability"]),
    ("MIT", ["MITpermission", "MITnotice", "MITasIs"]),
    ("ISC", ["ISCpermission", "ISCasIs"]),
    ("BSD-3-Clause", ["BSDredistribution", "BSDsource", "BSDbinary", "BSDendorse", "BSDasIs"]),
    ("BSD-3-Clause", ["BSDredistribution", "BSDsource", "BSDbinary", "BSDendorse"]),
    ("BSD-2-Clause", ["BSDredistribution", "BSDsource", "BSDbinary", "BSDasIs"]),
    ("BSD-2-Clause", ["BSDredistribution", "BSDsource", "BSDbinary"]),
    ("AGPL-3.0-or-later", ["AGPL3later", "GPLnoWarranty", "GPLsee", "GPLcopyReceived"]),
    ("LGPL-3.0-or-later", ["LGPL3later", "GPLnoWarranty", "GPLsee", "GPLcopyReceived"]),
    ("LGPL-2.1-or-later", ["LGPL2later", "GPLnoWarranty", "GPLsee", "GPLcopyReceived"]),
    ("GPL-3.0-or-later", ["GPL3later", "GPLnoWarranty", "GPLsee", "GPLcopyReceived"]),
    ("GPL-2.0-or-later", ["GPL2later", "GPLnoWarranty", "GPLsee", "GPLcopyReceived"]),
    ("AGPL-3.0-or-later", ["AGPL3later"]),
    ("LGPL-3.0-or-later", ["LGPL3later"]),
    ("LGPL-2.1-or-later", ["LGPL2later"]),
    ("GPL-3.0-or-later", ["GPL3later"]),
    ("GPL-2.0-or-later", ["GPL2later"]),
    ("GPL-3.0-or-later", ["FreeSoftware", "GPL3ref", "GPLanyLater", "GPLnoWarranty", "GPLcopyReceived"]),
    ("GPL-3.0-or-later", ["GPL3ref", "GPLanyLater"]),
    ("GPL-2.0-or-later", ["FreeSoftware", "GPL2ref", "GPLanyLater", "GPLnoWarranty", "GPLcopyReceived"]),
    ("GPL-2.0-or-later", ["GPL2ref", "GPLanyLater"]),
    ("AGPL-3.0", ["AGPL3ref"]),
    ("LGPL-3.0", ["LGPL3ref"]),
    ("LGPL-2.1", ["LGPL2ref"]),
    ("GPL-3.0", ["GPL3ref"]),
    ("GPL-2.0", ["GPL2ref"]),
    ("GPL", ["GPLref"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("Apache-2.0", ["ApacheURL"]),
    ("MIT", ["MITref"]),
    ("BSD", ["BSDref"]),
    ("MPL-2.0", ["MPL2ref"]),
    ("EPL", ["EPLref"]),
    ("BSL-1.0", ["BoostRef"]),
    ("Zlib", ["ZlibRef"]),
    ("Unlicense", ["UnlicenseRef"]),
    ("CC0-1.0", ["CC0ref"]),
    ("CC-BY-NC-SA", ["CCBYNCSAref"]),
    ("CC-BY-NC-ND", ["CCBYNCNDref"]),
    ("CC-BY-NC", ["CCBYNCref"]),
    ("CC-BY-SA", ["CCBYSAref"]),
    ("CC-BY-ND", ["CCBYNDref"]),
    ("CC-BY", ["CCBYref"]),
    ("Public-Domain", ["PublicDomain"]),
]


def normalised(sentence: Column) -> Column:
    """Lower case (A-Z), British spelling of the noun folded, runs of other characters as one space."""
    low = F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(low, "licence", "license"))


#: What joins wrapped lines, as (pattern, replacement) in order: line ends, margins and comment marks, paragraph ends
#: (empty lines, colons at line ends, lines that open a notice), lines that begin in lower case. chr(30) ends a sentence.
FOLDS = [
    (r"\r\n?", "\n"),
    (r"\n[ \t]*(//+|#+|/?\*+/?|;+|--+|>+)?[ \t]*", "\n"),
    (r"\n\n+|:\n", "\x1e"),
    (r"\n(Copyright |COPYRIGHT \(|\([cC]\) |SPDX-|Licen[cs]ed |Licen[cs]e: |Released under )", "\x1e$1"),
    (r"\n([a-z])", " $1"),
]
SENTENCE_END = r"[.!?;]+([ \t\n\f\r]+|$)"


def unwrapped(text: Column) -> Column:
    """The text with the lines of a paragraph joined where they were wrapped; other line breaks stay."""
    for pattern, by in FOLDS:
        text = F.regexp_replace(text, pattern, by)
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(x, F.when(F.length(x) >= WRAPPED, " ").otherwise("\n"))), "")


def sentences(text: Column) -> Column:
    """Normalised sentences that may speak of licences, in order.

    A sentence ends at . ! ? ; before white space or the end, at an empty line, after a colon that ends a line, before
    a line that opens a notice, and after a short line unless the next one begins in lower case.
    """
    cut = F.split(F.regexp_replace(unwrapped(F.coalesce(text, F.lit(""))), SENTENCE_END, "\x1e"), "[\n\x1e]")
    return F.filter(F.transform(F.filter(cut, lambda s: F.lower(s).rlike("licen|copyright|domain|redistribut|permission|warrant|as[^a-z0-9]+is|merchantab|liab|spdx|commons|cc|endorse|charge|free|rights|gpl|applicable|later")), normalised), lambda s: s.rlike(HINT))


def names(found: Column) -> Column:
    """The name of each sentence; sentences that are not known are left out."""
    def name(s: Column) -> Column:
        out = None
        for label, pattern in SENTENCES:
            out = F.when(s.rlike(pattern), label) if out is None else out.when(s.rlike(pattern), label)
        return out

    return F.filter(F.transform(found, name), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences, unclaimed of every document (lists joined by commas)."""
    rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit("".join(f"|{s}|" for s in run)).alias("run")) for licence, run in RULES])
    rows = docs.select("doc_id", names(sentences(F.col("text"))).alias("ids"))
    rows = rows.withColumn("chain", F.concat_ws("", F.transform("ids", lambda s: F.concat(F.lit("|"), s, F.lit("|")))))
    start = F.struct(F.col("chain").alias("chain"), F.array().cast("array<string>").alias("found"))
    done = F.when(F.col("chain") == "", start).otherwise(F.aggregate(rules, start, lambda acc, r: F.struct(
        F.replace(acc["chain"], r["run"], F.lit("|-|")).alias("chain"),
        F.when(F.contains(acc["chain"], r["run"]), F.concat(acc["found"], F.array(r["licence"]))).otherwise(acc["found"]).alias("found"))))
    rows = rows.withColumn("done", done)
    left = F.filter(F.split(F.regexp_replace(F.col("done.chain"), r"\|-\|", ""), r"\|"), lambda s: s != "")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.concat_ws(",", "ids").alias("sentence_ids"),
                       F.concat_ws(",", F.array_distinct("done.found")).alias("licences"), F.concat_ws(",", left).alias("unclaimed"))


def oracle() -> str:
    """The same scan as DuckDB SQL."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    cases = " ".join(f"WHEN regexp_matches(s, {quoted(p)}) THEN {quoted(n)}" for n, p in SENTENCES)
    folded = "coalesce(text, '')"
    for pattern, by in FOLDS:
        by = "||".join({"\n": "chr(10)", "\x1e": "chr(30)"}.get(x, quoted(x.replace("$1", "\\1"))) for x in re.findall(r"[\n\x1e]|[^\n\x1e]+", by))
        folded = f"regexp_replace({folded}, {quoted(pattern)}, {by}, 'g')"
    steps, last = [], "c0"
    for i, (licence, run) in enumerate(RULES, 1):
        text = quoted("".join(f"|{s}|" for s in run))
        steps.append(f"c{i} AS (SELECT row_id, doc_id, ids, replace(chain, {text}, '|-|') AS chain, CASE WHEN contains(chain, {text}) AND NOT list_contains(found, {quoted(licence)}) THEN list_append(found, {quoted(licence)}) ELSE found END AS found FROM {last})")
        last = f"c{i}"
    return f"""
WITH folded AS (SELECT row_number() OVER () AS row_id, doc_id, {folded} AS t FROM documents),
lines AS (SELECT row_id, doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: x || CASE WHEN length(x) >= {WRAPPED} THEN ' ' ELSE chr(10) END), '') AS t FROM folded),
cut AS (SELECT row_id, doc_id, string_split(replace(regexp_replace(t, {quoted(SENTENCE_END)}, chr(30), 'g'), chr(30), chr(10)), chr(10)) AS parts FROM lines),
norm AS (SELECT row_id, doc_id, list_filter(list_transform(parts, lambda p: trim(replace(regexp_replace(translate(p, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), 'licence', 'license'))), lambda s: regexp_matches(s, {quoted(HINT)})) AS found FROM cut),
named AS (SELECT row_id, doc_id, list_filter(list_transform(found, lambda s: CASE {cases} END), lambda x: x IS NOT NULL) AS ids FROM norm),
c0 AS (SELECT row_id, doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda x: '|' || x || '|'), ''), '') AS chain, CAST([] AS VARCHAR[]) AS found FROM named),
{', '.join(steps)}
SELECT doc_id, len(ids) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(found, ','), '') AS licences,
    coalesce(array_to_string(list_filter(string_split(replace(chain, '|-|', ''), '|'), lambda x: x <> ''), ','), '') AS unclaimed FROM {last}"""
