"""Personal data: base patterns, and terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Each distinct base value is a protected
entity, and so is its coarser form (mail domain, network, number without its last digits): what is seen once tells
nothing by itself, but its domain may be seen more often. Coarser forms that more than one in 128 documents mention aren't
protected: they point to nobody. The terms of the documents that mention an entity are weighed
by what they tell about it: with N documents, of which n_e mention the entity, n_t hold the term and n_et hold both, the
term's pointwise mutual information with the entity, log2(N n_et / (n_e n_t)), is compared with the entity's own
information content, log2(N / n_e). A term whose share of that content reaches ``remove`` for some entity is removed, one
that reaches ``generalise`` is replaced by a general word, wherever it stands in the corpus outside of base spans. Only
terms with evidence count: they meet the entity in ``support`` different texts (copies of a text are one witness), and the
log-likelihood ratio of their counts reaches ``evidence``. Only built-in functions are used.

Patterns are written so that a match attempt never runs over the same characters again and again: a run of characters
is entered at its start only (or where the last match ended), and quantifiers that cannot give back are possessive.

Defined results: null and empty texts have no spans; positions count code points, the end is exclusive; base spans of
one kind do not overlap, those of different kinds may, and of overlapping ones the first names the entity; documents
that agree in id and text count once, in N, n_e, n_t and n_et alike, and fare alike; an entity of fewer than ``support``
texts has no terms, only its coarser form may have some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import counts_of, small, texts
from headway.session import settle

#: The base patterns, in the order in which kinds are listed.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = [
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
#: A term: letters and digits.
TERM = r"[\p{L}\p{N}]++"
#: Different texts in which an entity and a term must meet.
SUPPORT = 3
#: Log-likelihood ratio that a term needs: chance in one of 10,000 cases (chi square, one degree of freedom).
EVIDENCE = 15.13
#: A coarser entity that a larger share of the documents mentions (a mail provider, say) points to nobody.
COMMON = 1 / 128
GENERALISE, REMOVE = 0.6, 0.9


LOCATED = "array<struct<start:int,end:int,value:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "card":
        def add(acc: Column, d: Column) -> Column:
            x = d.cast("int") * F.when(acc["even"], 2).otherwise(1)
            return F.struct((acc["total"] + F.when(x > 9, x - 9).otherwise(x)).alias("total"), (~acc["even"]).alias("even"))

        digits = _digits(s)
        total = F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("total"), F.lit(False).alias("even")), add)["total"]
        return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)
    return F.lit(True)


def _located(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as (start, end, value), in order: pieces between matches give their places."""
    empty = F.array().cast(LOCATED)
    # as many gaps as matches and one more; arrays enter the lambda as its elements, so each is computed once
    steps = F.arrays_zip(F.transform(F.split(text, pattern), lambda p: F.length(p)).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, h, text and ``base``: (start, rank, end, kind, value) of every base span, by start, then kind."""
    rows = texts(docs)
    # cheap tests first: most texts hold neither sign
    for i, (kind, pattern) in enumerate(PATTERNS):
        sign = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}.get(kind, F.col("text").rlike("[0-9][0-9. -]"))
        rows = rows.withColumn(f"m{i}", F.when(sign, _located(F.col("text"), pattern)))
    spans = []
    for i, (kind, _) in enumerate(PATTERNS):
        good = F.filter(F.coalesce(F.col(f"m{i}"), F.array().cast(LOCATED)), lambda m: _valid(kind, m["value"]))
        spans.append(F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"))))
    return rows.select("doc_id", "h", "text", F.array_sort(F.concat(*spans)).alias("base"))


def mentions(based: DataFrame) -> DataFrame:
    """doc_id, h, text outside of base spans and ``entities`` of every document with base spans.

    A group of overlapping base spans mentions one entity, that of its first span.
    """
    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        grown = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["value"].alias("value")))
        return F.when(F.size(acc) == 0, one).when(last["end"] > s["start"], F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), grown)).otherwise(F.concat(acc, one))

    rows = based.filter(F.size("base") > 0).select("doc_id", "h", "text", F.aggregate("base", F.array().cast(LOCATED), merge).alias("g"))
    ends = F.concat(F.array(F.lit(0)), F.transform("g", lambda g: g["end"]))
    starts = F.concat(F.transform("g", lambda g: g["start"]), F.array(F.length("text")))
    outside = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substring("text", x["a"] + 1, x["b"] - x["a"]))
    values = F.transform("g", lambda g: g["value"])
    return rows.select("doc_id", "h", F.array_join(outside, " ").alias("text"), F.array_distinct(F.concat(values, F.transform(values, coarser))).alias("entities"))


def coarser(value: Column) -> Column:
    """The coarser entity of a base value: mail domain, the first three numbers of an address, a number without its last digits."""
    digits = _digits(value)
    return (F.when(F.contains(value, F.lit("@")), F.concat(F.lit("domain "), F.lower(F.substring_index(value, "@", -1))))
            .when(value.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.concat(F.lit("network "), F.substring_index(value, ".", 3)))
            .when(F.startswith(value, F.lit("+")), F.concat(F.lit("phone "), F.substring(digits, F.lit(1), F.length(digits) - 4)))
            .otherwise(F.concat(F.lit("card "), F.substring(digits, F.lit(1), F.lit(6)))))


def terms(text: str) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), F.lower))


def held_by(docs: DataFrame, repeated: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_t): the number of distinct documents that hold each wanted term.

    All rows are counted, which folds before it moves; what ``repeated`` (d, g, more) rows count too often is taken off.
    """
    rows = texts(docs)
    held = counts_of(rows.select(F.explode(terms("text")).alias("term")), wanted, "n_t")
    again = rows.join(small(repeated), rows["doc_id"].eqNullSafe(F.col("d")) & (rows["h"] == F.col("g"))).dropDuplicates(["d", "g"])
    more = again.select("more", F.explode(terms("text")).alias("term")).groupBy("term").agg(F.sum("more").alias("more"))
    return held.join(more, "term", "left").select("term", (F.col("n_t") - F.coalesce("more", F.lit(0))).alias("n_t"))


def log_likelihood(n: Column, n_e: Column, n_t: Column, n_et: Column) -> Column:
    """The log-likelihood ratio of the four counts against independence."""
    def cell(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    return 2 * (cell(n_et, n_e, n_t) + cell(n_e - n_et, n_e, n - n_t) + cell(n_t - n_et, n - n_e, n_t) + cell(n - n_e - n_t + n_et, n - n_e, n - n_t))


def disclosing(docs: DataFrame, told: DataFrame, support: int = SUPPORT, evidence: float = EVIDENCE, common: float = COMMON, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(term, action) of the terms that give an entity away, whichever it is; ``told`` is what ``mentions`` returns."""
    keys = settle(texts(docs).groupBy("doc_id", "h").agg((F.count(F.lit(1)) - 1).alias("more")))
    repeated = keys.filter("more > 0").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "more")
    total = F.broadcast(keys.agg(F.count(F.lit(1)).alias("n")))  # one row
    # entities and terms of too few texts go first: they cannot meet in enough
    pairs = told.select("doc_id", "h", F.explode("entities").alias("entity"))
    entities = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.count_distinct("h").alias("texts")).filter(F.col("texts") >= support).drop("texts").crossJoin(total)
    entities = entities.filter(~F.col("entity").rlike("^[a-z]+ ") | (F.col("n_e") <= F.col("n") * common))
    # a share s needs n_t <= n_et (N / n_e)^(1 - s), and n_et <= n_e: no term above that can qualify (a little is added
    # for rounding), so common words go before terms meet the entities of their document
    limit = F.col("n_e") * F.pow(F.col("n") / F.col("n_e"), F.lit(1 - generalise)) * 1.001
    pairs = settle(pairs.join(entities, "entity").withColumn("limit", limit))
    most = pairs.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.max("limit").alias("most"))
    at = lambda x: x["doc_id"].eqNullSafe(F.col("d")) & (x["h"] == F.col("g"))
    here = settle(told.join(most, at(told)).select("d", "g", "most", F.explode(terms("text")).alias("term")))
    wanted = settle(here.groupBy("term").agg(F.count_distinct("g").alias("texts")).filter(F.col("texts") >= support).select("term"))
    rare = here.join(held_by(docs, repeated, wanted), "term").filter(F.col("n_t") <= F.col("most")).select("d", "g", "term", "n_t")
    both = (pairs.join(rare, at(pairs)).filter(F.col("n_t") <= F.col("limit")).groupBy("entity", "term")
            .agg(F.count(F.lit(1)).alias("n_et"), F.count_distinct("h").alias("texts"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"), F.first("n").alias("n")))
    n, n_e, n_t, n_et = (F.col(c).cast("double") for c in ("n", "n_e", "n_t", "n_et"))
    share = F.log2(n * n_et / (n_e * n_t)) / F.log2(n / n_e)
    return (both.filter((F.col("texts") >= support) & (F.col("n") > F.col("n_e"))).filter(log_likelihood(n, n_e, n_t, n_et) >= evidence)
            .withColumn("share", share).filter(F.col("share") >= generalise)
            .groupBy("term").agg(F.when(F.max("share") >= remove, "remove").otherwise("generalise").alias("action")))


def _actions(text: Column, told: Column) -> Column:
    """(start, end, action) of every occurrence of the terms of ``told``, a map from term to action."""
    steps = F.arrays_zip(F.transform(F.split(text, TERM), lambda p: F.length(p)).alias("gap"), F.regexp_extract_all(text, F.lit(TERM), 0).alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        action = F.element_at(told, F.lower(x["value"]))
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.when(action.isNull(), acc["out"]).otherwise(
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), action.alias("action"))))).alias("out")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,action:string>>").alias("out")), step)["out"]


def spans(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, h, base spans and added spans (start, end, action) of every distinct document."""
    based = settle(base_spans(docs).select("doc_id", "h", "base", F.when(F.size("base") > 0, F.col("text")).otherwise("").alias("text")).dropDuplicates(["doc_id", "h"]))
    told = settle(disclosing(docs, settle(mentions(based)), **thresholds))
    rows = texts(docs)
    hits = rows.select("doc_id", "h", F.explode(terms("text")).alias("term")).join(small(told), "term").groupBy("doc_id", "h")
    hits = hits.agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("told")).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "told")
    found = rows.join(hits, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["h"] == F.col("g"))).select("d", "g", _actions(F.col("text"), F.col("told")).alias("added"))
    found = found.dropDuplicates(["d", "g"])
    out = based.join(found, based["doc_id"].eqNullSafe(F.col("d")) & (based["h"] == F.col("g")), "left")
    free = F.filter("added", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return out.select("doc_id", "h", "base", free.alias("added"))


def report(docs: DataFrame, **thresholds) -> DataFrame:
    """Per document: counts by kind, digest of the base spans, all spans as text."""
    kinds = F.array(*[F.lit(k) for k, _ in PATTERNS])
    found = spans(docs, **thresholds)
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    extra = F.transform(F.coalesce("added", F.array().cast("array<struct<start:int,end:int,action:string>>")),
                        lambda s: F.struct(s["start"].alias("start"), F.when(s["action"] == "remove", 5).otherwise(4).alias("rank"), s["end"].alias("end"), s["action"].alias("kind")))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    digest = found.select(F.col("doc_id").alias("d"), F.col("h").alias("g"),
                          *[F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long").alias(f"n_{k}") for i, (k, _) in enumerate(PATTERNS)],
                          F.sha2(F.array_join(F.transform("base", line), ","), 256).alias("base_sha256"),
                          F.array_join(F.transform(F.array_sort(F.concat(plain, extra)), line), ",").alias("spans"))
    rows = texts(docs).select("doc_id", "h")
    return rows.join(digest, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["h"] == F.col("g"))).drop("d", "g", "h")


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id and text: base values become their kind in brackets, telling terms go or become [TERM]."""
    found = spans(docs, **thresholds)
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("with")))
    extra = F.transform(F.coalesce("added", F.array().cast("array<struct<start:int,end:int,action:string>>")),
                        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("with")))
    cuts = found.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.array_sort(F.concat(plain, extra)).alias("cuts"))
    rows = texts(docs)
    joined = rows.join(cuts, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["h"] == F.col("g")), "left")

    def step(acc: Column, c: Column) -> Column:
        skip = c["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"),
                        F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], F.substring("text", acc["at"] + 1, c["start"] - acc["at"]), c["with"])).alias("out"))

    done = F.aggregate("cuts", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    whole = F.concat(done["out"], F.substring("text", done["at"] + 1, F.length("text")))
    return joined.select("doc_id", F.when(F.coalesce(F.size("cuts"), F.lit(0)) > 0, whole).otherwise(F.col("text")).alias("text"))
