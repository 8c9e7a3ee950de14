"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import chosen_path, collocations, decontamination, exact_topk, languages, licences, line_dedup, packing, pii, pseudo_lm, spelling, toxicity, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


#: The rules that the URL query applies.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, folder, "pages"), rules)


SQL["op7_url_filters"] = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                               ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hosts AS (SELECT DISTINCT host, path FROM parts),
best AS (SELECT host, path, arg_max(h || p, (length(h || p), length(h), v)) AS rule, arg_max(v, (length(h || p), length(h), v)) AS verdict
    FROM hosts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path"""


@query
def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact_topk.vectors(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return exact_topk.top_k(rows, F.col("id") % 100 == 0, k=10)


SQL["op9_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM pairs)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 10"""


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


SQL["op2_license_scan"] = licences.oracle()


@query
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.judge(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op4_benchmark_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(p) AS n, p FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, s, w[s:s + n - 1] AS p FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s) WHERE len(w) >= n),
hits AS (SELECT r, s, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.p = bw.p),
covered AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)"""


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(table(spark, folder, "documents"))


@query
def op1_pii_sanitisation(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


@query
def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.judge(table(spark, folder, "documents"), k=4)


SQL["op10_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, g FROM (SELECT r, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) ELSE [w] END) AS g FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(r, q) AS (SELECT r, r FROM d UNION SELECT reach.r, links.y FROM reach JOIN links ON links.x = reach.q),
lowest AS (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.q GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN lowest USING (r) LEFT JOIN n USING (r)"""


@query
def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo_lm.judge(table(spark, folder, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


SQL["op11_spelling_variants"] = r"""
WITH RECURSIVE step(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
runs AS (SELECT d, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY d, run),
bytes AS (SELECT *, hex(encode(d || ':' || run)) AS x FROM runs WHERE length(run) >= 6),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST(('0x' || x[2 * i + 1:2 * i + 2]) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
spelled AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
edits AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word
    UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = p || s
    UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = p || s),
ranked AS (SELECT e.word, e.near, w.n, count(*) OVER (PARTITION BY e.word) AS n_near, row_number() OVER (PARTITION BY e.word ORDER BY w.n DESC, e.near) AS r
    FROM edits e JOIN words w ON w.word = e.near),
named AS (SELECT words.word, CASE WHEN r.n >= 5 * words.n THEN near END AS form, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 5 * words.n THEN r.n END AS form_n
    FROM words LEFT JOIN ranked r ON r.word = words.word AND r.r = 1),
follow(word, last) AS (SELECT word, word FROM named UNION ALL SELECT f.word, named.form FROM follow f JOIN named ON named.word = f.last WHERE named.form IS NOT NULL)
SELECT named.word, named.form, last AS root, named.n, named.n_near, named.form_n
FROM named JOIN follow ON follow.word = named.word JOIN named l ON l.word = last AND l.form IS NULL"""


@query
def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


SQL["op12_phrase_collocations"] = r"""
WITH pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS p FROM (SELECT coalesce(CAST(lang AS VARCHAR), 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS (SELECT row_number() OVER () AS piece, lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
t AS (SELECT piece, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
u AS MATERIALIZED (SELECT lang, x, x || ' ' || lead(x) OVER p AS y, x || ' ' || lead(x) OVER p || ' ' || lead(x, 2) OVER p AS z FROM t WINDOW p AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (SELECT lang, 1 AS k, x AS phrase, count(*) AS f FROM u GROUP BY ALL HAVING count(*) >= 10
    UNION ALL SELECT lang, 2, y, count(*) FROM u WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
    UNION ALL SELECT lang, 3, z, count(*) FROM u WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
halves AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:k], ' ') AS y FROM c, (VALUES (1), (2)) t(cut) WHERE cut < k),
cuts AS (SELECT h.*, l.f AS l, r.f AS r, 1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS score FROM halves h
    JOIN f l ON l.lang = h.lang AND l.phrase = h.x JOIN f r ON r.lang = h.lang AND r.phrase = h.y),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_of AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer FROM c, (VALUES (1), (2)) t(i) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inner_of i ON i.lang = lowest.lang AND i.phrase = lowest.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals ON totals.lang = kept.lang QUALIFY rank <= 2000"""


@query
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages.judge(table(spark, folder, "documents"))
