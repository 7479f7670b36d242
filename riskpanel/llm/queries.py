"""Registered queries of this subpackage: each applies its operator with production parameters to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm import (attention_lm, collocation, decontam, langid, mixing, multiset, negatives, quality, simhash,
                           suffix_dedup, tokencount, toxicity, urlfilter)

#: fixed values of the URL filter query: action, host, path
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs, table(spark, sf_dir, "labels")).drop("text")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= toxicity.PREDICT_AT).cast("int").alias("predicted"), "spans")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.with_sizes(tokencount.token_counts(docs)).drop("text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(table(spark, sf_dir, "documents"), keep_text=False)
    return drawn.select("doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "pages").select("page_id", "url", "html"), table(spark, sf_dir, "documents"))
    return found.select("page_id", "host", "declared", "text_lang", "lang", "confidence", "n_grams")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multiset.edit_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    odd = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))  # no number to floor: no component
    vec = F.when(~F.coalesce(odd, F.lit(False)), whole)
    return negatives.hard_negatives(rows.select("vec_id", label.alias("label"), vec.alias("vec")))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_suffix_array_dedup, op3_url_filters, op4_simhash_near_dedup, op5_benchmark_decontamination,
    op6_toxicity, op7_lm_scoring, op8_token_counts, op9_mixing, op10_language_id, op11_document_fingerprints,
    op12_phrase_collocations, op13_hard_negatives)}

ORACLE = {
    "op3_url_filters": r"""
WITH rules(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (SELECT page_id, row_number() OVER () AS k,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC NULLS LAST) = 1
""",
    "op9_mixing": r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce('s' || source, 'n') AS skey, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS ord FROM documents),
s0 AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM d GROUP BY skey),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s0),
s2 AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[(rank % 3 + 1)::BIGINT] AS weight, (source_size * 3)::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS cost FROM s2),
s4 AS (SELECT *, (SELECT sum(source_size)::BIGINT::DOUBLE FROM s3) AS total,
         coalesce(sum(cap::BIGINT) OVER (ORDER BY cost, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT::DOUBLE AS filled,
         sum(weight) OVER (ORDER BY cost, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM s3),
s5 AS (SELECT *, (total - filled) / rest_weight AS lv FROM s4),
lev AS (SELECT lv FROM s5 WHERE lv <= cost ORDER BY cost, rank LIMIT 1),
s6 AS (SELECT s5.*, least(cap, (SELECT lv FROM lev) * weight) AS target,
         least(65536, greatest(1, ceil(n_rows / 64.0)))::BIGINT AS n_blocks FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM s6),
s AS (SELECT *, target - epochs * source_size::DOUBLE AS rest FROM s7),
b AS (SELECT d.*, s.source_size, s.target, s.epochs, s.rest, (('0x' || substr(ord, 1, 8))::BIGINT * n_blocks) // 4294967296 AS block
      FROM d JOIN s USING (skey)),
c0 AS (SELECT skey, block, any_value(rest) AS rest, sum(size)::BIGINT AS words FROM b GROUP BY skey, block),
c1 AS (SELECT *, sum(words) OVER (PARTITION BY skey ORDER BY block)::BIGINT AS until FROM c0),
cut AS (SELECT skey, block AS cut_block, (rest - until) + words AS room FROM c1 WHERE until > rest
        QUALIFY row_number() OVER (PARTITION BY skey ORDER BY block) = 1),
u AS (SELECT b.skey, b.ord, any_value(room) AS room, sum(size)::BIGINT AS unit,
        row_number() OVER (PARTITION BY b.skey ORDER BY b.ord) AS rn
      FROM b JOIN cut ON b.skey = cut.skey AND b.block = cut.cut_block WHERE room > 0 GROUP BY b.skey, b.ord),
walk AS (
    SELECT DISTINCT skey, 0::BIGINT AS rn, room, false AS hit, ''::VARCHAR AS ord, 0::BIGINT AS unit FROM u
    UNION ALL
    SELECT u.skey, u.rn, CASE WHEN u.unit > 0 AND u.unit <= w.room THEN w.room - u.unit ELSE w.room END,
           u.unit > 0 AND u.unit <= w.room, u.ord, u.unit FROM walk w JOIN u ON u.skey = w.skey AND u.rn = w.rn + 1),
fin AS (SELECT skey, room FROM walk QUALIFY row_number() OVER (PARTITION BY skey ORDER BY rn DESC) = 1),
extra AS (SELECT w.skey, w.ord FROM walk w JOIN fin USING (skey) WHERE w.rn > 0 AND NOT w.hit AND abs(w.unit - fin.room) < fin.room
          QUALIFY row_number() OVER (PARTITION BY w.skey ORDER BY abs(w.unit - fin.room), w.rn) = 1),
picks AS (SELECT skey, ord FROM walk WHERE hit UNION SELECT skey, ord FROM extra)
SELECT b.doc_id, b.size, b.source_size, b.target,
       b.size * (b.epochs + CASE WHEN (b.rest > 0 AND b.block < coalesce(cut.cut_block, 65537)) OR picks.ord IS NOT NULL THEN 1 ELSE 0 END) AS taken
FROM b LEFT JOIN cut ON cut.skey = b.skey LEFT JOIN picks ON picks.skey = b.skey AND picks.ord = b.ord
""",
    "op12_phrase_collocations": r"""
WITH p0 AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p1 AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM p0),
p2 AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p1),
p3 AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM p2 WHERE len(w) > 0),
p4 AS (SELECT lang, w, i, unnest([1, 2, 3, 4, 5]) AS k FROM p3),
f AS MATERIALIZED (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS a
      FROM p4 WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 100),
cut0 AS (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c),
cut AS (SELECT lang, k, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS head,
        array_to_string(list_slice(w, j + 1, k), ' ') AS tail FROM cut0),
s AS (SELECT cut.lang, cut.k, cut.phrase, cut.a, cut.j, x.a AS l, y.a AS r, n.n,
        ((1000::HUGEINT * cut.a::HUGEINT * n.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT))::BIGINT AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.head JOIN f y ON y.lang = cut.lang AND y.phrase = cut.tail
      JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner0 AS (SELECT lang, k, w, a, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k > 2),
inner1 AS (SELECT lang, w, a, m, unnest(generate_series(1, k - m + 1)) AS i FROM inner0),
gone AS (SELECT DISTINCT inner1.lang, c.phrase FROM inner1
         JOIN c ON c.lang = inner1.lang AND c.phrase = array_to_string(list_slice(inner1.w, i, i + m - 1), ' ') AND 100 * inner1.a >= 100 * c.a),
kept AS (SELECT best.* FROM best LEFT JOIN gone ON gone.lang = best.lang AND gone.phrase = best.phrase WHERE gone.phrase IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
""",
    "op13_hard_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.vec, b.vec)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
g AS (SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 10
""",
}
