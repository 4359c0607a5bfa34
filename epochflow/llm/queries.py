"""The registered queries of this subpackage: thin calls of its operators over whole tables, with production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, embeddings, interpolation, licences, mixing, resampling, secret_grammar, simhash, substrings, toxicity, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken_words(_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, most=2)
    return taken.select("doc_id", "size", "source_size", "target", "taken", "shards")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), byte_bpe_path())


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(_table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=4, shingle=4)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.scores(_table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_grammar.scan(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), least_docs=3, top_terms=200)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(_table(spark, sf_dir, "documents"), window=35)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_bpe_round_trip,
        op3_html_main_text,
        op4_license_scan,
        op5_simhash_near_dedup,
        op6_lm_scores,
        op7_embedding_near_dedup,
        op8_nearest_neighbours,
        op9_secret_scan,
        op10_toxicity,
        op11_importance_resampling,
        op12_source_divergence,
        op13_substring_dedup,
    )
}

#: The other operators are beyond SQL: tests hold them against brute force, libraries or held-out rows.
ORACLES: dict[str, str] = {
    # DuckDB has no crc32: a table of 256 numbers by eight steps each, then one step a byte of each distinct word.
    "op11_importance_resampling": """
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
f AS (SELECT r, unnest(w) AS w FROM d),
words AS (SELECT DISTINCT w FROM (SELECT w FROM f UNION ALL SELECT w FROM b)),
bytes AS (SELECT w, list_transform(range(CAST(length(hex(encode(w))) / 2 AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode(w)), 2 * i + 1, 2)) AS BIGINT)) AS y FROM words),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295, y), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS k FROM bytes, crc),
s AS (SELECT k, count(*) AS n FROM f JOIN k USING (w) GROUP BY 1), t AS (SELECT k, count(*) AS n FROM b JOIN k USING (w) GROUP BY 1),
g AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT sum(n) FROM s) + 10000) / ((s.n + 1.0::DOUBLE) * (coalesce((SELECT sum(n) FROM t), 0) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (k)),
m AS (SELECT r, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN k USING (w) JOIN g USING (k) GROUP BY 1),
z AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN m USING (r)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM z),
ranked AS (SELECT *, n_features >= 20 AS ok, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND place <= 10 * n // 100 THEN place END AS rank FROM ranked""",
    "op12_source_divergence": """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM f GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
ln AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT f.lang, f.source, f.term, count(*) AS c FROM f JOIN kept ON kept.lang = f.lang AND kept.term = f.term GROUP BY 1, 2, 3),
tot AS (SELECT grp.lang, grp.source, coalesce(sum(c), 0) AS n FROM grp LEFT JOIN occ USING (lang, source) GROUP BY 1, 2),
p AS (SELECT tot.lang, tot.source, kept.term, coalesce(occ.c, 0) AS c, 1 + CAST(1000000000 * CAST(coalesce(occ.c, 0) + 1 AS HUGEINT) // (tot.n + ln.v) AS BIGINT) AS p, 1 + CAST(1000000000 * CAST(kept.c + 1 AS HUGEINT) // (ln.n + ln.v) AS BIGINT) AS q
      FROM tot JOIN ln USING (lang) JOIN kept USING (lang) LEFT JOIN occ ON occ.lang = tot.lang AND occ.source = tot.source AND occ.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op13_substring_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, p, array_to_string(w[p : p + 34], ' ') AS run FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY md5(run)) AS n FROM s) WHERE n > 1),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
near AS (SELECT words.r, words.p, word, max(again.p) OVER (PARTITION BY words.r ORDER BY words.p) AS last FROM words LEFT JOIN again ON again.r = words.r AND again.p = words.p),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM near WHERE last IS NULL OR p - last >= 35 GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op7_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), m AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id""",
}
