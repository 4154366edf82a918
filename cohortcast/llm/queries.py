"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(col) -> F.Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(F.encode(col, "UTF-8"), 256)


#: The key that surrogates depend on in these queries; a real one is a secret of its user.
PII_KEY = "cohortcast"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", digest(F.col("kept")).alias("kept_sha256"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    pages = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import similar_texts

    return similar_texts(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest(F.array_join("items", ",")).alias("items_sha256"), "contaminated"
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded_col="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


#: The rules of op8's contract, as (verdict, host and path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules AS (SELECT * FROM (VALUES {rules}) r(verdict, host, path)),
listed AS (SELECT * FROM (VALUES {listed}) b(domain)),
fit AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict
  FROM (SELECT DISTINCT page_id, host, path FROM parts) p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC) = 1)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM listed b WHERE p.host = b.domain OR ends_with(p.host, '.' || b.domain)) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fit f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.host = f.host AND p.path = f.path
"""


def _op8_sql() -> str:
    from .url_filter import BLOCKED_DOMAINS

    rules = [(v, *r.partition("/")[::2]) for v, r in URL_RULES]
    return OP8_SQL.format(rules=", ".join(f"('{v}', '{h}', '/{p}')" for v, h, p in rules), listed=", ".join(f"('{d}')" for d in BLOCKED_DOMAINS))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
x AS (
  SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS gram
  FROM (SELECT d.r, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g) s WHERE len(d.w) >= s.n)),
h AS (SELECT x.r, x.p, x.n, g.item_id FROM x JOIN g USING (n, gram)),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(i.s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""


def op9_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, learn=~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM g),
r AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM f WHERE k > 1) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
c AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM c GROUP BY 1) USING (doc_id)
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), longest=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import books_digest, compress

    coded, codebooks = compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(codebooks)).alias("codebooks_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit_texts

    return audit_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op12_sql(rounds: int = 6) -> str:
    """The rounds one after the other: a<k> assigns, c<k> replaces."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (
  SELECT x.r, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN c{k} c USING (p)) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
  SELECT p, e, list(floor_mean ORDER BY i) AS v FROM (
    SELECT p, e, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS floor_mean
    FROM (SELECT a.p, a.e, unnest(range(1, 9)) AS i, unnest(x.v) AS y FROM a{k} a JOIN x USING (r, p)) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, q[8 * p + 1 : 8 * p + 8] AS v FROM k, range(8) s(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= 16),
{", ".join(steps)},
n AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(range(1, 9)) AS i, unnest(v) AS y FROM c{rounds})) AS codebooks_sha256
FROM k JOIN n USING (r)
"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN l USING (doc_id)),
a AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS o FROM c v, c w, c x, c y, c z WHERE len(list_distinct([v.c, w.c, x.c, y.c, z.c])) = 5),
s AS (SELECT o, k, o[k] AS own, o[1 : k - 1] AS before FROM o, range(1, 6) r(k)),
j AS (
  SELECT part, o AS filter_order, k AS step, own, sum(CASE WHEN translate(fails, before || own, '') = fails THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN g ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN x ELSE 0 END) AS toxic_lost
  FROM a, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM j
"""


def queries() -> dict:
    named = (op1_pii, op2_substring_dedup, op3_html_extract, op4_quality_rules, op5_ngram_jaccard, op6_decontaminate, op7_bpe, op8_url_filter, op9_lang_id, op10_token_counts, op11_packing, op12_vector_codes, op13_filter_audit)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op5_ngram_jaccard": OP5_SQL, "op6_decontaminate": OP6_SQL, "op8_url_filter": _op8_sql(), "op12_vector_codes": _op12_sql(), "op13_filter_audit": OP13_SQL}
