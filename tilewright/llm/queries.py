"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, langid, leaks, licenses, neardup, pages, pieces, search, secrets, simhash, toxicity
from .common import LOWER, UPPER, fold_of, table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest_columns(licenses.scan(table(spark, sf_dir, "documents")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op2_columns(chat.op2_source(table(spark, sf_dir, "conversations")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), piece_model())


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), size=2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns tell of exact matches; n_near counts the items found by proximity, exact ones included."""
    return leaks.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "near")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_chat_format": op2_chat_format,
    "op3_fingerprints": op3_fingerprints,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_language_id": op6_language_id,
    "op7_main_text": op7_main_text,
    "op8_secret_scan": op8_secret_scan,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "op11_ranked_search": op11_ranked_search,
    "op12_simhash": op12_simhash,
}

LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY 1, 2) WHERE 100 * k >= 80 * (na + nb - k)),
reach(d, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT e.b, reach.r FROM reach JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) e ON e.a = reach.d)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN (SELECT d AS doc_id, min(r) AS c FROM reach GROUP BY 1) USING (doc_id)"""

OP10_SQL = f"""
WITH word AS (SELECT '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+' AS re),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, re) AS ws FROM documents, word), i AS (SELECT item_id, regexp_extract_all({LOWERED}, re) AS ws FROM benchmark, word),
iw AS (SELECT item_id, least(10, len(ws)) AS size, unnest(list_transform(range(1, greatest(2, len(ws) - 8)), lambda k: array_to_string(ws[k : k + 9], ' '))) AS g FROM i WHERE len(ws) > 0),
dw AS (SELECT r, size, unnest(range(1, len(ws) - size + 2)) AS k, unnest(list_transform(range(1, len(ws) - size + 2), lambda k: array_to_string(ws[k : k + size - 1], ' '))) AS g FROM d, (SELECT DISTINCT size FROM iw)),
hit AS (SELECT r, item_id, k, size FROM dw JOIN iw USING (size, g)),
pos AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS p FROM hit) GROUP BY 1),
own AS (SELECT r, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY 1),
tok AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM d),
df AS (SELECT w, count(*) AS n FROM tok GROUP BY 1),
nw AS (SELECT DISTINCT item_id, list_sort(list_distinct(string_split(g, ' '))) AS terms FROM iw),
rare AS (SELECT item_id, terms, arg_min(t, coalesce(n, 0)) AS w FROM (SELECT item_id, terms, unnest(terms) AS t FROM nw) LEFT JOIN df ON t = w GROUP BY 1, 2),
cand AS (SELECT r, item_id, terms, ws[greatest(1, k - {leaks.SPAN - 1}) : k + {leaks.SPAN - 1}] AS around FROM tok JOIN rare USING (w) JOIN d USING (r)),
near AS (SELECT r, count(DISTINCT item_id)::BIGINT AS n_near FROM cand WHERE list_has_all(around, terms)
  AND len(list_filter(range(1, greatest(2, len(around) - {leaks.SPAN - 2})), lambda k: list_has_all(around[k : k + {leaks.SPAN - 1}], terms))) > 0 GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN pos USING (r) LEFT JOIN own USING (r) LEFT JOIN near USING (r)"""

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '{TERM}') AS ws FROM documents),
total AS (SELECT count(*) FILTER (len(ws) > 0)::BIGINT AS docs, sum(len(ws))::BIGINT AS words FROM d),
q AS (SELECT item_id, t, count(*)::BIGINT AS q FROM (SELECT item_id, unnest(regexp_extract_all({LOWERED}, '{TERM}')) AS t FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * n + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS n FROM tf GROUP BY 1), total),
i AS (SELECT r, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ws)::BIGINT * docs) // words)) AS i FROM tf JOIN d USING (r), total),
s AS (SELECT item_id, r, sum(q * w * i)::BIGINT AS score FROM q JOIN i USING (t) JOIN w USING (t) GROUP BY 1, 2)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0
QUALIFY rank <= 20"""

SQL: dict[str, str] = {
    "op11_ranked_search": OP11_SQL,
    "op5_near_duplicates": OP5_SQL,
    "op10_decontamination": OP10_SQL,
    "op1_license_scan": licenses.oracle_sql(),
    "op2_chat_format": chat.ORACLE_SQL,
}
