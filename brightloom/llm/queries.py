"""The registered queries of this subpackage: thin opN_<name> queries that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, hmm, license_scan, minhash, mixing, pii, secret_scan, toxicity, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compared(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op7_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.told(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.told(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return bpe.digests(_table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op2_pii_spans": op2_pii_spans,
    "op4_fingerprints": op4_fingerprints,
    "op5_mixing": op5_mixing,
    "op7_hmm_scores": op7_hmm_scores,
    "op8_license_scan": op8_license_scan,
    "op9_secret_scan": op9_secret_scan,
    "op10_toxicity": op10_toxicity,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
}

_REACH = """reach AS (SELECT DISTINCT {id} AS n, {id} AS r FROM {of} UNION SELECT reach.n, links.b FROM reach JOIN links ON reach.r = links.a),
part AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n)"""

_LETTERS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BREAK = "(?:\\r\\n|[\\n\\x0B\\x0C\\r\\x{85}\\x{2028}\\x{2029}])"


def _license_templates() -> str:
    rows = []
    for name, text in license_scan.TEMPLATES:
        own = sorted(license_scan.bigrams(license_scan.normal(text)))
        rows.append(f"('{name}', [" + ", ".join(f"'{g}'" for g in own) + "])")
    return ", ".join(rows)


ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
{_REACH.format(id="vec_id", of="embeddings")}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN part ON n = vec_id""",
    "op3_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LETTERS}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= 75 * (na + nb - i)),
{_REACH.format(id="doc_id", of="documents")}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sh JOIN part ON n = doc_id""",
    "op8_license_scan": f"""
WITH t(name, g) AS (VALUES {_license_templates()}),
u AS (SELECT doc_id, unnest(list_concat(regexp_split_to_array(coalesce(text, ''), '{_BREAK}'), list_filter(regexp_split_to_array(coalesce(text, ''), '{_BREAK}[\\x20\\t]*{_BREAK}'), lambda b: regexp_matches(b, '{_BREAK}')))) AS unit FROM documents),
w AS (SELECT doc_id, row_number() OVER () AS k, list_filter(string_split(regexp_replace(regexp_replace(lower(unit), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '\\blicence', 'license', 'g'), ' '), lambda x: x <> '') AS w FROM u),
g AS (SELECT doc_id, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
d AS (SELECT doc_id, k, name, 2 * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice FROM g, t WHERE least(len(g.g), len(t.g)) * 2 >= 0.8 * (len(g.g) + len(t.g))),
best AS (SELECT doc_id, k, max({{'dice': dice, 'name': name}}) AS b FROM d WHERE dice >= 0.8 GROUP BY 1, 2),
found AS (SELECT doc_id, count(DISTINCT b.name) AS n_licenses, string_agg(DISTINCT b.name, ',' ORDER BY b.name) AS licenses, max(b.dice) AS best FROM best GROUP BY 1)
SELECT documents.doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, round(coalesce(best, 0), 6) AS best FROM documents LEFT JOIN found ON documents.doc_id = found.doc_id""",
}
