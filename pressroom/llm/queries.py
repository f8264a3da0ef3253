"""The corpus operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed_dedup, langid, lexical, minhash, mixing, sharding, substring, suffix_dedup, token_counts, token_files, topk, vector_codes
from .common import as_table, table, working_tables

Query = Callable[[SparkSession, str], DataFrame]


def settled(query: Query) -> Query:
    """The query's rows as a table; whatever else it wrote on the way is dropped."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with working_tables(spark):
            return as_table(query(spark, sf_dir), query.__name__, keep=True)

    return run


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, ids=False)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.quality_weights(table(spark, sf_dir, "labels"))).drop("copies")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Query] = {f.__name__: settled(f) for f in (op1_token_binary, op2_language_id, op3_embedding_dedup, op4_token_counts, op5_substring_dedup, op6_top_k, op7_rendezvous_sharding, op8_bpe, op9_mixing, op10_minhash, op11_vector_codes, op12_lexical_search, op13_suffix_dedup)}


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Product quantisation round by round, with every distance written out."""
    steps = f"""WITH base AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS v FROM base, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, e, v FROM part JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM base) USING (r) WHERE e < {entries})"""
    for k in range(rounds + 1):
        steps += f""",
near{k} AS MATERIALIZED (SELECT r, p, min(CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS BIGINT) * {entries} + e) AS best FROM part a JOIN book{k} b USING (p) GROUP BY r, p)"""
        if k < rounds:
            steps += f""",
mean{k} AS MATERIALIZED (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, best % {entries} AS e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM near{k} JOIN part USING (r, p), range(1, len(v) + 1) t(i) GROUP BY ALL) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (p, e))"""
    return f"""{steps},
coded AS (SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
name AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM base JOIN coded USING (r), name"""


_LOWER_TERMS = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: Tokenizers, CRC-32, learned models, hashes and whole-table pair searches are beyond the SQL
#: that DuckDB runs over whole tables; those operators are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    "op12_lexical_search": f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_LOWER_TERMS} AS ts FROM documents),
i AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, {_LOWER_TERMS} AS ts FROM benchmark),
asked AS MATERIALIZED (SELECT q, t, count(*) AS c FROM (SELECT q, unnest(ts) AS t FROM i) GROUP BY q, t),
whole AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d WHERE len(ts) > 0),
held AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
weighted AS MATERIALIZED (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, whole GROUP BY t, docs),
long AS MATERIALIZED (SELECT r, doc_id, 100 - 75 + ((75 * len(ts) * docs) // terms) AS m FROM d, whole WHERE len(ts) > 0),
scored AS (SELECT q, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM asked JOIN held USING (t) JOIN weighted USING (t) JOIN long USING (r) GROUP BY q, r, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN i USING (q) WHERE rank <= 10""",
}
