"""Queries that apply the training-data operators to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisia.llm import align, ann, divergence, exact, html, jaccard, language, mixing, packing, pii, quality, substrings, token_files
from decisia.llm.common import table, work_path
from decisia.llm.encoding import tokenizer_path


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = work_path(spark, "tokens")
    meta = token_files.write_tokens(table(spark, sf_dir, "documents"), address, tokenizer_path(), end_id=2)
    return token_files.read_tokens(spark, address, meta)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs)).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_quality": op2_quality,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_page_text": op6_page_text,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_nearest": op8_nearest,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
    "op11_token_alignment": op11_token_alignment,
    "op12_source_divergence": op12_source_divergence,
    "op13_language": op13_language,
}

OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def _case(column: str, weights: dict[str, int]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    return f"CASE {column} {whens} ELSE 1 END::BIGINT" if whens else "1::BIGINT"


def _share(nodes: str, parent: str) -> str:
    """SQL of one level: nodes has name, weight, capacity, budget and the columns of parent."""
    by = f"PARTITION BY {parent} " if parent else ""
    return f"""(SELECT *, CASE WHEN level IS NULL THEN capacity::DOUBLE ELSE least(capacity::DOUBLE, level * weight) END AS share FROM (
  SELECT *, max(CASE WHEN own * weight <= capacity THEN own END) OVER ({by}) AS level FROM (
    SELECT *, (budget - coalesce(sum(capacity) OVER ({by}ORDER BY capacity / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER ({by}ORDER BY capacity / weight, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS own FROM {nodes})))"""


def mix_sql(budget_share: float, epochs: int) -> str:
    """The mix with the fixed weights and seed 7, of the table documents."""
    return rf"""
WITH r AS (
  SELECT doc_id, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4) ELSE 'other' END AS domain,
    coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
    greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY ALL),
top AS (SELECT domain, domain AS name, {_case("domain", mixing.DOMAIN_WEIGHTS)} AS weight, ({epochs} * sum(tokens))::BIGINT AS capacity,
  floor((SELECT sum(tokens) FROM leaves)::DOUBLE * {budget_share}) AS budget FROM leaves GROUP BY domain),
top2 AS (SELECT domain, share AS budget FROM {_share("top", "")}),
mid AS (SELECT domain, lang, lang AS name, {_case("lang", mixing.LANG_WEIGHTS)} AS weight, ({epochs} * sum(tokens))::BIGINT AS capacity, any_value(budget) AS budget
  FROM leaves JOIN top2 USING (domain) GROUP BY domain, lang),
mid2 AS (SELECT domain, lang, share AS budget FROM {_share("mid", "domain")}),
low AS (SELECT domain, lang, source, source AS name, {_case("source", mixing.SOURCE_WEIGHTS)} AS weight, {epochs} * tokens AS capacity, tokens, budget FROM leaves JOIN mid2 USING (domain, lang)),
plan AS (SELECT domain, lang, source, tokens, floor(share)::BIGINT AS budget FROM {_share("low", "domain, lang")}),
drawn AS (
  SELECT r.*, e.epoch::INTEGER AS epoch, budget - tokens * e.epoch AS rest, md5(concat_ws(':', coalesce(doc_id::VARCHAR, '-'), e.epoch, '7')) AS order_key
  FROM r JOIN plan USING (domain, lang, source), (SELECT unnest(range({epochs})) AS epoch) e WHERE e.epoch <= budget // tokens),
used AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY order_key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM drawn)
SELECT doc_id, domain, lang, source, epoch, n_tokens, order_key FROM used WHERE upto <= rest
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n_group FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cells USING (lang, source) GROUP BY ALL),
grid AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (n_group + 5 * v) AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (n_lang + 5 * v) AS q
  FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN cells USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM grid WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 50
"""

ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": OP4_SQL, "op5_mixing": mix_sql(0.6, 2), "op12_source_divergence": OP12_SQL}
