"""Queries on scans, canonical text, keys, dedup and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisia.functions import text as X
from decisia.operators import audit, dedup, passages
from decisia.plans.registry import clean, norm, query
from decisia.session import spread, table


ANSWER_TAIL = r" '(?i)\s*\banswer\s*[:=]\s*[A-F0-9]\b\.?\s*$', ''"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the 16 digits of their normal text."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "lang", "source", X.key_of(X.norm_text(F.col("text"))).alias("key"))


KEYED = f"(SELECT doc_id, lang, source, substr(sha256({norm('text')}), 1, 16) AS key FROM documents)"


@query("scan_filter_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_quantity > 45 AND l_shipdate < TIMESTAMP '2022-01-01'")
def scan_filter_project(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") > 45) & (F.col("l_shipdate") < F.lit("2022-01-01").cast("timestamp")))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))


@query("clean_text", f"SELECT doc_id, md5({clean('text')}) AS digest, length({clean('text')})::INTEGER AS n FROM documents")
def clean_text(spark, sf_dir):
    t = X.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).alias("n"))


MARKED = "text || '  Answer: B. '"


@query("strip_answer", f"SELECT doc_id, md5({clean('regexp_replace(' + clean(MARKED) + chr(44) + ANSWER_TAIL + ')')}) AS digest FROM documents")
def strip_answer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.strip_answer(F.concat("text", F.lit("  Answer: B. ")))).alias("digest"))


@query("norm_key", f"SELECT doc_id, key FROM {KEYED}")
def norm_key(spark, sf_dir):
    return keyed(spark, sf_dir).select("doc_id", "key")


@query("row_keys", f"SELECT doc_id, sha256({norm('text')} || '###' || 'q' || (doc_id % 3)) AS row_key, sha256({norm('text')}) AS whole FROM documents")
def row_keys(spark, sf_dir):
    """The variants of the key: whole, and with the questions."""
    text = X.norm_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.row_key(text, F.concat(F.lit("q"), F.col("doc_id") % 3)).alias("row_key"), X.key_of(text, 64).alias("whole"))


STATE_SQL = f"""SELECT doc_id, substr(sha256({norm("'lang=' || lang || ' || n=' || n_chars || ' || source=' || source")}), 1, 16) AS key FROM documents"""


@query("norm_state", STATE_SQL)
def norm_state(spark, sf_dir):
    """States as JSON objects whose keys come in another order than the canonical one."""
    state = F.to_json(F.struct("source", F.col("n_chars").alias("n"), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", X.key_of(X.norm_state(state)).alias("key"))


@query("content_tokens", "SELECT doc_id, len(t)::INTEGER AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2)) AS t FROM documents)")
def content_tokens(spark, sf_dir):
    t = X.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(F.array_sort(t), " ")).alias("digest"))


# Suffixes that plant each kind of leak in some documents.
PLANTED = (" Answer: B", " the answer is C", ' {"label": 3}', " see the ground truth here", " answer key below", " correct option: x", " true index", " nothing")
PLANTED_SQL = "text || " + "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(PLANTED)) + " END"


def planted():
    out = None
    for i, s in enumerate(PLANTED):
        out = F.when(F.col("doc_id") % 8 == i, s) if out is None else out.when(F.col("doc_id") % 8 == i, s)
    return F.concat("text", out)


def _leak_sql(variant: str) -> str:
    each = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in X.leak_patterns(variant).items())
    return f"SELECT doc_id, array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ',') AS found FROM (SELECT doc_id, {PLANTED_SQL} AS t FROM documents)"


@query("leak_scan", _leak_sql("wide"))
def leak_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.leaks(planted()), ",").alias("found"))


@query("leak_scan_narrow", _leak_sql("narrow"))
def leak_scan_narrow(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.leaks(planted(), "narrow"), ",").alias("found"))


@query("leak_rows", "SELECT source, count(*) AS n FROM documents WHERE " + " OR ".join(f"regexp_matches({PLANTED_SQL}, '{p}')" for p in X.leak_patterns("audit").values()) + " GROUP BY source")
def leak_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(X.has_leak(planted(), "audit")).groupBy("source").agg(F.count("*").alias("n"))


@query("word_patterns", "SELECT " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(t, '{p}')) AS {n}" for n, p in X.INFORMATIONAL.items()) + f" FROM (SELECT {PLANTED_SQL} AS t FROM documents)")
def word_patterns(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(planted().alias("t"))
    return rows.agg(*(F.count_if(F.col("t").rlike(p)).alias(n) for n, p in X.INFORMATIONAL.items()))


@query("tiny_rows", f"SELECT doc_id, length({norm('text')})::INTEGER AS n FROM documents WHERE length({norm('text')}) < 40")
def tiny_rows(spark, sf_dir):
    n = F.length(X.norm_text(F.col("text")))
    return table(spark, sf_dir, "documents").where(n < 40).select("doc_id", n.alias("n"))


TAGS = "CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '-XX' WHEN 2 THEN CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE 'fra' END WHEN 3 THEN '?' WHEN 4 THEN ' ' ELSE lang || '_latn' END"


@query(
    "lang_normalize",
    f"""WITH t AS (SELECT regexp_extract(lower(trim({TAGS})), '^([^-_]*)', 1) AS s FROM documents),
    m AS (SELECT CASE WHEN s IN ('', '?') THEN NULL ELSE CASE s WHEN 'eng' THEN 'en' WHEN 'deu' THEN 'de' WHEN 'spa' THEN 'es' WHEN 'fra' THEN 'fr' ELSE s END END AS lang FROM t)
    SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM m), 6) AS share, round(CASE WHEN lang IS NOT NULL THEN count(*) END / (SELECT count(lang) FROM m), 6) AS share_of_tagged FROM m GROUP BY lang""",
)
def lang_normalize(spark, sf_dir):
    m = table(spark, sf_dir, "documents").select(X.language(F.expr(TAGS)).alias("lang"))
    counts = m.groupBy("lang").agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("lang").isNotNull(), F.col("n"))).alias("tagged"))
    share = F.round(F.col("n") / F.col("rows"), 6)
    return counts.crossJoin(F.broadcast(totals)).select("lang", "n", share.alias("share"), F.round(F.when(F.col("lang").isNotNull(), F.col("n")) / F.col("tagged"), 6).alias("share_of_tagged"))


@query("json_flatten", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') || ' x' WHEN event_id % 3 = 1 THEN json_extract_string(props, '$.k') ELSE event_type END AS flat FROM events")
def json_flatten(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), k, F.lit(',"x"]'))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", X.flattened(raw).alias("flat"))


@query("option_render", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ': ' || p_type END AS option FROM part")
def option_render(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.rendered(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type"))).alias("option"))


@query("dedup_first_wins", f"SELECT doc_id, source, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, doc_id) AS r FROM {KEYED}) WHERE r = 1")
def dedup_first_wins(spark, sf_dir):
    return dedup.first_wins(keyed(spark, sf_dir), "key", "source", "doc_id").select("doc_id", "source", "key")


@query("dedup_pairs", f"SELECT f AS first_group, source AS later_group, count(*) AS copies FROM (SELECT source, row_number() OVER w AS r, first_value(source) OVER w AS f FROM {KEYED} WINDOW w AS (PARTITION BY key ORDER BY source, doc_id)) WHERE r > 1 GROUP BY f, source")
def dedup_pairs(spark, sf_dir):
    return dedup.pair_counts(keyed(spark, sf_dir), "key", "source", "source", "doc_id")


@query("dedup_summary", f"SELECT count(*) AS rows, count(DISTINCT key) AS distinct_keys, count(*) - count(DISTINCT key) AS duplicates, round(100 * (count(*) - count(DISTINCT key)) / count(*), 4) AS percent FROM {KEYED}")
def dedup_summary(spark, sf_dir):
    return dedup.duplicate_summary(keyed(spark, sf_dir), "key")


@query("dup_within_and_across", f"SELECT source, count(*) FILTER (WHERE i > 1) AS dup_in_group, count(*) FILTER (WHERE a > 1) AS dup_anywhere FROM (SELECT source, row_number() OVER (PARTITION BY key, source ORDER BY doc_id) AS i, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS a FROM {KEYED}) GROUP BY source")
def dup_within_and_across(spark, sf_dir):
    return dedup.within_and_across(keyed(spark, sf_dir), "key", "source", "doc_id")


HELD = "source IN ('src0', 'src7')"


@query("anti_join_existing", f"SELECT doc_id, source FROM {KEYED} WHERE NOT {HELD} AND key NOT IN (SELECT key FROM {KEYED} WHERE {HELD})")
def anti_join_existing(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return dedup.not_in(rows.where(f"NOT ({HELD})"), rows.where(HELD), "key").select("doc_id", "source")


@query("eval_leak_exact", f"WITH e AS (SELECT DISTINCT key FROM {KEYED} WHERE {HELD}), d AS (SELECT * FROM {KEYED} WHERE NOT {HELD}) SELECT source, count(*) AS rows, count(e.key) AS overlap, coalesce(array_to_string(list_slice(list_sort(list(DISTINCT doc_id) FILTER (WHERE e.key IS NOT NULL)), 1, 20), ','), '') AS examples FROM d LEFT JOIN e USING (key) GROUP BY source")
def eval_leak_exact(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    found = dedup.overlap(rows.where(f"NOT ({HELD})"), "source", "key", rows.where(HELD), "doc_id")
    return found.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query("eval_leak_two_sets", f"WITH k AS {KEYED}, b AS (SELECT DISTINCT substr(sha256({norm('text')}), 1, 16) AS key FROM benchmark), l AS (SELECT DISTINCT key FROM k JOIN labels USING (doc_id)) SELECT count(*) AS rows, count(*) FILTER (WHERE key IN (SELECT key FROM b)) AS in_benchmark, count(*) FILTER (WHERE key IN (SELECT key FROM l)) AS in_labelled, CASE WHEN (SELECT count(*) FROM b) = 0 THEN 'skipped' WHEN count(*) FILTER (WHERE key IN (SELECT key FROM b)) = 0 THEN 'pass' ELSE 'fail' END AS benchmark_status FROM k")
def eval_leak_two_sets(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    bench = table(spark, sf_dir, "benchmark").select(X.key_of(X.norm_text(F.col("text"))).alias("key")).distinct().withColumn("b", F.lit(True))
    labelled = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("key").distinct().withColumn("l", F.lit(True))
    hits = rows.join(bench, "key", "left").join(labelled, "key", "left").agg(F.count("*").alias("rows"), F.count("b").alias("in_benchmark"), F.count("l").alias("in_labelled"))
    there = bench.agg(F.count("*").alias("n"))
    status = F.when(F.col("n") == 0, "skipped").when(F.col("in_benchmark") == 0, "pass").otherwise("fail")
    return hits.crossJoin(there).select("rows", "in_benchmark", "in_labelled", status.alias("benchmark_status"))


@query("eval_leak_contains", f"SELECT DISTINCT doc_id, item_id FROM documents d, (SELECT item_id, {norm('text')} AS b FROM benchmark) WHERE length(b) >= 40 AND contains({norm('d.text')}, b)")
def eval_leak_contains(spark, sf_dir):
    """Held-out passages inside documents, searched only in documents that hold a run of a passage."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", X.norm_text(F.col("text")).alias("b")).where(F.length("b") >= 40)
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", X.norm_text(F.col("text")).alias("t"))
    return passages.contained(docs, "doc_id", "t", bench, "item_id", "b")


@query("cross_source_dups", f"SELECT key, array_to_string(list_sort(list(DISTINCT source)), ',') AS groups FROM {KEYED} GROUP BY key HAVING count(DISTINCT source) > 1")
def cross_source_dups(spark, sf_dir):
    return dedup.across(keyed(spark, sf_dir), "key", "source").select("key", F.array_join("groups", ",").alias("groups"))


@query("set_intersect", f"SELECT key FROM {KEYED} WHERE source = 'src1' INTERSECT SELECT key FROM {KEYED} WHERE source <> 'src1'")
def set_intersect(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return rows.where("source = 'src1'").select("key").intersect(rows.where("source <> 'src1'").select("key"))


@query("set_except", f"SELECT key FROM {KEYED} WHERE source = 'src1' EXCEPT SELECT key FROM {KEYED} WHERE source <> 'src1'")
def set_except(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return rows.where("source = 'src1'").select("key").subtract(rows.where("source <> 'src1'").select("key"))


@query("intersect_sizes", f"WITH k AS {KEYED}, n AS (SELECT DISTINCT key FROM k WHERE {HELD}) SELECT source, count(DISTINCT key) AS shared FROM k JOIN n USING (key) WHERE NOT {HELD} GROUP BY source")
def intersect_sizes(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return rows.where(f"NOT ({HELD})").join(rows.where(HELD).select("key").distinct(), "key", "left_semi").groupBy("source").agg(F.count_distinct("key").alias("shared"))


@query("union_sources", "SELECT source_ord, kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 0 AS source_ord, 'document' AS kind, text FROM documents UNION ALL SELECT 1, 'benchmark', text FROM benchmark UNION ALL SELECT 2, role, text FROM conversations) GROUP BY ALL")
def union_sources(spark, sf_dir):
    parts = [table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), "text"), table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("kind"), "text"), table(spark, sf_dir, "conversations").select(F.col("role").alias("kind"), "text")]
    rows = None
    for i, part in enumerate(parts):
        part = part.withColumn("source_ord", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("source_ord", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("union_distinct_keys", f"SELECT key FROM {KEYED} WHERE source = 'src1' UNION SELECT key FROM {KEYED} WHERE source = 'src2'")
def union_distinct_keys(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return rows.where("source = 'src1'").select("key").union(rows.where("source = 'src2'").select("key")).distinct()


@query("label_universe", "SELECT DISTINCT p_brand AS label FROM part WHERE p_brand IS NOT NULL ORDER BY 1 LIMIT 500")
def label_universe(spark, sf_dir):
    from decisia.sources.files import label_universe as universe

    return universe(table(spark, sf_dir, "part"), "p_brand").withColumnRenamed("p_brand", "label")


@query("lookup_joins", "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def lookup_joins(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), 2).cast("double").alias("balance"))


@query("unmatched_lookups", "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS documents_without_label, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS labels_without_document")
def unmatched_lookups(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(docs.join(labels, "doc_id", "left_anti"), "documents_without_label").crossJoin(count(labels.join(docs, "doc_id", "left_anti"), "labels_without_document"))


@query("stats_grouping_sets", "SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'size', (n_chars // 1000)::VARCHAR, count(*) FROM documents GROUP BY n_chars // 1000")
def stats_grouping_sets(spark, sf_dir):
    return audit.grouped_counts(table(spark, sf_dir, "documents").withColumn("size", F.floor(F.col("n_chars") / 1000)), "lang", "source", "size")


@query("topk_share", "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 3")
def topk_share(spark, sf_dir):
    return audit.shares(table(spark, sf_dir, "documents"), "lang", 3)


@query("max_share", "SELECT max(n) AS top, round(max(n) / sum(n), 4) AS max_share, count(*) AS groups FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def max_share(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n").alias("top"), F.round(F.max("n") / F.sum("n"), 4).alias("max_share"), F.count("*").alias("groups"))


@query("distinct_counts", f"SELECT count(DISTINCT key) AS states, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM {KEYED}")
def distinct_counts(spark, sf_dir):
    return keyed(spark, sf_dir).agg(F.count_distinct("key").alias("states"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"))


@query("sample_probe", "SELECT * FROM (SELECT page_id, substr(html, 1, 220) AS html FROM pages ORDER BY page_id LIMIT 2)")
def sample_probe(spark, sf_dir):
    return table(spark, sf_dir, "pages").orderBy("page_id").limit(2).select("page_id", F.substring("html", 1, 220).alias("html"))


@query("element_text", r"SELECT page_id, '[' || (page_id % 9) || '] <title> ' || left(trim(regexp_replace(coalesce(nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ''), regexp_extract(html, '<title>([^<]*)', 1)), '[ \t\n\r\f]+', ' ', 'g')), 60) AS element FROM pages")
def element_text(spark, sf_dir):
    first = F.coalesce(F.nullif(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit("")), F.regexp_extract("html", "<title>([^<]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.format_string("[%s] <title> %s", (F.col("page_id") % 9).cast("string"), F.left(X.clean(first), F.lit(60))).alias("element"))
