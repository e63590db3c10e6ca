"""Queries on builders of whole sources and on adapters of single ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisia.functions import rand
from decisia.operators import builders, shapes
from decisia.plans.registry import clean, norm, order_key, query, uniform
from decisia.plans.rows import WITHIN, _sql, shown_state
from decisia.session import table
from decisia.sources import specs

T = clean("text")


@query("shape_sentiment_local", _sql("doc_id", "choice", "(doc_id % 3)::INTEGER", "['ポジティブ', 'ネガティブ']", f"'language=ja|text=' || {T}", "documents", f"label < 2 AND s <> 'language=ja|text='"))
def shape_sentiment_local(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return shown_state(shapes.sentiment_local(d, F.col("doc_id"), F.lit("marc"), F.lit("ja"), F.col("text"), F.col("doc_id") % 3))


@query("shape_span_pronoun", f"SELECT doc_id::VARCHAR AS guid, '文中的「' || lang || '」指的是「' || source || '」吗?' AS instructions, md5('language=zh|text=' || {T} || '|span1=' || source || '|span2=' || lang) AS state, (doc_id % 2)::INTEGER AS label FROM documents WHERE doc_id % 3 < 2 AND {T} <> ''")
def shape_span_pronoun(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("target", F.struct(F.when(F.col("doc_id") % 3 == 2, " ").otherwise(F.col("source")).alias("span1_text"), F.col("lang").alias("span2_text")))
    made = shapes.span_pronoun(d, F.col("doc_id"), F.lit("wsc"), F.lit("zh"), F.col("text"), F.col("target.span1_text"), F.col("target.span2_text"), F.col("doc_id") % 2)
    state = F.array_join(F.transform(F.map_entries("state"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return made.select("guid", "instructions", F.md5(state).alias("state"), "label")


DOMAINS = "['" + "', '".join(specs.MTOP_DOMAINS) + "']"


@query("shape_listed_labels", _sql("doc_id", "choice", f"list_position({DOMAINS}, CASE doc_id % 4 WHEN 0 THEN 'music' WHEN 1 THEN 'weather' WHEN 2 THEN 'alarm' ELSE 'IN:OTHER' END) - 1", DOMAINS, f"'language=' || lang || '|text=' || {T}", "documents", WITHIN))
def shape_listed_labels(spark, sf_dir):
    """Labels of a fixed list; the language is the tag's first part."""
    d = table(spark, sf_dir, "documents").withColumn("tag", F.concat("lang", F.lit("_XX")))
    label = F.element_at(shapes.texts(["music", "weather", "alarm", "IN:OTHER"]), (F.col("doc_id") % 4 + 1).cast("int"))
    return shown_state(shapes.label_str(d, F.col("doc_id"), F.lit("mtop"), F.split("tag", "_")[0], F.col("text"), label, specs.MTOP_DOMAINS))


@query("shape_nli_named", _sql("doc_id", "choice", "(doc_id % 4)::INTEGER", "['中立(neutral)', '蕴含(entailment)', '矛盾(contradiction)']", f"'language=zh|sentence1=' || {T} || '|sentence2=' || source", "documents", f"{WITHIN} AND NOT s LIKE 'language=zh|sentence1=|%'"))
def shape_nli_named(spark, sf_dir):
    """The other layout of columns, names in the source's order beside their local ones."""
    d = table(spark, sf_dir, "documents")
    return shown_state(shapes.nli_local(d, F.col("doc_id"), F.lit("ocnli"), F.lit("zh"), F.col("text"), F.col("source"), F.col("doc_id") % 4, names=specs.NLI_ZH, fields=("sentence1", "sentence2")))


@query("shape_graded", _sql("doc_id", "score", "least(5, greatest(0, round_even((doc_id % 15) / 2.0 - 1, 0)))::INTEGER", "['0','1','2','3','4','5']", f"'language=ko|text=' || {T} || '|text_2=' || source", "documents"))
def shape_graded(spark, sf_dir):
    """Real scores to levels: halves to the even one, clamped."""
    d = table(spark, sf_dir, "documents")
    return shown_state(shapes.graded(d, F.col("doc_id"), F.lit("sts"), F.lit("ko"), F.col("text"), F.col("source"), F.col("doc_id") % 15 / 2 - 1, [str(i) for i in range(6)]))


@query("shape_soft_pair", _sql("doc_id", "noul", "NULL", "['The two sentences have different meanings.', 'The two sentences have the same meaning.']", f"'language=en|sentence1=' || {T} || '|sentence2=' || source", "documents", "NOT s LIKE 'language=en|sentence1=|%'", "least(1.0, (doc_id % 7) / 5.0)::DOUBLE"))
def shape_soft_pair(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return shown_state(shapes.soft_pair(d, F.col("doc_id"), F.lit("stsb"), F.lit("en"), F.col("text"), F.col("source"), F.col("doc_id") % 7, criteria=("The two sentences have different meanings.", "The two sentences have the same meaning.")))


PAGES = _sql("'page-' || lang || '-' || doc_id", "choice", "list_position(['en','de','fr'], lang) - 1", "['en','de','fr']", f"'webpage_text=' || {T}", "documents", WITHIN)
SPAM = _sql("'sms-' || doc_id", "noul", "NULL", "[]::VARCHAR[]", f"'message=' || {T}", "documents", "true", "CASE WHEN doc_id % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE")


@query("build_browser_rows", f"{PAGES} UNION ALL {SPAM}")
def build_browser_rows(spark, sf_dir):
    """Page topics and flagged messages."""
    d = table(spark, sf_dir, "documents")
    topics = builders.page_topics(d, F.col("doc_id"), "page", F.col("text"), F.col("lang"), ("en", "de", "fr"), "Which topic?")
    return shown_state(topics.unionByName(builders.flags(d, F.col("doc_id"), "sms", "message", F.col("text"), F.col("doc_id") % 3, "Is it spam?")))


FIRST = "(SELECT * FROM documents ORDER BY doc_id LIMIT 150)"


@query("build_long_texts", f"""WITH f AS {FIRST}, n AS (SELECT list(DISTINCT source ORDER BY source) AS o FROM f)
    SELECT doc_id::VARCHAR AS guid, (list_position(o, source) - 1)::INTEGER AS label, array_to_string(o, '|') AS options, md5('language=en|text=' || {T}) AS state FROM f, n""")
def build_long_texts(spark, sf_dir):
    """The first rows of a source of long texts; their labels are the options."""
    made = shown_state(builders.long_texts(table(spark, sf_dir, "documents"), "doc_id", "text", "source", 150))
    return made.select("guid", "label", "options", "state")


@query("build_rounds", f"SELECT 'anli-' || r || '-' || place AS guid, doc_id FROM (SELECT doc_id, doc_id % 3 AS r, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY {order_key('doc_id', 7, 'round')}, doc_id) - 1 AS place FROM documents) WHERE place < 20")
def build_rounds(spark, sf_dir):
    """A drawn few of each round, with ids by round and place."""
    return builders.rounds(table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("r")), "doc_id", "r", 20).select("guid", "doc_id")


def drawn(pool: str, key: str, *salt: str) -> str:
    """A list in the order that rand.permuted draws."""
    return f"list_transform(list_sort(list_transform({pool}, lambda x, i: {{'h': {order_key(key, *salt, '=(i - 1)')}, 'i': i, 'x': x}})), lambda z: z.x)"


@query("build_intents", f"""WITH r AS (SELECT p_partkey AS key, p_type AS gold FROM part WHERE p_brand <> 'Brand#11'), n AS (SELECT list(DISTINCT gold ORDER BY gold) AS o FROM r),
    d AS (SELECT key, gold, {drawn("list_filter(o, lambda y: y <> gold)", "key", 7, "others")}[1:5] AS others FROM r, n),
    s AS (SELECT key, gold, {drawn("list_concat([gold], others)", "key", 7, "shown")} AS options FROM d)
    SELECT key, array_to_string(options, '|') AS options, (list_position(options, gold) - 1)::INTEGER AS label FROM s""")
def build_intents(spark, sf_dir):
    """Splits put together, one label out of scope; the gold name among drawn others."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_brand") == "Brand#11", "oos").otherwise(F.col("p_type")).alias("intent"))
    made = builders.intents([p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1")], "p_partkey", "p_name", "intent")
    return made.select("key", F.array_join("options", "|").alias("options"), "label")


@query("build_intents_hard", f"""WITH l AS (SELECT DISTINCT p_type AS label, list_distinct(list_filter(string_split(p_type, ' '), lambda t: length(t) > 2)) AS own FROM part),
    h AS (SELECT label, list(other ORDER BY place) AS others FROM (SELECT a.label, b.label AS other, row_number() OVER (PARTITION BY a.label ORDER BY len(list_intersect(a.own, b.own)) DESC, b.label) AS place FROM l a JOIN l b ON a.label <> b.label) WHERE place <= 4 GROUP BY label),
    s AS (SELECT p_partkey AS key, p_type AS gold, {drawn("list_concat([p_type], others)", "p_partkey", 7, "shown")} AS options FROM part JOIN h ON p_type = label)
    SELECT key, array_to_string(options, '|') AS options, (list_position(options, gold) - 1)::INTEGER AS label FROM s""")
def build_intents_hard(spark, sf_dir):
    """The gold name among those most like it."""
    made = builders.intents([table(spark, sf_dir, "part")], "p_partkey", "p_name", "p_type", hard=4, separator=" ")
    return made.select("key", F.array_join("options", "|").alias("options"), "label")


@query("build_pool", f"""WITH d AS (SELECT doc_id, {norm("'language=en || question=' || " + T)} AS state, {order_key('doc_id', 7, 'pool')} AS o FROM documents),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY o, doc_id::VARCHAR) AS r FROM d) WHERE r = 1) SELECT doc_id::VARCHAR AS guid FROM f ORDER BY o, guid LIMIT 80""")
def build_pool(spark, sf_dir):
    """A pool of questions in a drawn order, first ones of equal states, up to a target."""
    d = table(spark, sf_dir, "documents")
    made = shapes.choices_list(d, F.col("doc_id"), F.lit("mmlu"), F.lit("en"), F.col("text"), shapes.texts(["a", "b", "c"]), F.lit("A"))
    return builders.pooled(made, 80).select("guid")


@query("build_small_arity", f"""WITH n AS (SELECT list(DISTINCT l ORDER BY l) AS o FROM (SELECT 'name ' || (doc_id % 90) AS l FROM documents)),
    d AS (SELECT doc_id, 'name ' || (doc_id % 90) AS gold, {drawn("list_filter(o, lambda y: y <> 'name ' || (doc_id % 90))", "doc_id", 7, "others")}[1:(3 + floor({uniform('doc_id', 7, 'n')} * 3))::INTEGER] AS others FROM documents, n),
    s AS (SELECT doc_id, gold, {drawn("list_concat([gold], others)", "doc_id", 7, "shown")} AS options FROM d)
    SELECT doc_id, array_to_string(options, '|') AS options, (list_position(options, gold) - 1)::INTEGER AS label FROM s""")
def build_small_arity(spark, sf_dir):
    """A set of 90 names, too many for one choice, shown three to five others at a time."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("name "), F.col("doc_id") % 90).alias("name"))
    return builders.small_arity(d, "name", "doc_id").select("doc_id", F.array_join("options", "|").alias("options"), "label")


def tasks(spark, sf_dir) -> DataFrame:
    """Conversations as tasks of a web agent: a turn is a step; its positive element is the turn, its negatives the other turns."""
    c = table(spark, sf_dir, "conversations")
    attributes = F.to_json(F.struct(F.lit("").alias("placeholder"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("title"), F.col("role").alias("alt")))
    element = F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("tag"), attributes.alias("attributes"), (F.col("turn") % 3 == 0).alias("original"))
    each = c.select("conv_id", "turn", "role", element.alias("e"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "e"))).alias("turns"))
    op = lambda t: F.when(t["turn"] % 4 == 3, F.lit(None)).when(t["turn"] % 4 == 2, "TYPE").otherwise(F.upper(t["role"]))
    steps = F.transform("turns", lambda t: F.struct(op(t).alias("op"), F.array(t["e"]).alias("positive"), F.transform(F.filter("turns", lambda o: o["turn"] != t["turn"]), lambda o: o["e"]).alias("negative")))
    return whole.select(F.col("conv_id").cast("string").alias("task"), F.lit("do it").alias("instruction"), F.lit("site").alias("website"), F.transform("turns", lambda t: t["role"]).alias("summaries"), steps.alias("steps"))


SHOWN_ELEMENT = f"CASE WHEN t % 2 = 0 AND coalesce(x, '') <> '' THEN left({clean('x')}, 60) ELSE r END"
STEPS = f"""WITH n AS (SELECT conv_id, turn AS t, role AS r, text AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step FROM conversations),
    g AS (SELECT conv_id, list({{'t': t, 'r': r, 'x': {SHOWN_ELEMENT}}} ORDER BY t) AS turns FROM n GROUP BY conv_id),
    s AS (SELECT n.conv_id, step, CASE WHEN t % 4 = 2 THEN 'TYPE' ELSE 'CLICK' END AS op, t, concat_ws('-', n.conv_id::VARCHAR, step) AS key, turns, array_to_string(list_transform(turns[greatest(1, step - 3):step], lambda z: z.r), '|') AS history FROM n JOIN g USING (conv_id) WHERE t % 4 <> 3),
    p AS (SELECT *, {drawn("list_filter(turns, lambda z: z.t <> t)", "key", 7, "negatives")}[1:25] AS negatives, list_filter(turns, lambda z: z.t = t) AS positive FROM s),
    q AS (SELECT *, {drawn("list_concat(positive, negatives)", "key", 7, "pool")}[1:26] AS pool FROM p),
    e AS (SELECT *, list_transform(pool, lambda z, i: rtrim('[' || (i - 1) || '] <' || z.r || '> ' || z.x)) AS shown, list_position(list_transform(pool, lambda z: z.t), t) - 1 AS place FROM q)
    SELECT conv_id || '-step' || step || '-op' AS guid, history, 'CLICK|TYPE|SELECT' AS options, CASE op WHEN 'CLICK' THEN 0 ELSE 1 END AS label FROM e
    UNION ALL SELECT conv_id || '-step' || step || '-el', history, array_to_string(shown, '|'), place::INTEGER FROM e"""


@query("build_web_steps", STEPS)
def build_web_steps(spark, sf_dir):
    """Two decisions a step: the operation and the element among drawn others, with the last four summaries."""
    made = builders.web_steps(tasks(spark, sf_dir))
    return made.select("guid", F.array_join("history", "|").alias("history"), F.array_join("options", "|").alias("options"), "label")


@query("element_names", f"SELECT page_id, rtrim('[' || (page_id % 9) || '] <' || CASE WHEN page_id % 5 = 0 THEN '?' ELSE 'a' END || '> ' || left(CASE page_id % 4 WHEN 0 THEN 'p ' || page_id WHEN 1 THEN 'label' WHEN 2 THEN {clean('url')} ELSE '' END, 60)) AS element FROM pages")
def element_names(spark, sf_dir):
    """The first of seven attributes that isn't empty."""
    i = F.col("page_id")
    attributes = F.to_json(F.struct(F.when(i % 4 == 0, F.concat(F.lit("p  "), i.cast("string"))).otherwise("").alias("placeholder"), F.when(i % 4 == 1, "label").alias("aria-label"), F.when(i % 4 == 2, F.col("url")).alias("content")))
    return table(spark, sf_dir, "pages").select("page_id", builders.element_text(F.when(i % 5 != 0, "a"), attributes, i % 9).alias("element"))


@query("target_places", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::INTEGER AS place FROM documents")
def target_places(spark, sf_dir):
    """By the same element, by its id, else the first."""
    i = F.col("doc_id")
    one = lambda name, tag: F.struct(F.lit(name).alias("id"), F.lit(tag).alias("tag"))
    target = F.when(i % 3 == 0, one("b", "x")).when(i % 3 == 1, one("c", "other")).otherwise(one("z", "x"))
    return table(spark, sf_dir, "documents").select("doc_id", builders.target_place(F.array(one("a", "x"), one("b", "x"), one("c", "x")), target).alias("place"))


@query("drawn_orders", f"SELECT doc_id, array_to_string({drawn('[10, 20, 30, 40]', 'doc_id', 3)}, ',') AS items FROM documents")
def drawn_orders(spark, sf_dir):
    items = F.array(*(F.lit(x) for x in (10, 20, 30, 40)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(rand.permuted(items, F.col("doc_id"), 3), lambda x: x["item"].cast("string")), ",").alias("items"))
