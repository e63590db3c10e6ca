"""Queries on shapes, emission, validation and audits of decision rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decisia.functions import rand
from decisia.functions import text as X
from decisia.functions.once import once
from decisia.operators import audit, emit, shapes
from decisia.operators.normalize import normalised
from decisia.plans.registry import clean, norm, order_key, query, uniform
from decisia.session import spread, table

LANGS = ("de", "en", "es", "fr")
EVENTS = ("click", "error", "purchase", "signup", "view")
PRIORITIES = ("urgent", "high", "medium", "not specified", "low")


def shown_state(df: DataFrame) -> DataFrame:
    """What an adapter made, as scalars: the gold option and a digest of the state and the options."""
    state = F.array_join(F.transform(F.map_entries("state"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return df.select("guid", "kind", "label", F.try_element_at("options", F.col("label") + 1).alias("option"), F.md5(state).alias("state"), F.array_join("options", "|").alias("options"), F.round("p", 6).alias("p"))


def _sql(guid: str, kind: str, label: str, options: str, state: str, source: str, where: str = "true", p: str = "NULL::DOUBLE") -> str:
    """The same from SQL: options a list, state the joined text."""
    return f"""SELECT guid::VARCHAR AS guid, '{kind}' AS kind, label::INTEGER AS label, CASE WHEN label IS NOT NULL THEN o[label + 1] END AS option, md5(s) AS state, array_to_string(o, '|') AS options, round(p, 6) AS p
    FROM (SELECT {guid} AS guid, {label} AS label, {options} AS o, {state} AS s, {p} AS p FROM {source}) WHERE {where}"""


WITHIN = "label BETWEEN 0 AND len(o) - 1"


@query("shape_label_str", _sql("doc_id", "choice", "list_position(['de','en','es'], lang) - 1", "['de','en','es']", f"'language=' || lang || '|text=' || {clean('text')}", "documents", WITHIN))
def shape_label_str(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return shown_state(shapes.label_str(d, F.col("doc_id"), F.col("source"), F.col("lang"), F.col("text"), F.col("lang"), ("de", "en", "es")))


RAW = "CASE doc_id % 5 WHEN 0 THEN ' BAD ' WHEN 1 THEN '1' WHEN 2 THEN '7' WHEN 3 THEN '-1' ELSE 'good' END"


@query("shape_label_int", _sql("doc_id", "choice", f"CASE WHEN regexp_matches({RAW}, '^-*[0-9]+$') THEN ({RAW})::INTEGER ELSE list_position(['bad','good'], lower(trim({RAW}))) - 1 END", "['bad','good']", f"'language=' || lang || '|text=' || {clean('source')}", "documents", WITHIN))
def shape_label_int(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return shown_state(shapes.label_int(d, F.col("doc_id"), F.col("source"), F.col("lang"), F.col("source"), F.expr(RAW), ("bad", "good")))


@query("shape_nli", _sql("doc_id", "choice", "doc_id % 5 - 1", "['entailment','neutral','contradiction']", "'language=' || lang || '|premise=' || source || '|hypothesis=' || lang", "documents", WITHIN))
def shape_nli(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return shown_state(shapes.nli(d, F.col("doc_id"), F.col("source"), F.col("lang"), F.col("source"), F.col("lang"), F.col("doc_id") % 5 - 1))


@query("shape_nli_local", _sql("doc_id", "choice", "doc_id % 3", "CASE doc_id % 4 WHEN 0 THEN ['함의','중립','모순'] WHEN 1 THEN ['含意','中立','矛盾'] WHEN 2 THEN ['蕴含','中立','矛盾'] ELSE ['entailment','neutral','contradiction'] END", "'language=' || (CASE doc_id % 4 WHEN 0 THEN 'ko' WHEN 1 THEN 'ja' WHEN 2 THEN 'zh' ELSE lang END) || '|premise=' || source || '|hypothesis=' || lang", "documents", WITHIN))
def shape_nli_local(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lang = F.expr("CASE doc_id % 4 WHEN 0 THEN 'ko' WHEN 1 THEN 'ja' WHEN 2 THEN 'zh' ELSE lang END")
    return shown_state(shapes.nli_local(d, F.col("doc_id"), F.col("source"), lang, F.col("source"), F.col("lang"), F.col("doc_id") % 3))


@query("shape_pair_binary", _sql("o_orderkey", "choice", "o_custkey % 3", "['no','yes']", "'language=en|text=' || o_orderpriority || '|text_2=' || o_orderstatus", "orders", WITHIN))
def shape_pair_binary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return shown_state(shapes.pair_binary(o, F.col("o_orderkey"), F.lit("orders"), F.lit("en"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey") % 3))


@query("shape_ordinal", _sql("o_orderkey", "score", "left(o_orderpriority, 1)::INTEGER - 1", "['urgent','high','medium','not specified','low']", "'language=en|text=' || o_orderstatus", "orders", WITHIN))
def shape_ordinal(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return shown_state(shapes.ordinal(o, F.col("o_orderkey"), F.lit("orders"), F.lit("en"), F.col("o_orderstatus"), F.left("o_orderpriority", F.lit(1)).cast("int") - 1, PRIORITIES))


@query("shape_soft_binary", _sql("c_custkey", "noul", "NULL::INTEGER", "['No — the property is absent.','Yes — the property is present.']", "'language=en|text=' || c_name", "customer", p="least(1, greatest(0, (c_acctbal + 1000) / 8003))"))
def shape_soft_binary(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return shown_state(shapes.soft_binary(c, F.col("c_custkey"), F.lit("customer"), F.lit("en"), F.col("c_name"), F.col("c_acctbal"), scale=(-1000, 7003)))


ANSWER = "CASE p_partkey % 5 WHEN 0 THEN 'b' WHEN 1 THEN '2' WHEN 2 THEN p_type WHEN 3 THEN '9' ELSE 'none of these' END"
PART_OPTIONS = "[p_brand, p_type, p_name]"


@query("shape_choices_list", _sql("p_partkey", "choice", f"CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN list_position({PART_OPTIONS}, p_type) - 1 WHEN 3 THEN 8 ELSE list_position({PART_OPTIONS}, 'none of these') - 1 END", PART_OPTIONS, "'language=en|question=' || p_name", "part", WITHIN))
def shape_choices_list(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return shown_state(shapes.choices_list(p, F.col("p_partkey"), F.lit("part"), F.lit("en"), F.col("p_name"), F.array("p_brand", "p_type", "p_name"), F.expr(ANSWER)))


@query("shape_dict_choices", _sql("p_partkey", "choice", "list_position(['A','B','C'], CASE p_partkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'Z' END) - 1", "[p_type, p_name, p_brand]", "'language=en|question=' || p_name", "part", WITHIN))
def shape_dict_choices(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    choices = F.create_map(F.lit("C"), F.col("p_brand"), F.lit("A"), F.col("p_type"), F.lit("B"), F.col("p_name"))
    return shown_state(shapes.dict_choices(p, F.col("p_partkey"), F.lit("part"), F.lit("en"), F.col("p_name"), choices, F.expr("CASE p_partkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'Z' END")))


@query("shape_copa", _sql("p_partkey", "choice", "p_size % 3", "[p_brand, p_type]", "'language=en|premise=' || p_name || '|question=cause'", "part", WITHIN))
def shape_copa(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return shown_state(shapes.copa(p, F.col("p_partkey"), F.lit("part"), F.lit("en"), F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size") % 3, F.lit("cause")))


@query("shape_story", _sql("p_partkey", "choice", "p_size % 4 - 1", "[CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END, p_type]", "'language=en|story=' || p_name || ' ' || p_brand || ' ' || p_type || ' end'", "part", WITHIN + " AND NOT list_contains(o, '')"))
def shape_story(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    first = F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.col("p_brand"))
    return shown_state(shapes.story_cloze(p, F.col("p_partkey"), F.lit("part"), F.lit("en"), [F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit(" end ")], first, F.col("p_type"), (F.col("p_size") % 4).cast("string")))


@query("shape_abc", _sql("p_partkey", "choice", "p_size % 6 - 1", "[p_brand, p_type, p_name, 'none']", "'language=en|question=' || p_name", "part", WITHIN))
def shape_abc(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return shown_state(shapes.abc_columns(p, F.col("p_partkey"), F.lit("part"), F.lit("en"), F.col("p_name"), [F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.lit("none")], F.col("p_size") % 6, from_one=True))


@query("shape_blank_sentence", _sql("p_partkey", "choice", "p_size % 4 - 1", "[p_brand, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_type END]", "'language=ja|sentence=' || p_name", "part", WITHIN + " AND o[1] <> o[2]"))
def shape_blank_sentence(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    second = F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_type"))
    return shown_state(shapes.blank_sentence(p, F.col("p_partkey"), F.lit("part"), F.lit("jp"), F.col("p_name"), F.col("p_brand"), second, (F.col("p_size") % 4).cast("string")))


@query("shape_cause_effect", "SELECT CASE p_size % 3 WHEN 0 THEN 'Which alternative is the cause?' WHEN 1 THEN 'Which alternative is the effect?' ELSE 'Which alternative fits?' END AS instructions, count(*) AS n FROM part WHERE p_partkey % 3 < 2 GROUP BY 1")
def shape_cause_effect(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    question = F.expr("CASE p_size % 3 WHEN 0 THEN 'cause' WHEN 1 THEN 'effect' ELSE 'x' END")
    return shapes.cause_effect(p, F.col("p_partkey"), F.lit("part"), F.lit("en"), F.col("p_name"), question, F.col("p_brand"), F.col("p_type"), F.col("p_partkey") % 3).groupBy("instructions").agg(F.count("*").alias("n"))


@query("placeholder_drop", _sql("p_partkey", "choice", "list_position(k, g) - 1", "k", "'language=en|question=' || p_name", "(SELECT *, list_filter([p_brand, 'N/A', p_type, '', 'None'], lambda x: x <> '' AND lower(x) NOT IN ('none', 'n/a', 'na', 'null')) AS k, ([p_brand, 'N/A', p_type, '', 'None'])[p_size % 5 + 1] AS g FROM part)", WITHIN))
def placeholder_drop(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    options = F.array(F.col("p_brand"), F.lit("N/A"), F.col("p_type"), F.lit(" "), F.lit("None"))
    return shown_state(shapes.placeholder_options(p, F.col("p_partkey"), F.lit("part"), F.lit("en"), F.col("p_name"), options, F.col("p_size") % 5))


@query("shape_lettered_options", _sql("p_partkey", "choice", "p_size % 4", "[p_brand, p_type, 'last one']", "'language=en|question=' || p_name", "part", WITHIN))
def shape_lettered_options(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    joined = F.concat(F.lit("a ) "), F.col("p_brand"), F.lit(" , b ) "), F.col("p_type"), F.lit(" , c ) last one"))
    return shown_state(shapes.lettered_options(p, F.col("p_partkey"), F.lit("part"), F.lit("en"), F.col("p_name"), joined, F.expr("element_at(array('a','b','c','d'), cast(p_size % 4 as int) + 1)")))


@query("shape_parallel_questions", _sql("p_partkey", "choice", "CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END", "[p_brand, p_type, 'x']", "'language=en|text=' || left(p_name, 5) || '|question=second'", "part"))
def shape_parallel_questions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    choices = F.array(F.array("p_brand", "p_type"), F.array(F.col("p_brand"), F.col("p_type"), F.lit("x")), F.array(F.lit("y"), F.lit("z"), F.lit("w")))
    answers = F.array(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("x"), F.lit("y"))
    return shown_state(shapes.parallel_questions(p, F.col("p_partkey"), F.lit("part"), F.lit("en"), F.col("p_name"), F.array(F.lit("first"), F.lit("second"), F.lit("third")), choices, answers, most_chars=5))


@query("shape_code_names", _sql("event_id", "choice", "list_position(['click','error','view'], event_type) - 1", "['a click','an error','a view']", "'language=en|text=' || user_id", "events", WITHIN))
def shape_code_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return shown_state(shapes.code_names(e, F.col("event_id"), F.lit("events"), F.lit("en"), F.col("user_id"), F.col("event_type"), {"click": "a click", "error": "an error", "view": "a view"}))


@query("shape_suite", "SELECT workflow, count(*) AS n FROM (SELECT lang AS workflow FROM documents WHERE lang = 'en' UNION ALL SELECT lang FROM documents WHERE lang = 'de' AND doc_id % 3 < 2) GROUP BY workflow")
def shape_suite(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    made = shapes.suite(
        d, F.col("lang"),
        {
            "en": lambda x: shapes.label_str(x, F.col("doc_id"), F.col("lang"), F.col("lang"), F.col("text"), F.col("lang"), LANGS),
            "de": lambda x: shapes.pair_binary(x, F.col("doc_id"), F.col("lang"), F.col("lang"), F.col("text"), F.col("source"), F.col("doc_id") % 3),
        },
    )
    return made.groupBy("workflow").agg(F.count("*").alias("n"))


#: The checksum of a text bit by bit: each byte, then seven marks that only shift.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: [('0x' || x)::BIGINT, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, b: xor((CASE WHEN b >= 0 THEN xor(c, b) ELSE c END) >> 1, 3988292384 * ((CASE WHEN b >= 0 THEN xor(c, b) ELSE c END) & 1))), 4294967295)"""
EMOTIONS_SQL = "[" + ", ".join(f"'{e}'" for e in shapes.EMOTIONS) + "]"


@query("crc32_binary_query", f"""WITH c AS (SELECT doc_id, {clean('text')} AS t, list_sort(list_distinct([doc_id % 28, doc_id % 5])) AS own FROM documents),
h AS (SELECT *, {CRC32} AS h FROM c WHERE t <> ''),
p AS (SELECT *, CASE WHEN h % 2 = 0 THEN own ELSE list_filter(range(28), lambda x: NOT list_contains(own, x)) END AS pool FROM h)
SELECT doc_id::VARCHAR AS guid, {EMOTIONS_SQL}[pool[1 + (h // 2) % len(pool)] + 1] AS emotion, CASE WHEN h % 2 = 0 THEN 0.85 ELSE 0.15 END::DOUBLE AS p FROM p""")
def crc32_binary_query(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    labels = F.array((F.col("doc_id") % 28).cast("int"), (F.col("doc_id") % 5).cast("int"))
    made = shapes.emotion_query(d, F.col("doc_id"), F.col("source"), F.col("text"), labels)
    return made.select("guid", F.element_at("state", "emotion").alias("emotion"), "p")


def lang_choices(spark, sf_dir) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    return shapes.label_str(d, F.col("doc_id"), F.col("source"), F.col("lang"), F.col("text"), F.col("lang"), LANGS, instructions="Which language is it?")


SHOWN = f"(SELECT doc_id, lang, string_agg(o, '|' ORDER BY {order_key('doc_id', 7, '=i')}) AS shown, list(o ORDER BY {order_key('doc_id', 7, '=i')}) AS options FROM documents, (VALUES (0, 'de'), (1, 'en'), (2, 'es'), (3, 'fr')) v(i, o) GROUP BY doc_id, lang)"


@query("emit_permuted", f"SELECT doc_id::VARCHAR AS guid, shown, (list_position(options, lang) - 1)::INTEGER AS gold FROM {SHOWN}")
def emit_permuted(spark, sf_dir):
    return emit.shown(lang_choices(spark, sf_dir)).select("guid", F.array_join("shown", "|").alias("shown"), "gold")


@query("emit_rows", f"SELECT gold_letter, count(*) AS n FROM (SELECT chr((64 + list_position(options, lang))::INTEGER) AS gold_letter FROM {SHOWN}) GROUP BY gold_letter")
def emit_rows(spark, sf_dir):
    """Whole decision rows, read back from their JSON."""
    kept = normalised(emit.decision_rows(lang_choices(spark, sf_dir)))
    letter = F.element_at("keys", audit.gold_place(F.col("probs")) + 1)
    return kept.where("reason is null").groupBy(letter.alias("gold_letter")).agg(F.count("*").alias("n"))


BRANDS = "(SELECT list(DISTINCT p_brand ORDER BY p_brand) AS o FROM part)"


@query(
    "distractor_bucket",
    f"""WITH b AS {BRANDS}, p AS (SELECT p_partkey, p_brand, o, list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+'), lambda x: length(x) > 2)) AS st FROM part, b),
    e AS (SELECT p_partkey, p_brand, unnest(o) AS opt, unnest(range(len(o))) AS i, st, o FROM p),
    v AS (SELECT *, least(len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(opt), '[a-z0-9]+'), lambda x: length(x) > 2)), st)), 2) AS bkt FROM e),
    g AS (SELECT p_partkey, bkt AS gb FROM v WHERE opt = p_brand),
    c AS (SELECT v.p_partkey, i, row_number() OVER (PARTITION BY v.p_partkey ORDER BY {order_key('v.p_partkey', 7, '=(row_no)')}) AS r, count(*) OVER (PARTITION BY v.p_partkey) AS m
      FROM (SELECT v.*, row_number() OVER (PARTITION BY v.p_partkey ORDER BY i) - 1 AS row_no FROM v JOIN g ON v.p_partkey = g.p_partkey WHERE opt <> p_brand AND bkt = gb) v)
    SELECT p_partkey, string_agg(i::VARCHAR, ',' ORDER BY r) AS places FROM c WHERE m >= 3 AND r <= least(m, 3 + floor({uniform('p_partkey', 7, 'n')} * 3)) GROUP BY p_partkey""",
)
def distractor_bucket(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.withColumn("options", emit.names_of(p, "p_brand"))
    label = (F.array_position("options", F.col("p_brand")) - 1).cast("int")
    places = emit.distractors(F.col("options"), label, F.concat_ws(" ", "p_name", "p_brand"), F.col("p_partkey"), 3, 5, 7)
    return rows.select("p_partkey", places.alias("places")).where("places is not null").select("p_partkey", F.array_join("places", ",").alias("places"))


@query(
    "hard_negatives",
    """WITH l AS (SELECT DISTINCT p_type AS label, list_filter(string_split(p_type, ' '), lambda t: length(t) > 2) AS own FROM part)
    SELECT label, other, overlap, place FROM (SELECT a.label, b.label AS other, len(list_intersect(a.own, b.own))::INTEGER AS overlap, row_number() OVER (PARTITION BY a.label ORDER BY len(list_intersect(a.own, b.own)) DESC, b.label)::INTEGER AS place FROM l a JOIN l b ON a.label <> b.label) WHERE place <= 5""",
)
def hard_negatives(spark, sf_dir):
    return emit.hard_negatives(table(spark, sf_dir, "part").select(F.col("p_type").alias("label")).distinct(), "label", 5, " ")


# One row in 24 for each way in which a row can be kept or refused.
OUTCOMES = (
    "kept", "bad_json", "bad_shape", "gold_qid_missing", "bad_gold", "negative_gold", "gold_zero_sum", "bad_criteria", "criteria_gold_key_mismatch", "choice_arity_gt_16", "score_keys_not_ordinal", "score_gold_key_mismatch",
    "noul_gold_keys", "unknown_qtype", "forbidden_state_key", "answer_marker_in_state", "empty_state", "kept", "kept", "kept", "kept", "kept", "bad_gold", "bad_json",
)
ABC, HOT = '{"A":"a","B":"b","C":"c"}', '{"A":1.0,"B":0.0,"C":0.0}'
WIDE = "{" + ",".join(f'"o{i}":"x"' for i in range(17)) + "}"
WIDE_GOLD = "{" + ",".join(f'"o{i}":{1 if i == 0 else 0}' for i in range(17)) + "}"


def _case(table_: dict[int, str], otherwise: str):
    out = None
    for v, value in table_.items():
        out = F.when(F.col("doc_id") % 24 == v, value) if out is None else out.when(F.col("doc_id") % 24 == v, value)
    return out.otherwise(otherwise)


def test_rows(spark, sf_dir) -> DataFrame:
    """Decision rows made from documents, of which each kind in 24 has its own outcome."""
    q = lambda body: '{"decision":{' + body + "}}"
    choice = lambda c: q(f'"type":"choice","instructions":"i","criteria":{c}')
    g = lambda p: '{"decision":{"probabilities":' + p + "}}"
    questions = {
        1: "{bad", 2: '{"a":{"type":"choice"},"b":{"type":"choice"}}', 7: choice('{"A":"a"}'), 8: choice('{"A":"a","B":"b","D":"d"}'), 9: choice(WIDE), 10: q('"type":"score","criteria":{"0":"a","2":"b"}'),
        11: q('"type":"score","criteria":["a","b","c"]'), 12: q('"type":"noul"'), 13: q('"type":"span","criteria":["x"]'), 17: q('"type":"noul","criteria":{"false":"n","true":"y"}'), 18: q('"type":"score","criteria":{"2":"c","0":"a","1":"b"}'),
        19: '{"topic":{"type":"choice","instructions":"i","criteria":' + ABC + "}}",
    }
    golds = {
        3: '{"other":{"probabilities":' + HOT + "}}", 4: g('{"A":"x","B":0,"C":0}'), 5: g('{"A":-0.5,"B":1,"C":0.5}'), 6: g('{"A":0,"B":0,"C":0}'), 7: g('{"A":1}'), 9: g(WIDE_GOLD), 10: g('{"0":1,"2":0}'), 11: g('{"0":1,"1":0}'),
        12: g('{"0":1,"1":0}'), 17: g('{"false":0.15,"true":0.85}'), 18: g('{"0":0,"1":1,"2":0}'), 19: '{"topic":{"probabilities":' + HOT + "}}", 20: g('{"A":2,"B":1,"C":1}'), 22: '{"decision":{}}',
    }
    base = F.to_json(F.struct(F.col("lang").alias("language"), "text"))
    one_of_ten = F.to_json(F.struct(F.col("lang").alias("language"), F.concat(F.lit("one state of many rows, number "), F.floor(F.col("doc_id") / 240).cast("string")).alias("text")))
    v = F.col("doc_id") % 24
    state = (
        F.when(v == 14, F.to_json(F.struct(F.lit("x").alias("Label"), "text"))).when(v == 15, F.to_json(F.struct(F.concat("text", F.lit(" Answer: B")).alias("text"))))
        .when(v == 16, '{"t":"x"}').when(v == 19, one_of_ten).when(v == 21, F.concat(F.lit('"a bare text, number '), F.col("doc_id").cast("string"), F.lit('"'))).when(v == 23, "not json").otherwise(base)
    )
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("guid"), F.col("source").alias("workflow"), "doc_id", "lang", state.alias("state"), _case(questions, choice(ABC)).alias("questions"), _case(golds, g(HOT)).alias("gold"))


#: The normal text of a row's state, in SQL.
STATE_NORM = norm("CASE doc_id % 24 WHEN 19 THEN 'language=' || lang || ' || text=one state of many rows, number ' || (doc_id // 240) WHEN 21 THEN 'a bare text, number ' || doc_id ELSE 'language=' || lang || ' || text=' || text END")


def held_out(spark, sf_dir) -> DataFrame:
    """Keys of states that no mix may hold: those of labelled documents marked as toxic."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return docs.select(X.key_of(X.norm_text(F.concat(F.lit("language="), "lang", F.lit(" || text="), "text"))).alias("key"))


HELD_OUT = f"(SELECT substr(sha256({norm("'language=' || lang || ' || text=' || text")}), 1, 16) AS key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"


OUTCOME = "CASE doc_id % 24 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(OUTCOMES)) + " END"


@query("normalize_reasons", f"SELECT doc_id, {OUTCOME} AS reason FROM documents")
def normalize_reasons(spark, sf_dir):
    return normalised(test_rows(spark, sf_dir)).select("doc_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("normalize_notes", "SELECT doc_id, CASE doc_id % 24 WHEN 18 THEN 'score_dict_to_list' WHEN 19 THEN 'qid_renamed' WHEN 20 THEN 'gold_rescaled' ELSE '' END AS notes, CASE doc_id % 24 WHEN 17 THEN '0.15,0.85' WHEN 18 THEN '0,1,0' WHEN 20 THEN '0.5,0.25,0.25' ELSE '1,0,0' END AS probs FROM documents WHERE doc_id % 24 IN (0, 17, 18, 19, 20, 21)")
def normalize_notes(spark, sf_dir):
    kept = normalised(test_rows(spark, sf_dir)).where("reason is null")
    shown = F.array_join(F.transform("probs", lambda p: F.regexp_replace(F.round(p, 4).cast("string"), r"\.0$", "")), ",")
    return kept.select("doc_id", F.array_join("notes", ",").alias("notes"), shown.alias("probs"))


@query("score_dict_to_list", "SELECT doc_id, '0|1|2' AS keys, 'a|b|c' AS texts FROM documents WHERE doc_id % 24 = 18")
def score_dict_to_list(spark, sf_dir):
    kept = normalised(test_rows(spark, sf_dir)).where("array_contains(notes, 'score_dict_to_list')")
    return kept.select("doc_id", F.array_join("keys", "|").alias("keys"), F.array_join("texts", "|").alias("texts"))


@query("gold_rescale", "SELECT l_orderkey, l_linenumber, round(l_quantity / (l_quantity + l_linenumber + 1), 6) AS p0, round(l_linenumber / (l_quantity + l_linenumber + 1), 6) AS p1 FROM lineitem")
def gold_rescale(spark, sf_dir):
    from decisia.functions.vectors import normalised as unit

    v = unit(F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(1.0)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(v[0], 6).alias("p0"), F.round(v[1], 6).alias("p1"))


@query("gold_zero_sum", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '0.25,0.25,0.25,0.25' ELSE round((doc_id % 4) / (doc_id % 4 + 6.0::DOUBLE), 6) || ',' || round(1 / (doc_id % 4 + 6.0::DOUBLE), 6) || ',' || round(2 / (doc_id % 4 + 6.0::DOUBLE), 6) || ',' || round(3 / (doc_id % 4 + 6.0::DOUBLE), 6) END AS probs FROM documents")
def gold_zero_sum(spark, sf_dir):
    """A target that sums to zero becomes even."""
    from decisia.functions.vectors import normalised as unit

    i = (F.col("doc_id") % 4).cast("double")
    raw = F.when(i == 0, F.array_repeat(F.lit(0.0), 4)).otherwise(F.array(i, F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(unit(raw), lambda v: F.round(v, 6).cast("string")), ",").alias("probs"))


@query("noul_rows", "SELECT doc_id::VARCHAR AS guid, round(1 - (doc_id % 9) / 8.0, 6)::DOUBLE AS no, round((doc_id % 9) / 8.0, 6)::DOUBLE AS yes FROM documents")
def noul_rows(spark, sf_dir):
    """Yes-or-no rows emitted and read back: false is one less true."""
    d = table(spark, sf_dir, "documents")
    flagged = shapes.soft_binary(d, F.col("doc_id"), F.col("source"), F.lit("en"), F.concat(F.lit("document number "), F.col("doc_id")), F.col("doc_id") % 9 / 8)
    kept = normalised(emit.decision_rows(flagged)).where("reason is null")
    return kept.select("guid", F.round(F.col("probs")[0], 6).alias("no"), F.round(F.col("probs")[1], 6).alias("yes"))


@query("one_hot_check", "SELECT count(*) FILTER (WHERE doc_id % 24 NOT IN (17, 20)) AS one_hot, count(*) FILTER (WHERE doc_id % 24 IN (17, 20)) AS soft FROM documents WHERE doc_id % 24 IN (0, 17, 18, 19, 20, 21)")
def one_hot_check(spark, sf_dir):
    kept = normalised(test_rows(spark, sf_dir)).where("reason is null")
    return kept.agg(F.count_if(audit.one_hot(F.col("probs"))).alias("one_hot"), F.count_if(audit.is_soft(F.col("probs"))).alias("soft"))


@query("source_rollup", f"SELECT source, count(*) AS rows_in, count(*) FILTER (WHERE {OUTCOME} = 'kept') AS rows_out, count(*) FILTER (WHERE {OUTCOME} <> 'kept') AS dropped FROM documents GROUP BY ROLLUP (source)")
def source_rollup(spark, sf_dir):
    rows = normalised(test_rows(spark, sf_dir))
    return audit.accounting(rows, "workflow", F.col("reason").isNull()).withColumnRenamed("workflow", "source")


@query("reason_by_source", f"SELECT source, {OUTCOME} AS reason, count(*) AS n FROM documents GROUP BY ALL")
def reason_by_source(spark, sf_dir):
    return normalised(test_rows(spark, sf_dir)).groupBy(F.col("workflow").alias("source"), F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "verify_audit",
    f"""WITH d AS (SELECT doc_id, source, length({norm("'text=' || text")}) AS size, substr(sha256({norm("'text=' || text")}), 1, 16) AS key FROM documents),
    w AS (SELECT *, row_number() OVER (PARTITION BY key, source ORDER BY doc_id) AS i, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS a FROM d)
    SELECT source AS file, count(*) AS rows, count(*) FILTER (WHERE doc_id % 11 = 0) AS bad_gold_sum, count(*) FILTER (WHERE doc_id % 13 = 0 OR doc_id % 17 = 0) AS bad_arity, count(*) FILTER (WHERE doc_id % 4 = 0 OR doc_id % 19 = 0) AS leak,
      count(*) FILTER (WHERE doc_id % 19 = 0) AS forbidden_key, count(*) FILTER (WHERE doc_id % 23 = 0 OR size < 10) AS empty_state, count(*) FILTER (WHERE i > 1) AS dup_in_group, count(*) FILTER (WHERE a > 1) AS dup_anywhere FROM w GROUP BY source""",
)
def verify_audit(spark, sf_dir):
    """Every counter has rows: golds that don't sum to one, one option only, noul rows without their keys, leaks, keys that give answers, empty states, copies."""
    i = F.col("doc_id")
    marked = F.concat("text", F.when(i % 4 == 0, " Answer: B").otherwise(""))
    state = F.when(i % 19 == 0, F.to_json(F.struct(marked.alias("Label")))).otherwise(F.to_json(F.struct(marked.alias("text"))))
    one, two = F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0))
    probs = F.when(i % 13 == 0, one).otherwise(two)
    probs = F.when(i % 11 == 0, F.transform(probs, lambda p: p * 0.5)).otherwise(probs)
    keys = F.when(i % 13 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    text = F.col("_norm")
    rows = once(spread(table(spark, sf_dir, "documents")), _norm=X.norm_text(F.concat(F.lit("text="), "text"))).select(
        F.col("source").alias("file"), "doc_id", F.when((i % 17 == 0) & (i % 13 != 0), "noul").otherwise("choice").alias("qtype"), keys.alias("keys"), probs.alias("probs"), state.alias("state"),
        F.when(i % 23 == 0, "short").otherwise(text).alias("norm"), X.key_of(text).alias("key"),
    )
    return audit.verify(rows, "file", "doc_id")


GOLD_POS = "(SELECT doc_id, source, 2 + doc_id % 3 AS k, (doc_id * 7 // 3) % (2 + doc_id % 3) AS pos, CASE WHEN doc_id % 2 = 0 THEN 'letter' ELSE 'name' END AS ns FROM documents)"


def gold_places(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = (2 + F.col("doc_id") % 3).cast("long")
    keys = F.when(F.col("doc_id") % 2 == 0, F.slice(F.array(*(F.lit(c) for c in "ABCD")), 1, k.cast("int"))).otherwise(F.slice(F.array(*(F.lit(c) for c in ("no", "maybe", "yes", "always"))), 1, k.cast("int")))
    return d.select("doc_id", "source", k.alias("k"), F.pmod(F.floor(F.col("doc_id") * 7 / 3), k).alias("pos"), keys.alias("keys")).withColumn("ns", audit.key_namespace(F.col("keys")))


@query("posdev_verify", f"WITH c AS (SELECT k, pos, count(*) AS n FROM {GOLD_POS} GROUP BY ALL), d AS (SELECT k, n, abs(n / sum(n) OVER (PARTITION BY k) - 1.0::DOUBLE / count(*) OVER (PARTITION BY k)) AS far FROM c) SELECT k, sum(n)::BIGINT AS rows, round(max(far), 4) AS deviation FROM d GROUP BY k")
def posdev_verify(spark, sf_dir):
    return audit.position_bias_seen(gold_places(spark, sf_dir), "k", "pos")


@query("posdev_true", f"WITH c AS (SELECT ns, k, pos, count(*) AS n FROM {GOLD_POS} GROUP BY ALL), d AS (SELECT ns, k, n, abs(n / sum(n) OVER (PARTITION BY ns, k) - 1.0::DOUBLE / k) AS far FROM c) SELECT ns, k, sum(n)::BIGINT AS rows, count(*) AS distinct_gold, round(max(far), 4) AS deviation FROM d GROUP BY ns, k")
def posdev_true(spark, sf_dir):
    return audit.position_bias(gold_places(spark, sf_dir), "ns", "k", "pos")


@query("orders_per_group", f"SELECT source, least(count(DISTINCT ns || k), 200)::BIGINT AS orders, count(*) FILTER (WHERE ns = 'letter') AS alphabetical, count(*) AS rows FROM {GOLD_POS} GROUP BY source")
def orders_per_group(spark, sf_dir):
    found = audit.key_orders(gold_places(spark, sf_dir), "source", "keys")
    return found.select("source", F.col("orders").cast("long").alias("orders"), "alphabetical", "rows")


@query(
    "shortcut_metric",
    f"""WITH b AS {BRANDS}, e AS (SELECT p_brand, unnest(o) AS opt, list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda x: length(x) > 2)) AS st FROM part, b),
    v AS (SELECT opt = p_brand AS gold, len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(opt), '[a-z0-9]+'), lambda x: length(x) > 2)), st)) AS s FROM e)
    SELECT round(avg((s > 0)::INTEGER) FILTER (WHERE gold), 6) AS gold_rate, round(avg((s > 0)::INTEGER) FILTER (WHERE NOT gold), 6) AS other_rate, round(avg(s) FILTER (WHERE gold), 6) AS gold_words, round(avg(s) FILTER (WHERE NOT gold), 6) AS other_words FROM v""",
)
def shortcut_metric(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.withColumn("options", emit.names_of(p, "p_brand"))
    return audit.shortcuts(rows, F.concat_ws(" ", "p_name", "p_type"), F.col("options"), F.array_position("options", F.col("p_brand")) - 1)


@query("web_steps_two_rows", f"SELECT conv_id, turn, kind, value, coalesce(history, '') AS history FROM (SELECT conv_id, turn, role, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '|') AS history, left({clean('text')}, 60) AS t FROM conversations), LATERAL (SELECT 'op' AS kind, CASE WHEN role IN ('user', 'assistant') THEN upper(role) ELSE 'CLICK' END AS value UNION ALL SELECT 'element', t)")
def web_steps_two_rows(spark, sf_dir):
    history = F.array_join(F.collect_list("role").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)), "|")
    steps = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.left(X.clean(F.col("text")), F.lit(60)).alias("t"), history.alias("history"))
    op = F.when(F.col("role").isin("user", "assistant"), F.upper("role")).otherwise("CLICK")
    two = F.explode(F.array(F.struct(F.lit("op").alias("kind"), op.alias("value")), F.struct(F.lit("element").alias("kind"), F.col("t").alias("value"))))
    return steps.select("conv_id", "turn", "history", two.alias("r")).select("conv_id", "turn", "r.kind", "r.value", "history")


@query("history_window", "SELECT conv_id, turn, coalesce(array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '|'), '') AS history FROM conversations")
def history_window(spark, sf_dir):
    history = F.collect_list("role").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(history, "|").alias("history"))


@query("element_pool", f"SELECT p_partkey, string_agg(x, ',' ORDER BY h) AS pool FROM (SELECT p_partkey, x, {order_key('p_partkey', 'pool', '=x')} AS h, row_number() OVER (PARTITION BY p_partkey ORDER BY {order_key('p_partkey', 'pool', '=x')}) AS r FROM (SELECT p_partkey, p_brand, unnest(o) AS x FROM part, {BRANDS}) WHERE x <> p_brand) WHERE r <= 5 GROUP BY p_partkey")
def element_pool(spark, sf_dir):
    """Candidates of a step: a drawn few of the negatives."""
    p = table(spark, sf_dir, "part")
    rows = p.withColumn("options", emit.names_of(p, "p_brand"))
    drawn = F.array_sort(F.transform(F.array_except("options", F.array("p_brand")), lambda o: F.struct(rand.order_key(F.col("p_partkey"), "pool", o).alias("h"), o.alias("o"))))
    return rows.select("p_partkey", F.array_join(F.transform(F.slice(drawn, 1, 5), lambda x: x["o"]), ",").alias("pool"))


@query("manifest_row", f"""SELECT (SELECT count(*) FROM documents WHERE {OUTCOME} = 'kept') AS rows, (SELECT count(*) = count(DISTINCT {STATE_NORM}) FROM documents WHERE {OUTCOME} = 'kept') AS verify_pass,
    (SELECT count(*) FROM documents WHERE {OUTCOME} = 'kept' AND substr(sha256({STATE_NORM}), 1, 16) IN (SELECT key FROM {HELD_OUT})) AS overlap,
    (SELECT count(*) = 0 FROM documents WHERE {OUTCOME} = 'kept' AND substr(sha256({STATE_NORM}), 1, 16) IN (SELECT key FROM {HELD_OUT})) AS leak_pass,
    (SELECT round(max(far), 4) FROM (SELECT abs(n / sum(n) OVER (PARTITION BY k) - 1.0::DOUBLE / k) AS far FROM (SELECT k, pos, count(*) AS n FROM {GOLD_POS} GROUP BY ALL))) AS max_deviation,
    (SELECT round(max(far), 4) <= 0.15 FROM (SELECT abs(n / sum(n) OVER (PARTITION BY k) - 1.0::DOUBLE / k) AS far FROM (SELECT k, pos, count(*) AS n FROM {GOLD_POS} GROUP BY ALL))) AS bias_pass""")
def manifest_row(spark, sf_dir):
    """The gates before dedup and anti-join: they find the planted copies and held-out states."""
    from decisia.operators.dedup import overlap

    kept = normalised(test_rows(spark, sf_dir)).where("reason is null").withColumn("key", X.key_of(F.col("norm")))
    bias = audit.position_bias(gold_places(spark, sf_dir).withColumn("one", F.lit("all")), "one", "k", "pos")
    return audit.gates(audit.verify(kept, "workflow", "doc_id"), overlap(kept, "workflow", "key", held_out(spark, sf_dir), "doc_id"), bias)


#: The place of a row's source in the list of sources: the priority of first-wins dedup.
SOURCE_ORD = "(replace(source, 'src', '')::INTEGER * 7) % 10"
KEPT = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY {SOURCE_ORD}, doc_id) AS place FROM (SELECT doc_id, source, {STATE_NORM} AS state FROM documents WHERE {OUTCOME} = 'kept')
    WHERE substr(sha256(state), 1, 16) NOT IN (SELECT key FROM {HELD_OUT})) WHERE place = 1)"""


def mix_rows(spark, sf_dir) -> DataFrame:
    place = F.replace("workflow", F.lit("src"), F.lit("")).cast("int") * 7 % 10
    return test_rows(spark, sf_dir).withColumn("source_ord", place)


@query("mix_pipeline", f"SELECT source, qtype, count(*) AS n, sum(soft::INTEGER)::BIGINT AS soft, min(doc_id) AS first_id, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, source, CASE doc_id % 24 WHEN 17 THEN 'noul' WHEN 18 THEN 'score' ELSE 'choice' END AS qtype, doc_id % 24 IN (17, 20) AS soft FROM {KEPT}) GROUP BY source, qtype")
def mix_pipeline(spark, sf_dir):
    """Rows from the sources validated and repaired, first ones of equal states kept, held-out states left out, counted."""
    from decisia.plans.mix import mixed

    rows = mixed(mix_rows(spark, sf_dir), held_out(spark, sf_dir), "source_ord", "doc_id")
    return rows.groupBy(F.col("workflow").alias("source"), "qtype").agg(F.count("*").alias("n"), F.count_if(audit.is_soft(F.col("probs"))).alias("soft"), F.min("doc_id").alias("first_id"), F.sum("doc_id").alias("ids"))


@query("mix_outcomes", f"""WITH k AS (SELECT doc_id, source, {OUTCOME} AS reason, {STATE_NORM} AS state FROM documents),
    h AS (SELECT *, CASE WHEN reason = 'kept' AND substr(sha256(state), 1, 16) IN (SELECT key FROM {HELD_OUT}) THEN 'held_out' ELSE reason END AS r FROM k)
    SELECT r AS reason, count(*) AS n FROM (SELECT CASE WHEN r = 'kept' AND row_number() OVER (PARTITION BY state, r ORDER BY {SOURCE_ORD}, doc_id) > 1 THEN 'duplicate_state' ELSE r END AS r FROM h) GROUP BY r""")
def mix_outcomes(spark, sf_dir):
    """What became of every row: the accounting of the mix."""
    from decisia.plans.mix import outcomes

    return outcomes(mix_rows(spark, sf_dir), held_out(spark, sf_dir), "source_ord", "doc_id").groupBy("reason").agg(F.count("*").alias("n"))
