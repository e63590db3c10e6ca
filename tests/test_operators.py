"""Operators on hand-made rows: validation reasons, batches, sources and sinks, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from decisia.functions import text as X
from decisia.operators import emit, layout, metrics, sample, shapes
from decisia.operators.normalize import normalised
from decisia.plans import mix
from decisia.sources import files
from decisia.streaming import events

Q = '{"decision":{"type":"choice","instructions":"i","criteria":{"A":"x","B":"y"}}}'
G = '{"decision":{"probabilities":{"A":1.0,"B":0.0}}}'
S = '{"language":"en","text":"a state that is long enough"}'


def row(state=S, questions=Q, gold=G):
    return ("g", "w", state, questions, gold)


def question(**kw):
    return json.dumps({"decision": {"type": "choice", "instructions": "i", "criteria": {"A": "x", "B": "y"}} | kw})


def gold(p):
    return json.dumps({"decision": {"probabilities": p}})


CASES = [
    (row(), None),
    (row(state="{oops"), "bad_json"),
    (row(questions="{oops"), "bad_json"),
    (row(gold=None), "bad_json"),
    (row(questions='{"a":{},"b":{}}'), "bad_shape"),
    (row(questions="[1]"), "bad_shape"),
    (row(gold='{"x":{"probabilities":{"A":1}}}'), "gold_qid_missing"),
    (row(gold=gold({})), "bad_gold"),
    (row(gold=gold({"A": "much", "B": 0})), "bad_gold"),
    (row(gold='{"decision":{"probabilities":{"A":NaN,"B":0}}}'), "bad_json"),
    (row(gold=gold({"A": -1, "B": 2})), "negative_gold"),
    (row(gold=gold({"A": 0, "B": 0})), "gold_zero_sum"),
    (row(questions=question(criteria={"A": "x"}), gold=gold({"A": 1})), "bad_criteria"),
    (row(questions=question(criteria=["x", "y"])), "bad_criteria"),
    (row(gold=gold({"A": 1, "C": 0})), "criteria_gold_key_mismatch"),
    (row(questions=question(criteria={str(i): "x" for i in range(17)}), gold=gold({str(i): 1 for i in range(17)})), "choice_arity_gt_16"),
    (row(questions=question(type="score", criteria={"0": "a", "2": "b"}), gold=gold({"0": 1, "2": 0})), "score_keys_not_ordinal"),
    (row(questions=question(type="score", criteria={"a": "a"}), gold=gold({"a": 1})), "bad_criteria"),
    (row(questions=question(type="score", criteria=["a", "b"]), gold=gold({"0": 1})), "score_gold_key_mismatch"),
    (row(questions=question(type="score", criteria=["a", "b"]), gold=gold({"0": 1, "1": 0})), None),
    (row(questions=question(type="noul", criteria=None), gold=gold({"0": 1, "1": 0})), "noul_gold_keys"),
    (row(questions=question(type="noul", criteria=None), gold=gold({"false": 0.4, "true": 0.6})), None),
    (row(questions=question(type="span")), "unknown_qtype"),
    (row(state='{"Label":"x","text":"a state that is long enough"}'), "forbidden_state_key"),
    (row(state='{"text":"a long state. Answer: B"}'), "answer_marker_in_state"),
    (row(state='{"text":"정답: 2 and a long state"}'), "answer_marker_in_state"),
    (row(state='{"t":"x"}'), "empty_state"),
    (row(state='"a bare text, long enough"'), None),
]


def test_reasons(spark):
    rows = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(CASES)], "i int, guid string, workflow string, state string, questions string, gold string")
    got = {r["i"]: r["reason"] for r in normalised(rows).select("i", "reason").collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(CASES)}


def test_canonical_forms(spark):
    rows = spark.createDataFrame([row(questions=question(type="score", criteria={"1": "b", "0": "a"}), gold=gold({"1": 3, "0": 1})), row(gold=gold({"B": 1, "A": 1}))], files.ROW)
    a, b = normalised(rows).collect()
    assert (a["keys"], a["texts"], a["probs"], a["notes"]) == (["0", "1"], ["a", "b"], [0.25, 0.75], ["score_dict_to_list", "gold_rescaled"])
    assert (b["keys"], b["probs"]) == (["A", "B"], [0.5, 0.5])
    assert normalised(rows, rescale=False).first()["probs"] == [1.0, 3.0]


def test_state_text(spark):
    states = spark.createDataFrame([('{"b":" X  y","a":"é"}',), ('"Just\\n text"',), ("not json",), (None,)], "s string")
    assert [r[0] for r in states.select(X.norm_state(F.col("s"))).collect()] == ["a=é || b= x y", "just text", "not json", None]


def test_answers_in_order(spark):
    options = F.array(F.lit("x"), F.lit("B"), F.lit("3"))
    rows = spark.createDataFrame([("c",), ("3",), ("x",), ("B",), ("z9",), ("10",)], "a string")
    got = [r[0] for r in rows.select(shapes.answer_place(F.col("a"), options)).collect()]
    assert got[0] == 2 and got[1] == 2 and got[3] == 1 and got[4] == -1 and got[5] == 9


def test_distractors_share_the_gold_bucket(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("guid"), F.array(*(F.lit(f"{w} option") for w in ("red", "green", "blue", "pink", "grey", "black", "white"))).alias("o"))
    places = emit.distractors(F.col("o"), F.lit(2), F.lit("all about a blue thing and a red one"), F.col("guid"), 1, 3, 7)
    assert {tuple(r[0]) for r in rows.select(places).collect()} == {(0,)}


def lengths(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, n long")


def plan(spark, values, size, budget, multiple=4, seed=7):
    return layout.length_batches(lengths(spark, values), "id", "n", size, budget, multiple, seed)


def test_batches_cover_once_and_keep_the_budget(spark):
    values = [32, 40, 8192, 50, 64, 70, 3000, 120, 150, 200, 25, 28] + [100] * 50
    rows = plan(spark, values, 8, 900).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(values)))
    by = {}
    for r in rows:
        by.setdefault((r["bucket"], r["batch"]), []).append(r["n"])
    assert all(len(b) <= 8 and (len(b) == 1 or max(b) * len(b) <= 900) for b in by.values())
    summary = layout.batch_summary(plan(spark, values, 8, 900), "n", 900, "bucket", "batch").first()
    assert summary["over_budget"] == 0 and summary["single_over"] == 2


def test_batches_waste_less_than_random_and_change_with_the_seed(spark):
    values = [(64, 96, 128, 256, 512, 4096)[(i * 2654435761) % 6] for i in range(2000)]
    rows = lengths(spark, values)
    random = layout.batch_summary(layout.random_batches(rows, "id", "n", 8), "n", None, "batch").first()["padded_tokens"]
    assert layout.batch_summary(plan(spark, values, 8, 16384, 64), "n", 16384, "bucket", "batch").first()["padded_tokens"] < random
    a, b = (sorted((r["id"], r["bucket"], r["batch"]) for r in plan(spark, list(range(1, 200)), 4, None, 4, s).collect()) for s in (1, 2))
    assert a != b and [x[0] for x in a] == [x[0] for x in b]
    assert layout.random_batches(lengths(spark, range(1, 101)), "id", "n", 8).select("batch").distinct().count() == 13


def test_histogram_and_back(spark):
    rows = lengths(spark, [1, 31, 32, 40, 64, 500])
    hist = layout.histogram(rows, "n")
    assert hist.where("bin_lo = 32").first()["n"] == 2
    assert layout.expanded(hist).where("length < bin_lo OR length > bin_lo + 32").count() == 0
    assert layout.expanded(hist).count() == 6


def test_numbering_is_dense_in_any_partitioning(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 37).repartition(13)
    got = [r["row_number"] for r in sample.numbered(rows, "k", "id").orderBy("k", "id").collect()]
    assert got == list(range(1000))


def test_proper_score_prefers_the_truth(spark):
    rows = spark.createDataFrame([([0.9, 0.1, 0.0], [1.0, 0.0, 0.0]), ([0.1, 0.9, 0.0], [1.0, 0.0, 0.0]), ([0.1, 0.0, 0.9], [1.0, 0.0, 0.0])], "p array<double>, g array<double>")
    near, far, farther = (r[0] for r in rows.select(metrics.proper_score(F.col("p"), F.col("g"), F.lit(True))).collect())
    assert near > far > farther


def test_read_modes_and_listing(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"guid":"1","workflow":"w"}\n\n{bad\n')
    (tmp_path / "a.jsonl").write_text('{"guid":"2","workflow":"w"}\n')
    (tmp_path / "skip.jsonl").write_text('{"guid":"3"}\n')
    paths = files.local_files(str(tmp_path), "*.jsonl")
    rows = files.read_listed(spark, paths, exclude=["skip.jsonl"]).cache()
    assert rows.where("_corrupt is not null").count() == 1
    assert {(r["guid"], r["source_ord"]) for r in rows.where("guid is not null").collect()} == {("2", 0), ("1", 1)}
    assert files.read_rows(spark, paths, "tolerant").count() == 3
    with pytest.raises(Exception):
        files.read_rows(spark, paths, "strict").collect()


def test_specs_scan_and_registry(spark, tmp_path):
    for config in ("b", "a"):
        spark.range(2).write.parquet(f"{tmp_path}/{config}/train")
    spec = files.SourceSpec("s", str(tmp_path), "nli", configs="ALL", splits=("train", "test"))
    assert files.configurations(spark, spec) == ("a", "b")
    assert files.scan(spark, spec).groupBy("config").count().count() == 2
    assert files.find(spark, str(tmp_path), "*.parquet").count() == 4
    assert files.first_existing(spark, [f"{tmp_path}/no", str(tmp_path)]) == str(tmp_path)
    assert files.probe(spark.read.parquet(f"{tmp_path}/a/train"))["rows"] == 2
    assert files.only([spec], "s,t") == ([spec], ["t"])
    (tmp_path / "mine.py").write_text("from decisia.sources.files import SourceSpec\nSPECS = [SourceSpec('x', '/p', 'mine')]\nADAPTERS = {'mine': len}\n")
    assert files.registry(str(tmp_path / "mine.py"))[1] == {"mine": len}
    with pytest.raises(ValueError):
        files.SourceSpec("s", "/p", "nli", target=0)


def test_mix_is_accounted_for_and_skipped_when_done(spark, tmp_path):
    states = [f'{{"text":"a state with number {i % 7} in it"}}' for i in range(10)] + ['{"t":"x"}', "{bad"]
    rows = spark.createDataFrame([(str(i), "w", s, Q, G, 0, i) for i, s in enumerate(states)], "guid string, workflow string, state string, questions string, gold string, source_ord int, line_ord int")
    held = rows.where("line_ord = 6").select(X.key_of(X.norm_state(F.col("state"))).alias("key"))
    path = str(tmp_path / "mix")
    stats = mix.build(spark, rows, held, path, "source_ord", "line_ord")
    assert stats["outcomes"] == {"kept": 6, "duplicate_state": 3, "held_out": 1, "empty_state": 1, "bad_json": 1} and stats["rows"] == 6 and stats["rows_in"] == 12
    assert files.up_to_date(spark, path, f"{path}.stats.json")
    assert mix.build(spark, rows.limit(1), held, path, "source_ord", "line_ord") == stats
    gates = mix.audited(spark.read.parquet(path), held).first()
    assert gates["verify_pass"] and gates["leak_pass"]
    assert {r["guid"] for r in mix.mixed(rows, held, "source_ord", "line_ord").collect()} == {"0", "1", "2", "3", "4", "5"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("é", None)], "a string, b string")
    files.write_rows(rows, f"{tmp_path}/o")
    assert '"b":null' in spark.read.text(f"{tmp_path}/o").first()[0]
    files.append_results(rows, f"{tmp_path}/log")
    files.append_results(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    assert files.fingerprint(rows.union(rows)).first()["rows"] == 2
    assert files.key_table(spark, f"{tmp_path}/keys", lambda: rows.select(F.col("a").alias("key"))).count() == 1
    files.write_items(spark.range(4).withColumn("shard", F.col("id") % 2), f"{tmp_path}/items")
    assert spark.read.parquet(f"{tmp_path}/items").where("shard = 1").count() == 2


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{tmp_path}/in")
    source = events.stream(spark, f"{tmp_path}/in", schema)
    for name, df, mode in (("w", events.windowed(source, "value", "event_type"), "complete"), ("s", events.sessions(source, "user_id"), "append"), ("d", events.first_seen(source, "user_id", late="400 days"), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c_{name}").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 1000
    assert spark.table("d").count() == spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    accepted = []
    keys = source.select(F.col("event_type").alias("key"))
    spark.createDataFrame([("view", -1)], "key string, batch long").write.parquet(f"{tmp_path}/keys")
    q = events.grow_keys(keys, f"{tmp_path}/keys", lambda df, n: accepted.extend(r["key"] for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c_k").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(accepted) == ["click", "error", "purchase", "signup"]




def test_typed_corpus(spark):
    rows = [
        ("1", "s", "choice", "st", "i", ["a", "b"], "b", None), ("2", "s", "choice", "st", "i", ["a", "b"], "b", '{"a":1,"b":3}'), ("3", "s", "choice", "st", "i", ["a", "b"], "z", "[0,0]"),
        ("4", "s", "score", "st", "i", ["lo", "hi"], "1", "[1, 1]"), ("5", "s", "noul", "st", "i", None, "yes", "None"), ("6", "s", "noul", "st", "i", None, "no", "0.7"), ("7", "s", "noul", "st", "i", None, "", "true"),
        ("8", "big", "choice", "st", "i", ["a", "b"], "b", None), ("9", "s", "score", "st", "i", [str(i) for i in range(9)], "1", None),
    ]
    df = spark.createDataFrame(rows, "id string, source string, primitive string, state string, instructions string, options array<string>, label string, soft_label string")
    got = {r["guid"]: [round(p, 2) for p in r["probs"]] for r in shapes.typed_corpus(df, skip=("big",)).collect()}
    assert got == {"1": [0, 1], "2": [0.25, 0.75], "4": [0.5, 0.5], "5": [0, 1], "6": [0.3, 0.7], "7": [0, 1]}
    level = shapes.graded(spark.createDataFrame([(2.5,), (9.0,), (-1.0,), (None,)], "s double"), F.lit("g"), F.lit("w"), F.lit("ko"), F.lit("a"), F.lit("b"), F.col("s"), [str(i) for i in range(6)])
    assert [r["label"] for r in level.collect()] == [2, 5, 0]
    name = spark.range(1).select(shapes.guid("n", F.lit("c"), F.lit("train"), F.col("id")).alias("g"), shapes.workflow_of("w-{config}", F.lit("c")).alias("w")).first()
    assert tuple(name) == ("n/c/train/0", "w-c")


def test_predictions_and_results(spark, tmp_path):
    doc = {"predictions": [{"id": "a", "workflow": "w", "latency_ms": 5.0, "questions": {"q": {"type": "choice"}}, "pred": {"q": {"probabilities": {"B": 0.75, "A": 0.25}}}, "gold": {"q": {"probabilities": {"A": 1.0, "B": 0.0}}}},
                           {"id": "b", "workflow": "w", "latency_ms": 7.0, "questions": {"q": {"type": "noul"}}, "pred": {"q": {"noul": 0.9}}, "gold": {"q": {"probabilities": {"false": 0.0, "true": 1.0}}, "r": {"probabilities": {"A": 1.0}}}}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    rows = files.read_predictions(spark, str(tmp_path / "p.json"))
    assert {(r["id"], r["qid"]): r["p"] and [round(x, 2) for x in r["p"]] for r in rows.collect()} == {("a", "q"): [0.25, 0.75], ("b", "q"): [0.1, 0.9], ("b", "r"): None}
    summary = metrics.summary(rows, (F.array_position("g", F.array_max("g")) - 1).cast("int"))
    assert summary.first()["skipped"] == 1 and summary.first()["accuracy"] == 0.5
    files.write_evaluation(spark, rows, summary, str(tmp_path / "out"))
    assert files.read_sidecar(spark, f"{tmp_path}/out.summary.json")["decisions"] == 2
    (tmp_path / "r.jsonl").write_text('{"task_id":"t1","correct":true,"latency_s":0.5,"usage":{"input_tokens":3},"probs":{"a":1.0}}\n')
    tasks = spark.createDataFrame([("t1", "easy")], "task_id string, tier string")
    assert files.read_results(spark, str(tmp_path / "r.jsonl"), tasks).first()["tier"] == "easy"
    with pytest.raises(ValueError):
        files.read_results(spark, str(tmp_path / "r.jsonl"), tasks.limit(0))


def test_catalog_of_sources():
    from decisia.sources.specs import catalog

    specs = catalog()
    assert len(specs) == len({s.name for s in specs}) == 99
    assert all(s.shape in shapes.ADAPTERS or s.shape == "suite" for s in specs)


def test_emotion_query_by_checksum(spark, sf):
    """The drawn emotion follows from the text's checksum, as plain Python has it."""
    import zlib

    from decisia.plans import catalog
    from decisia.session import table

    got = {r["guid"]: (r["emotion"], r["p"]) for r in catalog.QUERIES["crc32_binary_query"](spark, sf).collect()}
    want = {}
    for r in table(spark, sf, "documents").collect():
        text = " ".join(x for x in __import__("re").split(r"[ \t\n\r\f]+", r["text"]) if x)
        own, h = sorted({r["doc_id"] % 28, r["doc_id"] % 5}), zlib.crc32(text.encode())
        pool = own if h % 2 == 0 else [i for i in range(28) if i not in own]
        if text:
            want[str(r["doc_id"])] = (shapes.EMOTIONS[pool[(h // 2) % len(pool)]], 0.85 if h % 2 == 0 else 0.15)
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_greedy_shards_are_a_walk(spark, seed):
    """Turns of shards give what walking row by row gives, also with few rows, ties and rows of no length."""
    import random

    r = random.Random(seed)
    rows = [(i, r.choice([0, 1, 2, 2, 3, 5, 8, 13, 40][: 3 + 2 * seed])) for i in range(120)]
    shards, loads, want = 3 + seed, [0] * (3 + seed), {}
    for i, n in sorted(rows, key=lambda x: (x[1], x[0])):
        k = loads.index(min(loads))
        want[i], loads[k] = k, loads[k] + n
    got = layout.greedy_shards(spark.createDataFrame(rows, "id long, n long"), "id", "n", shards)
    assert {x["id"]: x["shard"] for x in got.collect()} == want


def test_items_by_another_tokenizer(spark):
    """A vectorised function serves as the tokenizer."""
    import pandas as pd

    @F.pandas_udf("array<int>")
    def letters(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [ord(c) for c in t])

    rows = spark.createDataFrame([("a", "choice", ["A", "B"], ["x", "yz"], [0.0, 1.0], "st"), ("b", "noul", ["false", "true"], None, [0.5, 0.5], "u")], "guid string, qtype string, keys array<string>, texts array<string>, probs array<double>, norm string")
    got = {r["guid"]: (r["ids"], r["markers"], r["qtype"], r["label"]) for r in layout.training_items(rows, tokenizer=letters).collect()}
    of = lambda t: [ord(c) for c in t]
    assert got["a"] == ([1, *of("A x"), 1, *of("B yz"), 2, *of("st")], [0, 4], 0, 1)
    assert got["b"][0] == [1, *of("false false"), 1, *of("true true"), 2, *of("u")]


def test_epochs_differ_by_seed(spark):
    """Batches keep their rows' lengths together, but their order and their rows are drawn anew."""
    rows = spark.createDataFrame([(i, 10 + i % 50) for i in range(400)], "id long, n long")
    plans = [{(r["id"], r["step"]) for r in layout.epoch(rows, "id", "n", 4, 200, multiple=4, seed=s).collect()} for s in (1, 1, 2)]
    assert plans[0] == plans[1] != plans[2]
    assert len({s for _, s in plans[0]}) == 1 + max(s for _, s in plans[0])
    with pytest.raises(ValueError):
        layout.epoch(rows, "id", "n", 4, 200, mode="other")


def test_listed_files_without_any(spark):
    assert files.read_listed(spark, []).count() == 0


def test_catalog_entries_name_known_adapters():
    from decisia.sources.specs import catalog

    found = catalog()
    assert len(found) == 99 == len({s.name for s in found})
    assert all(s.shape in shapes.ADAPTERS and s.target for s in found)
    assert all(s.columns or s.shape == "suite" for s in found)


def test_contained_passages(spark):
    """Words glued to a passage's ends, anchors in many documents, passages of one or two words."""
    from decisia.operators.passages import contained

    docs = spark.createDataFrame([(1, "xthe quick brown foxes"), (2, "quick brown"), (3, "the quick brown fox"), (4, "brownish lone words")], "id long, t string")
    passages = spark.createDataFrame([(10, "the quick brown fox"), (11, "lone"), (12, "quick brown")], "item long, b string")
    got = {tuple(r) for r in contained(docs, "id", "t", passages, "item", "b").collect()}
    assert got == {(1, 10), (3, 10), (4, 11), (1, 12), (2, 12), (3, 12)}


@pytest.mark.parametrize("values", [[1, 1, 1], [5], list(range(1000)), [0] * 900 + [10**9], [-3.5, 2.25, 2.25, 7.0]])
def test_percentiles_in_cells(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = {r["q"]: r["value"] for r in layout.percentiles(rows, "v", [0.0, 0.5, 0.999, 1.0], "floor_last").collect()}
    ordered = sorted(map(float, values))
    assert got == {q: ordered[int(q * (len(ordered) - 1))] for q in (0.0, 0.5, 0.999, 1.0)}


def test_fitted_temperature(spark):
    """Logits that are three times too sharp ask for a temperature of three; few rows keep one; bounds hold."""
    import math

    rows = []
    for i in range(40):
        true = [0.1 + 0.02 * i, 0.9 - 0.02 * i]
        rows.append(("a", [3 * math.log(x) for x in true], true))
    rows += [("b", [5.0, 0.0], [0.0, 1.0])] * 5 + [("c", [50.0, 0.0], [0.5, 0.5])] * 20
    df = spark.createDataFrame(rows, "q string, z array<double>, g array<double>")
    got = {r["q"]: r["temperature"] for r in metrics.fitted_temperatures(df, "q").collect()}
    assert abs(got["a"] - 3) < 0.01 and got["b"] == 1.0 and abs(got["c"] - 10) < 1e-9
