"""The mix against its SQL and its budgets, the stages against plain versions, and the registered queries."""

from collections import Counter

import duckdb
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from decisia.llm import mixing, quality, queries
from decisia.llm.common import table
from tests.llm.conftest import texts_of
from tests.llm.test_dedup import plain_components, plain_groups
from tests.llm.test_texts import check_pieces, ids_of, plain_terms, plain_vote


def sql(query, sf):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = con.execute(query)
    return [d[0] for d in got.description], got.fetchall()


def test_sql(spark, sf):
    for name, query in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf)
        columns, rows = sql(query, sf)
        assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(rows), name


def test_run_against_plain_stages(spark, sf):
    """The whole pipeline: votes one by one, copies and components by hand, the mix by SQL, then the pieces of what is left."""
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    left = [(i, r["text"] or "") for i, r in rows.items() if plain_vote(model, plain_terms(r["text"] or "")) >= 0.3]
    assert 0 < len(left) < len(rows)
    for plain in (lambda some: {i for i, _, _, first, _ in plain_groups(some) if first}, lambda some: {i for i, _, c in plain_components(some) if i == c}):
        kept = plain(left)
        left = [x for x in left if x[0] in kept]
    con = duckdb.connect()
    documents = pa.table({k: [rows[i][k] for i, _ in left] for k in ("doc_id", "text", "lang", "source")})  # noqa: F841
    mixed = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.mix_sql(0.8, 1)})").fetchall()}
    left = [x for x in left if x[0] in mixed]
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == mixed and len(mixed) < len(kept)
    assert check_pieces(got, left) == 0 and sum(r["length"] for r in got) == sum(len(ids_of(t)) + 1 for _, t in left)


def test_stages_on_odd_rows(spark, edge, none, sf):
    """Every stage takes nulls, empty and long texts, repeats, clashing columns, and an empty table."""
    for name, stage in corpus_pipeline.STAGES:
        kept, nothing = stage(spark, edge, sf), stage(spark, none, sf)
        assert kept.count() and not nothing.count(), name
        if name != "packing":
            assert kept.columns == edge.columns and nothing.columns == none.columns


def test_mix_edges(spark, edge, none):
    assert mixing.mix(none).count() == 0
    got = mixing.mix(edge, epochs=3).collect()
    assert got and all(0 <= r["epoch"] < 3 for r in got)
    assert mixing.mix_documents(edge, budget_share=1.0).count() == edge.count()
    assert mixing.mix_documents(edge).columns == edge.columns


def test_mix_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 500), ("d0", "de", "c", 500), ("d1", "en", "d", 500)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, 400 / 1510, 1, ({}, {}, {})).collect()}
    assert got == {"a": 10, "b": 90, "c": 100, "d": 200}
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves.where("source <> 'b'"), 400 / 1010, 1, ({}, {}, {})).collect()}
    assert got == {"a": 10, "c": 190, "d": 200}


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        before = texts_of(docs)
        if k == 4:
            assert check_pieces(out.collect(), before) == 0
            break
        assert out.columns == columns, name
        kept = {r["doc_id"] for r in out.collect()}
        if k == 1:
            assert kept == {i for i, _, _, first, _ in plain_groups(before) if first}
        if k == 2:
            assert kept == {i for i, _, c in plain_components(before) if i == c}
        docs = docs.where(docs["doc_id"].isin(list(kept)))


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_mix_of_one_id_in_two_leaves(spark, monkeypatch):
    """A row is chosen in its own leaf; the other rows of its id stay out unless their leaf chooses them. Cells get digits with the rows."""
    monkeypatch.setattr(mixing, "CELL_ROWS", 1 / 256)
    rows = [(i, "w " * 10, "en", f"src{s}") for i in range(200) for s in (4, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    chosen = Counter((r["source"], r["doc_id"]) for r in mixing.mix(docs, budget_share=0.3, epochs=1).collect())
    kept = Counter((r["source"], r["doc_id"]) for r in mixing.mix_documents(docs, budget_share=0.3).collect())
    assert kept == chosen and 0 < len(kept) <= 120
