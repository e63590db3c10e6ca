"""Every registered query against its SQL on the small tables, the way the driver compares them."""

from collections import Counter

import duckdb
import pytest

from decisia.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    made = duckdb.connect()
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return made


def value(v):
    return round(v, 7) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalog.SQL:
        assert rows
        return
    found = con.execute(catalog.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(tuple(value(r[c]) for c in columns) for r in rows) == Counter(tuple(value(v) for v in r) for r in found.fetchall())


def test_names_agree():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_emit_rows_reads_whole_texts(spark, tmp_path):
    """An answer marker far into a text refuses its row."""
    texts = ["some words " * 20, "some words " * 20 + "Answer: B"]
    spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sum(r["n"] for r in catalog.QUERIES["emit_rows"](spark, str(tmp_path)).collect()) == 1


def test_spec_slices_beyond_targets(spark, tmp_path):
    """More documents than the catalog's targets: entries that take all of their files do."""
    d = spark.range(32_000).selectExpr("id AS doc_id", "concat('text ', id % 29000) AS text", "if(id % 2 = 0, 'en', 'de') AS lang", "concat('src', id % 7) AS source")
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = own.execute(catalog.SQL["spec_slices"])
    columns = [c[0] for c in found.description]
    rows = catalog.QUERIES["spec_slices"](spark, str(tmp_path)).collect()
    assert Counter(tuple(r[c] for c in columns) for r in rows) == Counter(found.fetchall())


def test_sources_are_written_once(spark, sf, tmp_path, monkeypatch):
    """Texts lie once in the files of all entries of Parquet, once in the JSON lines; an entry alone has its own files alone, and a run without a path no copy of its slices' rows."""
    from decisia.plans import origins

    folders = iter(("every", "one", "run", "repeats"))
    monkeypatch.setattr(origins, "scratch", lambda spark, name: f"{tmp_path}/{next(folders)}")
    monkeypatch.setattr(origins.build, "scratch", lambda spark, name: f"{tmp_path}/{next(folders)}")
    origins.write_sources(spark, sf, origins.ENTRIES)
    assert sorted(p.name for p in (tmp_path / "every").iterdir()) == ["all", "sst5", "yelp_polarity"]
    entries, scan = origins.write_sources(spark, sf, ("sst5",))
    assert [p.name for p in (tmp_path / "one").iterdir()] == ["sst5"]
    rows, stats = origins.build.build(spark, entries, scan=scan)
    assert rows.count() == stats.first()["rows"] > 0 and not (tmp_path / "run" / "rows").exists()
