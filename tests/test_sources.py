"""Sources in the order of their files, and catalog runs that lose a slice, a row or their process and go on."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from decisia.sources import build, files
from decisia.sources.files import SourceSpec

SPEC = SourceSpec("turns", "", "label_int", "w-{config}", columns={"text": "text", "label": "label"}, options={"names": ("no", "yes")}, target=100)


def in_turn(spark, n, first=0):
    """Labels in turn, so that a source sorted by its columns starts with one label only."""
    return spark.range(first, first + n, 1, 1).select((F.col("id") % 2).alias("label"), F.concat(F.lit("text number "), F.col("id")).alias("text"), F.create_map(F.lit("k"), F.col("id")).alias("more"))


def numbers(rows):
    return [int(r["guid"].rsplit("/", 1)[1]) for r in rows.orderBy("at").collect()]


@pytest.mark.parametrize("format", ["parquet", "json", "csv", "orc"])
def test_rows_in_the_order_of_files(spark, tmp_path, format):
    """Several files, blocks far smaller than a file, one file a task or several: the same numbers."""
    for k in range(3):
        in_turn(spark, 400, 400 * k).drop("more").write.format(format).save(f"{tmp_path}/{k}")
        (part,) = (tmp_path / str(k)).glob("part-*")
        (tmp_path / "all").mkdir(exist_ok=True)
        part.rename(tmp_path / "all" / f"{k}.{format}")
    wanted = {f"text number {i}": i for i in range(1200)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", size)
            rows = spark.read.schema("label long, text string").format(format).load(f"{tmp_path}/all")
            assert {r["text"]: r["_row"] for r in files.in_order(rows, format).collect()} == wanted
            assert sorted(r["_row"] for r in files.in_order(rows, format, 450).collect()) == list(range(450))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_places_beyond_the_bound_are_joined(spark, tmp_path, monkeypatch):
    in_turn(spark, 50).repartition(5).write.parquet(f"{tmp_path}/x")
    rows = spark.read.parquet(f"{tmp_path}/x")
    sent = files.in_order(rows).select("text", "_row").collect()
    monkeypatch.setattr(files, "MOST_SENT", 2)
    assert sorted(files.in_order(rows).select("text", "_row").collect()) == sorted(sent) and sorted(r["_row"] for r in sent) == list(range(50))


def test_a_prefix_is_the_first_rows(spark, tmp_path):
    """The first rows of the files, with both labels; ids stay when rows are added; a column of maps is no hindrance."""
    spec = replace(SPEC, path=str(tmp_path / "s"))
    in_turn(spark, 1000).write.parquet(f"{tmp_path}/s/train")
    rows, stats = build.build(spark, [spec], path=str(tmp_path / "a"))
    assert numbers(rows) == list(range(100))
    golds = [json.loads(r["gold"])["decision"]["probabilities"] for r in rows.collect()]
    assert sum(g["A"] for g in golds) + sum(g["B"] for g in golds) == 100
    texts = {r["guid"]: json.loads(r["state"])["state"]["text"] for r in rows.collect()}
    assert all(t == f"text number {g.rsplit('/', 1)[1]}" for g, t in texts.items())
    in_turn(spark, 50, 1000).write.mode("append").parquet(f"{tmp_path}/s/train")
    listed = sorted((tmp_path / "s" / "train").glob("part-*"), key=lambda p: p.stat().st_size)
    listed[0].rename(tmp_path / "s" / "train" / "part-99999-later.parquet")
    again, _ = build.build(spark, [replace(spec, target=1020)], path=str(tmp_path / "a"))
    assert {r["guid"]: json.loads(r["state"])["state"]["text"] for r in again.collect()}.items() >= texts.items() and numbers(again) == list(range(1020))
    for take, seen in (("reservoir", 1050), ("shuffle", 30)):
        some, stats = build.build(spark, [replace(spec, target=30, take=take)])
        assert len(set(numbers(some))) == 30 and max(numbers(some)) > 200 and stats.first()["seen"] == seen


def test_labels_are_those_of_the_whole_slice(spark, tmp_path):
    in_turn(spark, 40).select("text", F.concat(F.lit("name "), F.floor(F.regexp_extract("text", "[0-9]+", 0).cast("int") / 10)).alias("label")).write.parquet(f"{tmp_path}/s/train")
    rows, _ = build.build(spark, [replace(SPEC, path=str(tmp_path / "s"), shape="label_str", options={}, target=10)])
    assert {len(json.loads(r["questions"])["decision"]["criteria"]) for r in rows.collect()} == {4}


def test_a_row_that_does_not_convert_is_refused_alone(spark, tmp_path):
    in_turn(spark, 30).select("text", F.when(F.col("label") == 1, "1").when(F.regexp_extract("text", "[0-9]+", 0).cast("int") < 10, "0").otherwise("none").alias("label")).write.parquet(f"{tmp_path}/s/train")
    spec = replace(SPEC, path=str(tmp_path / "s"), columns={"text": "text", "label": "cast(label as int)"})
    _, stats = build.build(spark, [spec])
    row = stats.first()
    assert (row["seen"], row["dropped_shape"], row["rows"], row["error"]) == (30, 10, 20, None)


def test_a_broken_file_costs_its_slice(spark, tmp_path):
    specs = []
    for name in ("good", "broken"):
        in_turn(spark, 20).write.parquet(f"{tmp_path}/{name}/train")
        specs.append(replace(SPEC, name=name, path=f"{tmp_path}/{name}", splits=("train", "absent")))
    (tmp_path / "broken" / "train" / "part-99998.parquet").write_bytes(b"no Parquet at all")
    specs.append(replace(SPEC, name="all", path=f"{tmp_path}/nowhere", configs="ALL"))
    rows, stats = build.build(spark, specs, path=f"{tmp_path}/out")
    found = {(r["spec"], r["split"]): (r["rows"], r["error"] is None) for r in stats.collect()}
    assert found == {("good", "train"): (20, True), ("good", "absent"): (None, False), ("broken", "train"): (None, False), ("broken", "absent"): (None, False), ("all", ""): (None, False)}
    said = files.read_sidecar(spark, f"{tmp_path}/out/manifests/good.manifest.json")
    assert said["rows"] == 20 and [s["split"] for s in said["slices"]] == ["train", "absent"]
    assert files.read_sidecar(spark, f"{tmp_path}/out/summary.json")["rows"] == 20 == rows.count()
    nothing, stats = build.build(spark, specs[2:])
    assert nothing.count() == 0 and stats.count() == 1


def test_a_killed_run_goes_on(spark, tmp_path):
    """Equal states: the first slice in the catalog's order keeps its rows, whichever run wrote them."""
    specs = []
    for k in range(4):
        in_turn(spark, 20, 10 * k).write.parquet(f"{tmp_path}/s{k}/train")
        specs.append(replace(SPEC, name=f"s{k}", path=f"{tmp_path}/s{k}"))
    whole, whole_stats = build.build(spark, specs)
    scanned = []

    def killed(session, spec, config, split):
        if spec.name == "s2":
            raise KeyboardInterrupt
        scanned.append(spec.name)
        return build.slice_of(session, spec, config, split)

    with pytest.raises(KeyboardInterrupt):
        build.build(spark, specs, scan=killed, path=f"{tmp_path}/out", workers=1)
    before = list(scanned)
    assert "s0" in before and "s2" not in before

    def counted(session, spec, config, split):
        scanned.append(spec.name)
        return build.slice_of(session, spec, config, split)

    rows, stats = build.build(spark, specs, scan=counted, path=f"{tmp_path}/out")
    assert sorted(scanned) == ["s0", "s1", "s2", "s3"]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, whole.collect())) and sorted(stats.collect()) == sorted(whole_stats.collect())
    kept = {r["spec"]: r["rows"] for r in stats.collect()}
    assert kept["s0"] == 20 and all(10 <= kept[s] < 20 for s in ("s1", "s2", "s3"))  # options are permuted by ids, so half of the repeated states are alike


def test_slices_are_one_scan(spark, tmp_path):
    for config in ("a b", "c"):
        for split in ("train", "test"):
            spark.range(3).select("id", *([F.lit(1).alias("more")] if config == "c" else [])).write.parquet(f"{tmp_path}/{config}/{split}")
    rows = files.scan(spark, SourceSpec("s", str(tmp_path), "nli", configs="ALL", splits=("train", "test", "absent")))
    assert {(r["config"], r["split"], r["count"]) for r in rows.groupBy("config", "split").count().collect()} == {(c, s, 3) for c in ("a b", "c") for s in ("train", "test")}
    assert rows.where("more = 1").count() == 6
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_lines_by_their_places(spark, tmp_path):
    """Any range of lines over several files, blocks far smaller than files, long and empty lines, a last line without an end: read by seeking, and by Spark's reader alone."""
    lines = [[f"{k} line {i} " + "é" * (i % 7) * (40 if i % 50 == 0 else 1) if i % 11 else "" for i in range(n)] for k, n in enumerate((700, 1, 403))]
    paths = []
    for k, some in enumerate(lines):
        (tmp_path / f"f {k}.txt").write_bytes(("\n".join(some) + ("\n" if k < 2 else "")).encode())
        paths.append(f"{tmp_path}/f {k}.txt")
    whole = [x for some in lines for x in some]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            files.line_index(spark, paths, every=10).write.mode("overwrite").parquet(f"{tmp_path}/index")
            index = spark.read.parquet(f"{tmp_path}/index")
            assert not files.is_stale(spark, index) and index.agg(F.sum("lines")).first()[0] == len(whole)
            for low, high in ((0, len(whole)), (695, 705), (0, 1), (1100, 1104), (333, 334), (5000, 6000)):
                want = [(i, whole[i]) for i in range(low, min(high, len(whole)))]
                assert sorted(map(tuple, files.read_range(spark, index, low, high).collect())) == want
                if want:
                    assert sorted(map(tuple, files.read_blocks(spark, index, low, high).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_few_lines_read_little(spark, tmp_path):
    """Ten lines of a file of forty megabytes: a few kilobytes of it are read."""
    (tmp_path / "big.txt").write_bytes(b"".join(b"%08d %s\n" % (i, b"x" * 391) for i in range(100_000)))
    index = files.line_index(spark, [f"{tmp_path}/big.txt"], every=20)
    index.write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    got = files.pieces(index, 54_321, 54_331).agg(F.sum("length").alias("bytes"), F.sum("lines").alias("lines")).first()
    assert got["bytes"] <= 40 * 401 and got["lines"] <= 40
    assert sorted(int(r["value"][:8]) for r in files.read_range(spark, index, 54_321, 54_331).collect()) == list(range(54_321, 54_331))


def test_trees_are_copied_by_tasks(spark, tmp_path):
    """Files below folders, empty ones, names with signs; a second copy leaves one of each; a single file."""
    for name, data in (("a/b c.bin", b"x" * 9_000_000), ("a/empty", b""), ("d%20e.txt", b"hello"), ("f+g", b"1")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    for _ in range(2):
        copied = files.copy_tree(spark, f"{tmp_path}/in", f"{tmp_path}/out/tree")
    want = {p.relative_to(tmp_path / "in"): p.read_bytes() for p in (tmp_path / "in").rglob("*") if p.is_file()}
    assert {p.relative_to(tmp_path / "out/tree"): p.read_bytes() for p in (tmp_path / "out/tree").rglob("*") if p.is_file() and "_copied" not in p.parts and not p.name.endswith(".crc")} == want
    import zlib

    assert sorted((r["bytes"], r["crc32"]) for r in copied.collect()) == sorted((len(x), zlib.crc32(x)) for x in want.values())
    files.copy_tree(spark, f"{tmp_path}/in/f+g", f"{tmp_path}/one")
    assert (tmp_path / "one").read_bytes() == b"1"
    with pytest.raises(FileNotFoundError):
        files.copy_tree(spark, f"{tmp_path}/nothing", f"{tmp_path}/x")
