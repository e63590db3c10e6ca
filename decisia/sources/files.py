"""Sources and sinks of decision rows.

Reading is by explicit schema, in one of three modes for lines that can't be read: strict raises, tolerant drops, counted keeps them
in a column. Several files come with their place in the list, which is the priority of first-wins dedup.
"""

from __future__ import annotations

import hashlib
import importlib.util
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decisia.sources.shared import durable

ROW = T.StructType([T.StructField(n, T.StringType()) for n in ("guid", "workflow", "state", "questions", "gold")])
CORRUPT = "_corrupt"


@dataclass(frozen=True)
class SourceSpec:
    """What to scan and how to shape it: the catalog's entry of one source.

    columns: the adapter's arguments as SQL over the source's columns (a tuple for a list of them); options: its other arguments;
    fields: state fields beside the adapter's own, as SQL; language: a tag, "config", or SQL after "="; draw: how many others a choice of
    many options shows (least, most), bucket: only such as overlap with the state as the gold option does; take: which rows a target takes.
    """

    name: str
    path: str
    shape: str
    workflow: str = ""
    format: str = "parquet"
    configs: tuple[str, ...] | str = ()
    splits: tuple[str, ...] = ("train",)
    columns: dict[str, str] = field(default_factory=dict)
    options: dict[str, object] = field(default_factory=dict)
    language: str = "en"
    target: int | None = None
    fields: dict[str, str] = field(default_factory=dict)
    draw: tuple[int, int] | None = None
    bucket: bool = False
    take: str = "first"

    def __post_init__(self) -> None:
        if self.take not in ("first", "reservoir", "shuffle"):
            raise ValueError(f"{self.name}: {self.take} is no way to take rows")
        if self.target is not None and self.target <= 0:
            raise ValueError(f"{self.name}: the budget of a source is a positive number")


def read_rows(spark: SparkSession, paths: str | list[str], mode: str = "counted", schema: T.StructType = ROW) -> DataFrame:
    """JSON lines. mode: strict, tolerant or counted."""
    reader = spark.read.schema(schema)
    if mode == "strict":
        return reader.option("mode", "FAILFAST").json(paths)
    if mode == "tolerant":
        return reader.option("mode", "DROPMALFORMED").json(paths)
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(paths)


def placed(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Adds file (its whole path), source_ord (its place in the list) and line_ord (the line's place in the file): the block's start in the
    file, then the reader's order within the block, so that ties come out alike however files are split."""
    places = rows.sparkSession.createDataFrame([(_full(rows.sparkSession, p), i) for i, p in enumerate(paths)], "_path string, source_ord int")
    each = rows.withColumn("file", F.col("_metadata.file_path")).withColumn("line_ord", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")))
    return each.join(F.broadcast(places), F.regexp_replace("file", "^file:/*", "/") == F.col("_path")).drop("_path")


def _full(spark: SparkSession, path: str) -> str:
    p, fs = hadoop_path(spark, path)
    found = fs.makeQualified(p).toUri().toString()
    return "/" + found.removeprefix("file:").lstrip("/") if found.startswith("file:") else found


#: Files (blocks of text files) whose places are sent to every task; beyond, rows meet them in a join.
MOST_SENT = 50_000


def in_order(rows: DataFrame, format: str = "parquet", most: int | None = None) -> DataFrame:
    """What a reader gives, with _row: each row's number from 0 in the order of file names and of lines or rows in them, or the first `most` rows.

    Nothing is sorted: Parquet's reader tells a row's place in its file; other readers give the lines of a block in order, from wherever the block starts. Counts of
    files (footers alone) or blocks become places by prefix sums. Rows appended to the last file, or in files of later names, change no number.
    """
    spark = rows.sparkSession
    file = F.col("_metadata.file_path").alias("_file")
    if format == "parquet":
        block, at, first = F.lit(0).cast("long").alias("_block"), F.col("_metadata.row_index").alias("_at"), F.lit(0).cast("long")
    else:
        block, at, first = F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.min("_at")
    held = rows.select(file, block, *([] if format == "parquet" else [at])).groupBy("_file", "_block").agg(F.count("*").alias("_n"), first.alias("_first"))
    base = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_file", "_block")) - F.col("_n")  # a row a file or block
    places = held.withColumn("_base", base)
    if most is not None:
        places = places.where(F.col("_base") < most)
    places = places.select("_file", "_block", (F.col("_base") - F.col("_first")).alias("_shift"))
    each = rows.select("*", file, block, at)
    few = places.limit(MOST_SENT + 1).collect()
    if len(few) > MOST_SENT:
        places = durable(places)
    else:
        if most is not None and format == "parquet":  # files beyond the first rows aren't opened; blocks are numbered by readers, so no text file is left out
            each = each.where(F.col("_file").isin([r["_file"] for r in few]))
        places = F.broadcast(spark.createDataFrame(few, "_file string, _block long, _shift long"))
    numbered = each.join(places, ["_file", "_block"]).withColumn("_row", F.col("_shift") + F.col("_at")).drop("_file", "_block", "_at", "_shift")
    return numbered if most is None else numbered.where(F.col("_row") < most)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of change of each file at a path or below it, in order; none where nothing is."""
    p, fs = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    found, each = [], fs.listFiles(p, True)
    while each.hasNext():
        s = each.next()
        found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def read_listed(spark: SparkSession, paths: Iterable[str], exclude: Iterable[str] = (), extra: Iterable[str] = (), mode: str = "counted") -> DataFrame:
    """Rows of files in sorted order, then of extra ones in theirs, with source_ord; file names in exclude are left out. No files, no rows."""
    left_out = set(exclude)
    listed = sorted({p for p in paths if p.rsplit("/", 1)[-1] not in left_out})
    listed += [p for p in extra if p not in listed]
    if not listed:
        return spark.createDataFrame([], T.StructType([*ROW.fields, T.StructField(CORRUPT, T.StringType()), T.StructField("file", T.StringType()), T.StructField("source_ord", T.IntegerType())]))
    return placed(read_rows(spark, listed, mode), listed)


def manifest_files(spark: SparkSession, manifest: str, split: str, root: str = "") -> list[str]:
    """Paths that a manifest, {"sources": {name: {"files": {split: path or paths}}}}, lists for a split, by name of the source."""
    said = read_sidecar(spark, manifest) or {}
    found = [s.get("files", {}).get(split) for _, s in sorted(said.get("sources", {}).items())]
    return [f"{root}/{p}" if root else p for f in found if f for p in ([f] if isinstance(f, str) else f)]


#: Lines between two noted places of a file, and bytes of a file at a time.
NOTED_LINES, PIECE_BYTES = 1000, 8 << 20

BLOCKS = "file string, source_ord int, size long, block long, lines long, bytes long, at array<long>"


def line_index(spark: SparkSession, paths: list[str], every: int = NOTED_LINES) -> DataFrame:
    """A row a block of each file: file, source_ord, size (the file's, to tell when the index is stale), block, first_row, lines, offset, at, every.

    Blocks are what readers split files into; rows are numbered over all files in the order of the list. A block's lines begin at byte `offset` of the file, and at[k] bytes
    further begins its line k * every. Each block is one pass of one task, which sees the lengths of its lines only; first rows and bytes are prefix sums over blocks. Lines end in
    a line feed.
    """
    rows = placed(spark.read.option("lineSep", "\n").text(paths).withColumn("size", F.col("_metadata.file_size")), paths)

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, held, at = None, 0, 0, []

        def out() -> pa.RecordBatch:
            file, order, size, block = now
            return pa.RecordBatch.from_pylist([{"file": file, "source_ord": order, "size": size, "block": block, "lines": lines, "bytes": held, "at": at}], schema)

        schema = pa.schema([("file", pa.string()), ("source_ord", pa.int32()), *((c, pa.int64()) for c in ("size", "block", "lines", "bytes")), ("at", pa.list_(pa.int64()))])
        for batch in batches:
            file, order, block = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), batch.column(3).to_numpy()
            code = file.indices.to_numpy()
            cut = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1 if batch.num_rows else []
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if a == b:
                    continue
                here = (file.dictionary[code[a]].as_py(), int(order[a]), batch.column(2)[int(a)].as_py(), int(block[a]))
                if here != now:
                    if now:
                        yield out()
                    now, lines, held, at = here, 0, 0, []
                sizes = batch.column(4).to_numpy()[a:b]
                begin = held + np.concatenate([[0], np.cumsum(sizes)])
                at += begin[:-1][(lines + np.arange(b - a)) % every == 0].tolist()
                lines, held = lines + int(b - a), int(begin[-1])
        if now:
            yield out()

    size = (F.octet_length("value") + 1).cast("long")
    blocks = durable(rows.select("file", "source_ord", "size", F.col("line_ord.block").alias("block"), size.alias("n")).mapInArrow(note, BLOCKS))
    before = F.sum("lines").over(W.partitionBy(F.lit(0)).orderBy("source_ord", "block")) - F.col("lines")  # a row a block
    offset = F.sum("bytes").over(W.partitionBy("file").orderBy("block")) - F.col("bytes")
    return blocks.withColumn("first_row", before).withColumn("offset", offset).select("file", "source_ord", "size", "block", "first_row", "lines", "offset", "at", "bytes", F.lit(every).alias("every"))


def is_stale(spark: SparkSession, index: DataFrame) -> bool:
    """Whether a file of the index is gone or has another size."""
    for r in index.select("file", "size").distinct().collect():
        p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["file"]))  # as the reader writes it, with signs escaped
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p) or fs.getFileStatus(p).getLen() != r["size"]:
            return True
    return False


def pieces(index: DataFrame, low: int, high: int) -> DataFrame:
    """file, start, length, first, lines: the parts of files, from one noted place to the next, that hold the lines low to high (exclusive)."""
    some = index.where((F.col("first_row") < high) & (F.col("first_row") + F.col("lines") > low))
    end = F.concat(F.slice("at", F.lit(2), F.size("at")), F.array("bytes"))
    each = some.select("file", "size", "offset", "first_row", "lines", "every", F.posexplode(F.arrays_zip(F.col("at").alias("a"), end.alias("b"))).alias("k", "z"))
    first = F.col("first_row") + F.col("k") * F.col("every")
    lines = F.least(F.col("every"), F.col("lines") - F.col("k") * F.col("every"))
    start = F.col("offset") + F.col("z.a")
    return each.select("file", start.alias("start"), (F.least("size", F.col("offset") + F.col("z.b")) - start).alias("length"), first.alias("first"), lines.alias("lines")).where((F.col("first") < high) & (F.col("first") + F.col("lines") > low))


def reachable(path: str) -> bool:
    """Whether tasks can open files of this store themselves; if not, only Spark's readers can."""
    try:
        arrow_fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def read_range(spark: SparkSession, index: DataFrame, low: int, high: int) -> DataFrame:
    """row, value: lines low to high (exclusive) of all files of the index. Tasks open files at noted places and read what lies between them, a thousand lines more than asked at
    most at either end; from a store that only Spark's readers open, the files with such lines are read whole."""
    wanted = pieces(index, low, high)
    one = wanted.select("file").limit(1).collect()
    if not one:
        return spark.createDataFrame([], "row long, value string")
    if not reachable(one[0]["file"]):
        return read_blocks(spark, index, low, high)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                store, path = arrow_fs.FileSystem.from_uri(p["file"])
                with store.open_input_file(path) as file:
                    lines = file.read_at(p["length"], p["start"]).split(b"\n")[: p["lines"]]
                values = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array(range(p["first"], p["first"] + len(values)), pa.int64()), pa.array(values, pa.string())], names=["row", "value"])

    dealt = wanted.repartition(spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(read, "row long, value string").where((F.col("row") >= low) & (F.col("row") < high))


def read_blocks(spark: SparkSession, index: DataFrame, low: int, high: int) -> DataFrame:
    """The same through Spark's reader of lines; blocks beyond the range aren't numbered."""
    some = index.where((F.col("first_row") < high) & (F.col("first_row") + F.col("lines") > low))
    files = [unquote(r["file"]) for r in some.select("file", "source_ord").distinct().orderBy("source_ord").collect()]
    lines = placed(spark.read.option("lineSep", "\n").text(files), files).withColumn("block", F.col("line_ord.block"))
    near = lines.join(some.select("file", "block", "first_row"), ["file", "block"])
    row = F.col("first_row") + F.row_number().over(W.partitionBy("file", "block").orderBy("line_ord.line")) - 1
    return near.select(row.alias("row"), F.regexp_replace("value", "\r$", "").alias("value")).where((F.col("row") >= low) & (F.col("row") < high))


def scan(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """Every configuration and split of a spec that exists, as columns config and split. ALL means the folders there are, in sorted order."""
    there = {}
    for config in configurations(spark, spec) or ("",):
        for split in spec.splits:
            path = "/".join(p for p in (spec.path, config, split) if p)
            if exists(spark, path):
                there[path] = (config, split)
    if not there:
        raise FileNotFoundError(spec.path)
    # one scan over all of them: a file's folder tells its slice, columns are those of any
    rows = spark.read.format(spec.format).option("mergeSchema", "true").load(list(there))
    place = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    slices = F.create_map(*(x for path, (config, split) in there.items() for x in (F.lit(_full(spark, path)), F.struct(F.lit(config).alias("config"), F.lit(split).alias("split")))))
    of = F.coalesce(F.try_element_at(slices, F.regexp_replace(place, "/[^/]*$", "")), F.try_element_at(slices, place))
    return rows.select("*", of["config"].alias("config"), of["split"].alias("split"))


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def configurations(spark: SparkSession, spec: SourceSpec, most: int | None = None) -> tuple[str, ...]:
    if spec.configs != "ALL":
        return tuple(spec.configs)[:most]
    p, fs = hadoop_path(spark, spec.path)
    return tuple(sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()))[:most]


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    """The first of a chain of places that is there."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError("none of the places exists")


def first_or_build(spark: SparkSession, paths: list[str], build: Callable[[str], None]) -> str:
    """The first of a chain of places that is there; where none is, the last one, built."""
    try:
        return first_existing(spark, paths)
    except FileNotFoundError:
        build(paths[-1])
        return first_existing(spark, paths[-1:])


def find(spark: SparkSession, root: str, pattern: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def probe(df: DataFrame, rows: int = 2, characters: int = 220) -> dict:
    """Schema and a few cut rows; counting is left to the format's own metadata."""
    cut = df.limit(rows).select(*(F.substring(F.col(f"`{c}`").cast("string"), 1, characters).alias(c) for c in df.columns))
    return {"columns": dict(df.dtypes), "rows": df.count(), "sample": [r.asDict() for r in cut.collect()]}


def peek(df: DataFrame, rows: int = 2000) -> DataFrame:
    """A few rows without reading the rest: partitions are opened one after another until there are enough."""
    return df.limit(rows)


def split_metadata(spark: SparkSession, spec: SourceSpec, label: str | None = None, most_names: int = 80) -> DataFrame:
    """config, split, columns, rows, names of every slice that exists. Counts come from the format's footers, columns from its schema; only the label's column is read."""
    found = []
    for config in configurations(spark, spec) or ("",):
        for split in spec.splits:
            path = "/".join(p for p in (spec.path, config, split) if p)
            if exists(spark, path):
                df = spark.read.format(spec.format).load(path)
                names = [str(r[0]) for r in label_universe(df, label, most_names).collect()] if label and label in df.columns else None
                found.append((config, split, ", ".join(f"{n} {t}" for n, t in df.dtypes), df.count(), names))
    return spark.createDataFrame(found, "config string, split string, columns string, rows long, names array<string>")


def write_probe(spark: SparkSession, df: DataFrame, path: str) -> dict:
    """The report of a probe as a document."""
    found = probe(df)
    write_sidecar(spark, path, found)
    return found


def label_universe(df: DataFrame, label: str, most: int = 500) -> DataFrame:
    return df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(most)


def registry(path: str) -> tuple[list[SourceSpec], dict[str, Callable]]:
    """SPECS and ADAPTERS of a user's file of sources."""
    spec = importlib.util.spec_from_file_location("decisia_user_specs", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return list(getattr(module, "SPECS", [])), dict(getattr(module, "ADAPTERS", {}))


def only(specs: list[SourceSpec], names: str | None) -> tuple[list[SourceSpec], list[str]]:
    """Specs of a comma-separated list, and the names that there are none of."""
    if not names:
        return specs, []
    asked = [n.strip() for n in names.split(",")]
    return [s for s in specs if s.name in asked], [n for n in asked if n not in {s.name for s in specs}]


def write_rows(df: DataFrame, path: str, format: str = "json") -> None:
    """The commit protocol writes to a temporary place and renames, so a reader never sees half a result."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").format(format).save(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


#: A training item: token ids, marker places, the kind of question, the gold distribution and its greatest place.
ITEM = "guid string, ids array<int>, markers array<int>, qtype tinyint, target array<double>, label int"


def write_items(items: DataFrame, path: str, shard: str = "shard") -> None:
    """A folder a shard, whole or not at all."""
    items.write.mode("overwrite").partitionBy(shard).parquet(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items with their lengths, by the items' schema and the shard of the folder."""
    return spark.read.schema(f"{ITEM}, shard int").parquet(path).withColumn("length", F.size("ids"))


def item_stats(items: DataFrame, shard: str = "shard") -> DataFrame:
    """By shard: items, tokens, the longest, and counts of the kinds of questions."""
    kinds = [F.count_if(F.col("qtype") == i).alias(n) for i, n in enumerate(("choices", "scores", "nouls"))]
    return items.groupBy(shard).agg(F.count("*").alias("items"), F.sum(F.size("ids")).cast("long").alias("tokens"), F.max(F.size("ids")).alias("longest"), *kinds)


def shard_number(path: str) -> int:
    """The number in a name like shard_12; 0 without one."""
    found = re.search(r"shard[_=](\d+)", path)
    return int(found[1]) if found else 0


def merge_items(spark: SparkSession, paths: Iterable[str], result: str, force: bool = False) -> dict:
    """Items of many shards, in the order of their numbers, to one table with a sidecar of what it holds; done already if both agree with the shards."""
    listed = sorted(paths, key=shard_number)
    if not listed:
        raise FileNotFoundError("no shards")
    parts = None
    for path in listed:
        part = spark.read.schema(ITEM).parquet(path).withColumn("shard", F.lit(shard_number(path)))
        parts = part if parts is None else parts.unionByName(part)
    stats = [r.asDict() for r in item_stats(parts).orderBy("shard").collect()]
    sidecar = f"{result}.stats.json"
    if up_to_date(spark, result, sidecar, force) and (read_sidecar(spark, sidecar) or {}).get("shards") == stats:
        return read_sidecar(spark, sidecar)
    parts.write.mode("overwrite").parquet(result)
    return write_stats(spark, result, {"shards": stats})


def write_stats(spark: SparkSession, result: str, values: dict, format: str = "parquet") -> dict:
    """The sidecar of a written result: the values, and the rows and the fingerprint by which a later run knows it again."""
    row = fingerprint(spark.read.format(format).load(result)).first()
    said = values | {"rows": row["rows"], "fingerprint": str(row["fingerprint"]), "format": format}
    write_sidecar(spark, f"{result}.stats.json", said)
    return said


COPIED = "source string, target string, bytes long, crc32 long"


def copy_tree(spark: SparkSession, source: str, target: str) -> DataFrame:
    """A file, or all files below a folder, to another place of any store: source, target, bytes, crc32 of each, which also lie in target's table _copied.

    Tasks copy a file each, a few megabytes at a time, under a name of their own that becomes the file's when it is whole, so that a task that comes again leaves one file. What has
    gone over is compared with the list it was copied from. Where tasks can't open one of the stores, the driver copies.
    """
    listed = listing(spark, source)
    if not listed:
        raise FileNotFoundError(source)
    root, place = hadoop_path(spark, source)[1].makeQualified(hadoop_path(spark, source)[0]).toString().rstrip("/"), hadoop_path(spark, target)
    to = place[1].makeQualified(place[0]).toString().rstrip("/")
    pairs = [(f, to + f[len(root) :], n) for f, n, _ in listed]
    if not (reachable(uri(root)) and reachable(uri(to))):
        a, from_fs = hadoop_path(spark, source)
        if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, a, place[1], place[0], False, True, spark._jsc.hadoopConfiguration()):
            raise OSError(f"can't copy {source} to {target}")
        return spark.createDataFrame([(*p, None) for p in pairs], COPIED)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _ in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                (from_store, read), (to_store, write) = arrow_fs.FileSystem.from_uri(uri(a)), arrow_fs.FileSystem.from_uri(uri(b))
                folder, _, name = write.rpartition("/")
                to_store.create_dir(folder, recursive=True)
                own, size, crc = f"{folder}/.{name}.{uuid.uuid4().hex}", 0, 0
                with from_store.open_input_stream(read) as file, to_store.open_output_stream(own) as out:
                    while block := file.read(PIECE_BYTES):
                        out.write(block)
                        size, crc = size + len(block), zlib.crc32(block, crc)
                to_store.move(own, write)
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b]), pa.array([size], pa.int64()), pa.array([crc], pa.int64())], names=["source", "target", "bytes", "crc32"])

    files = spark.createDataFrame(pairs, "source string, target string, bytes long").repartition(min(len(pairs), spark.sparkContext.defaultParallelism * 4))
    done = f"{to}/_copied" if root != listed[0][0] else f"{to}._copied"
    files.mapInArrow(copy, COPIED).write.mode("overwrite").parquet(done)
    found = spark.read.schema(COPIED).parquet(done)
    if found.agg(F.sum("bytes")).first()[0] != sum(n for _, n, _ in listed):
        raise OSError(f"{source} changed while it was copied")
    return found


def uri(path: str) -> str:
    """A qualified Hadoop path as an address with its signs escaped."""
    scheme, _, rest = path.partition(":")
    rest = "//" + rest if not rest.startswith("//") else rest
    return f"{scheme}:{quote(rest)}"


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and a sum of row hashes: the same for any order and any partitioning."""
    columns = [F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in sorted(df.dtypes)]
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("fingerprint"))


def write_sidecar(spark: SparkSession, path: str, values: dict) -> None:
    """A small JSON document next to a result, by write and rename."""
    p, fs = hadoop_path(spark, path)
    near = spark._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(near, True)
    out.write(bytearray(json.dumps(values, ensure_ascii=False, sort_keys=True, default=str).encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(near, p):
        raise OSError(f"can't rename to {path}")


def read_sidecar(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def up_to_date(spark: SparkSession, result: str, sidecar: str, force: bool = False) -> bool:
    """Whether a result is there with the rows and the fingerprint that its sidecar says: other rows of the same number don't count as done."""
    said = None if force else read_sidecar(spark, sidecar)
    if not said or not exists(spark, result):
        return False
    found = fingerprint(spark.read.format(said.get("format", "parquet")).load(result)).first()
    return found["rows"] == said.get("rows") and str(found["fingerprint"]) == said.get("fingerprint")


def key_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], mode: str = "auto") -> DataFrame:
    """Keys kept as Parquet. auto: read if there, else built and written; rebuild: built anew; cached: read, and an error if not there."""
    if mode not in ("auto", "rebuild", "cached"):
        raise ValueError(f"{mode} is no mode")
    there = exists(spark, path)
    if mode == "cached" and not there:
        raise FileNotFoundError(path)
    if mode == "rebuild" or not there:
        build().select("key").distinct().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bucketed_keys(spark: SparkSession, path: str, build: Callable[[], DataFrame], mode: str = "auto", buckets: int = 64) -> DataFrame:
    """As key_table, in buckets by key: whatever meets these keys in a join is dealt by key to as many places, and the keys, however many, stay where they are.

    A document beside the keys says how many buckets there are, by which another session reads them as such.
    """
    if mode not in ("auto", "rebuild", "cached"):
        raise ValueError(f"{mode} is no mode")
    name, there = f"keys_{hashlib.md5(path.encode()).hexdigest()}", exists(spark, f"{path}.buckets.json")
    if mode == "cached" and not there:
        raise FileNotFoundError(path)
    if mode == "rebuild" or not there:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        keys = build().select("key").distinct()
        keys.repartition(buckets, "key").write.mode("overwrite").format("parquet").bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        write_sidecar(spark, f"{path}.buckets.json", {"buckets": buckets, "type": keys.schema["key"].dataType.simpleString()})
    elif not spark.catalog.tableExists(name):
        said = read_sidecar(spark, f"{path}.buckets.json")
        spark.sql(f"CREATE TABLE {name} (key {said['type']}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {said['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def spec_json(specs: list[SourceSpec]) -> str:
    return json.dumps([asdict(s) for s in specs], ensure_ascii=False)


def local_files(root: str, pattern: str) -> list[str]:
    return [str(p) for p in sorted(Path(root).glob(pattern))]


PREDICTIONS = (
    "predictions array<struct<id string, workflow string, latency_ms double, questions map<string,struct<type string>>, "
    "pred map<string,struct<probabilities map<string,double>, distribution map<string,double>, noul double>>, gold map<string,struct<probabilities map<string,double>>>>>"
)
RESULTS = "task_id string, correct boolean, ok boolean, latency_s double, usage struct<input_tokens bigint>, probs map<string,double>"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A prediction document to one row a question: id, workflow, qid, qtype, keys and g in the gold's order, p beside it (null without a prediction), latency_ms."""
    each = spark.read.schema(PREDICTIONS).option("multiLine", "true").json(path).select(F.explode("predictions").alias("r")).select("r.*")
    asked = each.select("id", "workflow", "latency_ms", "questions", "pred", F.explode("gold").alias("qid", "gold"))
    said = F.try_element_at("pred", "qid")
    p = F.coalesce(said["probabilities"], said["distribution"], F.when(said["noul"].isNotNull(), F.create_map(F.lit("false"), 1 - said["noul"], F.lit("true"), said["noul"])))
    keys = F.map_keys("gold.probabilities")
    return asked.select("id", "workflow", "qid", F.try_element_at("questions", "qid")["type"].alias("qtype"), keys.alias("keys"), F.map_values("gold.probabilities").alias("g"), F.when(p.isNotNull(), F.transform(keys, lambda k: F.coalesce(F.try_element_at(p, k), F.lit(0.0)))).alias("p"), "latency_ms")


def read_results(spark: SparkSession, path: str, tasks: DataFrame) -> DataFrame:
    """Benchmark results with their tasks (task_id, tier, gold_probs); a result without a task is an error."""
    results = spark.read.schema(RESULTS).json(path)
    lost = results.join(tasks, "task_id", "left_anti").count()
    if lost:
        raise ValueError(f"{lost} results have no task")
    return results.join(tasks, "task_id")


def write_evaluation(spark: SparkSession, rows: DataFrame, summary: DataFrame, path: str) -> None:
    """The raw predictions as a table and the summary's one row as a document beside it."""
    rows.write.mode("overwrite").parquet(path)
    write_sidecar(spark, f"{path}.summary.json", summary.first().asDict(recursive=True))
