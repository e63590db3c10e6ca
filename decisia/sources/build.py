"""Running a catalog entry: scan, budget, adapter, emission, exclusion and dedup, with the accounting of every slice."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from decisia.functions import text
from decisia.operators import dedup, emit, sample, shapes
from decisia.sources import files
from decisia.sources.files import SourceSpec
from decisia.sources.shared import scratch

Scan = Callable[[SparkSession, SourceSpec, str, str], DataFrame]


def slice_of(spark: SparkSession, spec: SourceSpec, config: str, split: str) -> DataFrame:
    return spark.read.format(spec.format).load("/".join(p for p in (spec.path, config, split) if p))


def budgeted(rows: DataFrame, spec: SourceSpec, number: str = "_row", seed: int = 7) -> DataFrame:
    """As many rows as the target says: the first ones, or those of the greatest or least draws."""
    if spec.target is None:
        return rows
    if spec.take == "first":
        return rows.where(F.col(number) < spec.target)
    if spec.take == "reservoir":
        return sample.reservoir(rows, number, spec.target, seed).drop("u")
    return sample.shuffled_take(rows, number, spec.target, seed)


def argument(value) -> Column | list[Column]:
    return F.expr(value) if isinstance(value, str) else [F.expr(v) for v in value]


def language_of(spec: SourceSpec, config: str) -> Column:
    if spec.language == "config":
        return F.lit(config)
    return F.expr(spec.language[1:]) if spec.language.startswith("=") else F.lit(spec.language)


def shaped(spec: SourceSpec, rows: DataFrame, config: str = "", split: str = "train", names: list[str] | None = None, adapters: dict[str, Callable] = shapes.ADAPTERS) -> DataFrame:
    """Candidates of one slice: the spec's columns and options as the adapter's arguments. rows has _row, the row's number in the slice."""
    adapter, options = adapters[spec.shape], dict(spec.options)
    if "pair" in options:  # how the source calls its two texts
        options["fields"] = options.pop("pair")
    columns = {k: argument(v) for k, v in spec.columns.items()}
    guid = shapes.guid(spec.name, F.lit(config or "-"), F.lit(split), F.col("_row"))
    workflow, language = shapes.workflow_of(spec.workflow, F.lit(config)), language_of(spec, config)
    if spec.fields:
        rows = rows.withColumn("_more", F.map_from_arrays(shapes.texts(list(spec.fields)), F.array(*(state_field(v) for v in spec.fields.values()))))
    if spec.shape == "suite":
        return shapes.suite_row(rows, guid, workflow, language, config=config, **options)
    if spec.shape == "label_str" and "names" not in options:
        options["names"] = names or [r[0] for r in files.label_universe(rows.select(columns["label"].alias("label")), "label").collect()]
    if spec.shape == "emotion_query":
        return adapter(rows, guid, workflow, **columns, **options)
    return adapter(rows, guid, workflow, language, **columns, **options)


def state_field(value: str) -> Column:
    """SQL, or a column of JSON after "json:" whose values are joined."""
    return text.clean(text.flattened(F.col(value[5:]))) if value.startswith("json:") else text.clean(F.expr(value))


def emitted(spec: SourceSpec, made: DataFrame, seed: int = 7) -> DataFrame:
    """Decision rows of one slice, whose candidates are of one kind."""
    low, high = spec.draw or (3, 5)
    return emit.decision_rows(made, seed, made.schema["kind"].metadata.get("kind"), low=low, high=high, bucket=spec.bucket)


class Slice(NamedTuple):
    """One configuration and split of an entry, and its place in the order of the catalog."""

    at: int
    spec: SourceSpec
    config: str
    split: str

    def address(self) -> str:
        return "/".join(p for p in (self.spec.path, self.config, self.split) if p)


def slices_of(spark: SparkSession, specs: Iterable[SourceSpec]) -> tuple[list[Slice], list[dict]]:
    """All slices in the order of entries, configurations and splits, and a record of each entry whose configurations can't be listed."""
    found: list[Slice] = []
    failed = []
    for spec in specs:
        try:
            configs = files.configurations(spark, spec) or ("",)
        except Exception as error:  # noqa: BLE001 - the accounting names it
            failed.append({"spec": spec.name, "config": "", "split": "", "error": said(error)})
            continue
        for config in configs:
            found += [Slice(len(found) + k, spec, config, split) for k, split in enumerate(spec.splits)]
    return found, failed


def said(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error)[:120]}"


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False, sort_keys=True, default=str).encode()).hexdigest()


def lenient(spark: SparkSession) -> SparkSession:
    """A session of the same settings in which a value that doesn't convert is null, so that its row is refused by its shape and the run goes on."""
    made = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            made.conf.set(key, value)
    made.conf.set("spark.sql.ansi.enabled", "false")
    return made


class Ledger:
    """The slices that are done: a document each, written when the slice's table is whole. Its fingerprint is that of the slice's files (names, sizes, times), of its spec and of the seed."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.done: dict[str, dict] = {}
        if files.exists(spark, root):
            for row in spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(root).collect():  # a short document a slice
                record = json.loads(row[0])
                self.done[record["fingerprint"]] = record

    def find(self, fingerprint: str | None) -> dict | None:
        record = self.done.get(fingerprint) if fingerprint else None
        return record if record and files.exists(self.spark, record["table"]) else None

    def commit(self, record: dict) -> None:
        files.write_sidecar(self.spark, f"{self.root}/{record['fingerprint'][:32]}.json", record)


def taken(rows: DataFrame, spec: SourceSpec, seed: int) -> tuple[DataFrame, Observation]:
    """The rows that the target takes, with _row, and how many were seen for it: all of a reservoir, else those taken."""
    numbered = rows if "_row" in rows.columns else files.in_order(rows, spec.format, spec.target if spec.take == "first" else None)
    seen, count = Observation(), F.count(F.lit(1)).alias("n")
    if spec.take == "reservoir":
        return budgeted(numbered.observe(seen, count), spec, seed=seed), seen
    return budgeted(numbered, spec, seed=seed).observe(seen, count), seen


def run_slice(one: Slice, rows: DataFrame, table: str, names: list[str] | None, seed: int, adapters: dict[str, Callable] = shapes.ADAPTERS) -> dict:
    """Writes the slice's decision rows to a table, in one pass over its rows; gives how many were seen, refused by their shape and emitted."""
    if one.spec.shape == "label_str" and "names" not in one.spec.options and names is None:  # all labels of the slice, not of the rows taken
        label = argument(one.spec.columns["label"])
        names = [r[0] for r in files.label_universe(rows.select(label.alias("label")), "label").collect()]
    some, seen = taken(rows, one.spec, seed)
    count, shape, emitted_rows = F.count(F.lit(1)).alias("n"), Observation(), Observation()
    made = shaped(one.spec, some, one.config, one.split, names, adapters).observe(shape, count)
    out = emitted(one.spec, made, seed).withColumn("key", text.key_of(text.norm_state(F.col("state"))))
    head = dict(spec=F.lit(one.spec.name), config=F.lit(one.config), split=F.lit(one.split))
    row = F.regexp_extract("guid", r"^(?:[^/]*/){3}([0-9]+)", 1).cast("long")
    out.withColumns(head).withColumn("at", row).select(*ROWS).observe(emitted_rows, count).write.mode("overwrite").parquet(table, compression="zstd")
    n = observed(seen)
    return {"seen": some.count() if n is None else n, "shaped": observed(shape) or 0, "emitted": observed(emitted_rows) or 0}


def observed(count: Observation) -> int | None:
    """None where the optimizer has taken the place out, since nothing can come through it (a suite without that branch)."""
    try:
        return count.get["n"]
    except Exception:  # noqa: BLE001 - there is no kinder way to ask
        return None


#: Columns of a slice's table; at is the source row's number.
ROWS = ("guid", "workflow", "state", "questions", "gold", "spec", "config", "split", "at", "key")
ROWS_SCHEMA = ", ".join(f"{c} {'long' if c == 'at' else 'string'}" for c in ROWS)
STATS = "spec string, config string, split string, seen long, dropped_shape long, dropped_pool long, dropped_dup long, rows long, error string"


#: Rows that repeat an earlier one and are sent to every task; beyond, slices meet them in a join.
MOST_REPEATS = 2_000_000


def first_states(rows: DataFrame) -> DataFrame:
    """Of rows with one key the first by slice, at and guid, which tells rows apart. What travels are these columns, not the rows: those that come later are listed and left out."""
    narrow, place = rows.select("key", "slice", "at", "guid"), F.struct("slice", "at", "guid")
    repeated = narrow.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    number = lambda: F.shiftleft(F.col("slice").cast("long"), 44).bitwiseOR(F.col("at"))
    later = narrow.join(repeated, "key").where(place != F.col("first")).select(F.xxhash64("guid").alias("_name"), number().alias("_number"), F.col("guid").alias("_guid"))
    path = scratch(rows.sparkSession, "repeats")
    later.write.parquet(path, compression="zstd")
    later = rows.sparkSession.read.schema(later.schema).parquet(path)
    later = F.broadcast(later.drop("_guid")) if later.count() <= MOST_REPEATS else later
    same = (F.xxhash64("guid") == F.col("_name")) & (number() == F.col("_number"))
    return rows.join(later, same & (F.col("guid") == F.col("_guid")) if "_guid" in later.columns else same, "left_anti")


def build(
    spark: SparkSession, specs: Iterable[SourceSpec], held_keys: DataFrame | None = None, scan: Scan = slice_of, names: dict[str, list[str]] | None = None, path: str | None = None, workers: int = 4, seed: int = 7,
    adapters: dict[str, Callable] = shapes.ADAPTERS,
) -> tuple[DataFrame, DataFrame]:
    """Decision rows of all specs, the first of equal states in the order of specs, configurations, splits and source rows, none whose state is held; and the
    slices' accounting: spec, config, split, seen, dropped_shape, dropped_pool, dropped_dup, rows, error.

    A slice is a job of one pass over its files: what it saw, refused and emitted is observed while it runs, and an error, while planning or in a task,
    is that slice's alone. Some slices run at a time (workers). Their tables are committed to a ledger under path, so that a run that was ended goes on with the slices that are not
    done; a slice whose files or spec have changed is done again. All tables are then read as one, and rows, a manifest a spec and a summary are written to path.
    Without one, slices, manifests and summary lie in the shared folder, and rows are those tables less the rows that repeat others, with no copy of them.

    Rows are numbered in the order of their files: scan gives what a reader gives, or rows that have a number, _row, already.
    """
    root = path or scratch(spark, "catalog")
    listed, records = slices_of(spark, specs)
    ledger, session = Ledger(spark, f"{root}/ledger"), lenient(spark)

    def run(one: Slice) -> dict:
        head = {"at": one.at, "spec": one.spec.name, "config": one.config, "split": one.split}
        try:
            own = (names or {}).get(one.spec.name)
            by_path = files.listing(spark, one.address())
            mark = digest(asdict(one.spec), one.config, one.split, own, seed, by_path) if by_path else None
            done = ledger.find(mark)
            if done:
                return done | head
            rows = scan(session, one.spec, one.config, one.split)
            if mark is None and (inputs := rows.inputFiles()):
                mark = digest(asdict(one.spec), one.config, one.split, own, seed, [x for f in sorted(inputs) for x in files.listing(spark, f)])
                done = ledger.find(mark)
                if done:
                    return done | head
            table = f"{root}/slices/{digest(head)[:16]}-{uuid.uuid4().hex}"
            record = head | {"fingerprint": mark, "table": table} | run_slice(one, rows, table, own, seed, adapters)
            if mark:
                ledger.commit(record)
            return record
        except Exception as error:  # noqa: BLE001 - the accounting names it; the other slices go on
            return head | {"error": said(error)}

    with ThreadPoolExecutor(workers) as pool:
        running = [pool.submit(run, one) for one in listed]
        try:
            records += [r.result() for r in running]
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise
    good = [r for r in records if "error" not in r]
    if good:
        rows = spark.read.schema(ROWS_SCHEMA).parquet(*(r["table"] for r in good))
    else:
        rows = spark.createDataFrame([], ROWS_SCHEMA)
    order = spark.createDataFrame([(r["spec"], r["config"], r["split"], r["at"]) for r in good], "spec string, config string, split string, slice int")  # a row a slice
    fresh = dedup.not_in(rows, held_keys, "key") if held_keys is not None else rows
    placed = fresh.join(F.broadcast(order), ["spec", "config", "split"])
    kept = first_states(placed).select(*ROWS)
    if path:
        kept.write.mode("overwrite").parquet(f"{root}/rows", compression="zstd")
        kept = spark.read.schema(ROWS_SCHEMA).parquet(f"{root}/rows")
    counts = {(r["spec"], r["config"], r["split"]): r["n"] for r in kept.groupBy("spec", "config", "split").agg(F.count("*").alias("n")).collect()}
    stats = [accounted(r, counts.get((r["spec"], r["config"], r["split"]), 0)) for r in records]
    by_spec: dict[str, list[dict]] = {}
    for row in stats:
        by_spec.setdefault(row["spec"], []).append(row)
    for name, of_spec in by_spec.items():
        files.write_sidecar(spark, f"{root}/manifests/{name}.manifest.json", {"name": name, "rows": sum(r["rows"] or 0 for r in of_spec), "slices": of_spec})
    files.write_sidecar(spark, f"{root}/summary.json", {"rows": sum(counts.values()), "specs": len(by_spec), "slices": stats})
    return kept, spark.createDataFrame([tuple(r[c.split()[0]] for c in STATS.split(", ")) for r in stats], STATS)


def accounted(record: dict, kept: int) -> dict:
    head = {k: record[k] for k in ("spec", "config", "split")}
    if "error" in record:
        return head | dict.fromkeys(("seen", "dropped_shape", "dropped_pool", "dropped_dup", "rows")) | {"error": record["error"]}
    n = [record["seen"], record["shaped"], record["emitted"], kept]
    return head | {"seen": n[0], "dropped_shape": max(0, n[0] - n[1]), "dropped_pool": n[1] - n[2], "dropped_dup": n[2] - n[3], "rows": n[3], "error": None}
