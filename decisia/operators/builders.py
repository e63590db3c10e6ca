"""Builders of whole sources beyond one adapter a row: web-agent steps, page topics and flags, long texts, rounds, intents, pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decisia.functions import rand
from decisia.functions.text import clean
from decisia.operators import dedup, sample, shapes

# Operations of a web agent, and the attributes that name an element, the first that isn't empty.
OPERATIONS = ("CLICK", "TYPE", "SELECT")
ELEMENT_NAMES = ("placeholder", "aria-label", "text", "value", "title", "alt", "content")
ELEMENT_CHARS, NEGATIVES, ELEMENTS, HISTORY = 60, 25, 26, 4


def element_text(tag: Column, attributes: Column, place: Column) -> Column:
    """'[place] <tag> text': the first attribute (a JSON object's) that isn't empty, white space made single, cut to 60 characters."""
    fields = F.from_json(attributes, "map<string,string>")
    named = F.coalesce(*(F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in ELEMENT_NAMES), F.lit(""))
    return F.rtrim(F.concat(F.lit("["), place.cast("string"), F.lit("] <"), F.coalesce(tag, F.lit("?")), F.lit("> "), F.left(clean(named), F.lit(ELEMENT_CHARS))))


def target_place(pool: Column, target: Column, id_field: str = "id") -> Column:
    """Where the target stands in the pool: the same element, else one of its id, else the first."""
    same = F.array_position(pool, target)
    by_id = F.array_position(F.transform(pool, lambda x: x[id_field]), target[id_field])
    return F.when(same > 0, same - 1).when(by_id > 0, by_id - 1).otherwise(0).cast("int")


def web_steps(tasks: DataFrame, seed: int = 7) -> DataFrame:
    """Two decisions for each step of each task: which operation, and which element.

    tasks: task, instruction, website, summaries (of all steps), steps: array of (op, positive, negative), both arrays of (id, tag, attributes,
    original). An unknown operation is a click; a step without an operation or a positive element goes. The pool is the first positive
    and up to 25 drawn negatives in a drawn order; the state has the last four summaries. Gives guid, kind, instruction, website, history, options, label.
    """
    each = tasks.select("task", "instruction", "website", "summaries", F.posexplode("steps").alias("step", "s")).where("s.op is not null and size(s.positive) > 0")
    key = F.concat_ws("-", "task", F.col("step").cast("string"))
    drawn = F.transform(F.slice(rand.permuted(F.col("s.negative"), key, seed, "negatives"), 1, NEGATIVES), lambda x: x["item"])
    pool = F.transform(F.slice(rand.permuted(F.concat(F.slice("s.positive", 1, 1), drawn), key, seed, "pool"), 1, ELEMENTS), lambda x: x["item"])
    target = F.coalesce(F.try_element_at(F.filter("s.positive", lambda c: c["original"]), F.lit(1)), F.element_at("s.positive", 1))
    rows = each.select(
        "task", "step", "instruction", "website", F.slice("summaries", F.greatest(F.lit(1), F.col("step") - HISTORY + 1), F.least(F.lit(HISTORY), F.col("step"))).alias("history"),
        F.when(F.col("s.op").isin(*OPERATIONS), F.col("s.op")).otherwise("CLICK").alias("op"), pool.alias("pool"), target.alias("target"),
    )
    shown = F.transform("pool", lambda c, i: element_text(c["tag"], c["attributes"], i))
    decisions = F.array(
        F.struct(F.lit("op").alias("kind"), shapes.texts(OPERATIONS).alias("options"), (F.array_position(shapes.texts(OPERATIONS), F.col("op")) - 1).cast("int").alias("label")),
        F.struct(F.lit("el").alias("kind"), shown.alias("options"), target_place(F.col("pool"), F.col("target")).alias("label")),
    )
    two = rows.select("task", "step", "instruction", "website", "history", F.explode(decisions).alias("d"))
    return two.select(F.concat(F.col("task"), F.lit("-step"), F.col("step").cast("string"), F.lit("-"), F.col("d.kind")).alias("guid"), "d.kind", "instruction", "website", "history", "d.options", "d.label")


def page_topics(pages: DataFrame, key: Column, prefix: str, text: Column, label: Column, names: tuple[str, ...], instructions: str, workflow: str = "browser") -> DataFrame:
    """Pages by topic: a choice with all names; pages of other topics go."""
    guid = F.concat_ws("-", F.lit(prefix), label.cast("string"), key.cast("string"))
    return shapes.candidates(pages, guid, F.lit(workflow), "choice", instructions, F.create_map(F.lit("webpage_text"), clean(text)), shapes.texts(names), F.array_position(shapes.texts(names), label) - 1)


def flags(rows: DataFrame, key: Column, prefix: str, field: str, text: Column, flag: Column, instructions: str, workflow: str = "browser") -> DataFrame:
    """Yes-or-no rows without criteria: true where the flag is one."""
    return shapes.candidates(rows, F.concat_ws("-", F.lit(prefix), key.cast("string")), F.lit(workflow), "noul", instructions, F.create_map(F.lit(field), clean(text)), F.array().cast("array<string>"), F.lit(None), F.when(flag == 1, 1.0).otherwise(0.0))


def long_texts(rows: DataFrame, key: str, text: str, label: str, first: int, most_names: int = 32, instructions: str = "Which label fits?") -> DataFrame:
    """The first rows of a long-text source; their distinct labels are the options."""
    some = rows.where(F.col(label).isNotNull()).orderBy(key).limit(first)
    names = [r[0] for r in some.select(label).distinct().orderBy(label).limit(most_names + 1).collect()]
    if not 2 <= len(names) <= most_names:
        raise ValueError(f"{len(names)} labels are no choice")
    return shapes.label_str(some, F.col(key), F.lit("long"), F.lit("en"), F.col(text), F.col(label), names, instructions=instructions)


def rounds(rows: DataFrame, key: str, round_col: str, cap: int, prefix: str = "anli", seed: int = 7) -> DataFrame:
    """A drawn order in each round, the first cap of it, and ids by round and place."""
    drawn = rows.withColumn("_o", rand.order_key(F.col(key), seed, "round"))
    placed = drawn.withColumn("place", F.row_number().over(W.partitionBy(round_col).orderBy("_o", key)) - 1).where(F.col("place") < cap)
    return placed.withColumn("guid", F.concat_ws("-", F.lit(prefix), F.col(round_col).cast("string"), F.col("place").cast("string"))).drop("_o")


def intents(parts: list[DataFrame], key: str, text: str, label: str, out_of_scope: tuple[str, ...] = ("oos",), hard: int = 0, draw: int = 5, separator: str = "_", seed: int = 7) -> DataFrame:
    """Splits put together, rows out of scope dropped; the gold name among drawn others, or among those most like it where hard says how many.

    Gives key, options in a drawn order, and label.
    """
    from decisia.operators import emit

    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = sample.in_scope(rows, label, out_of_scope).select(F.col(key).alias("key"), clean(F.col(text)).alias("text"), F.col(label).alias("gold"))
    names = rows.select(F.col("gold").alias("label")).distinct()
    if hard:
        others = emit.hard_negatives(names, "label", hard, separator).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]).alias("others"))
        drawn = rows.join(others, F.col("gold") == F.col("label")).withColumn("others", F.col("others"))
    else:
        every = [r[0] for r in names.orderBy("label").limit(501).collect()]
        if len(every) > 500:
            raise ValueError("more than 500 names: no pool to draw others from")
        pool = F.array_except(shapes.texts(every), F.array("gold"))
        drawn = rows.withColumn("others", F.transform(F.slice(rand.permuted(pool, F.col("key"), seed, "others"), 1, draw), lambda x: x["item"]))
    options = F.transform(rand.permuted(F.concat(F.array("gold"), "others"), F.col("key"), seed, "shown"), lambda x: x["item"])
    return drawn.select("key", "text", "gold", options.alias("options")).withColumn("label", (F.array_position("options", F.col("gold")) - 1).cast("int"))


def pooled(candidates: DataFrame, target: int, seed: int = 7) -> DataFrame:
    """A pool of candidates in a drawn order, the first of equal states, as many as the target."""
    state = F.array_join(F.transform(F.array_sort(F.map_entries("state")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " || ")
    drawn = candidates.withColumn("_o", rand.order_key(F.col("guid"), seed, "pool")).withColumn("_key", F.xxhash64(F.lower(state), F.array_join("options", "\u0001")))
    return dedup.first_wins(drawn, "_key", "_o", "guid").orderBy("_o", "guid").limit(target).drop("_o", "_key")


def small_arity(rows: DataFrame, label: str, key: str, low: int = 3, high: int = 5, fewest: int = 60, most: int = 151, seed: int = 7) -> DataFrame:
    """Sources of too many names for one choice (fewest to most): the gold name and low to high drawn others, in a drawn order."""
    names = [r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(most + 1).collect()]
    if not fewest <= len(names) <= most:
        return rows.select(key, F.array().cast("array<string>").alias("options"), F.lit(-1).alias("label")).limit(0)
    others = rand.permuted(F.array_except(shapes.texts(names), F.array(label)), F.col(key), seed, "others")
    some = F.transform(F.slice(others, F.lit(1), rand.randint(F.col(key), low, high, seed, "n")), lambda x: x["item"])
    options = F.transform(rand.permuted(F.concat(F.array(label), some), F.col(key), seed, "shown"), lambda x: x["item"])
    made = rows.where(F.col(label).isNotNull()).select(key, F.col(label).alias("_gold"), options.alias("options"))
    return made.withColumn("label", (F.array_position("options", F.col("_gold")) - 1).cast("int")).drop("_gold")
