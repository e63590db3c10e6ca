"""Candidates to decision rows: options permuted and lettered, distractors drawn, gold distributions, leaks refused.

A decision row is (guid, workflow, state, questions, gold), the last three JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decisia.functions import rand, text
from decisia.functions.once import once
from decisia.operators.shapes import LETTERS

MOST_SHOWN, FEWEST, MOST = 6, 2, 16


def names_of(df: DataFrame, column: str, most: int = 500) -> Column:
    """The distinct values of a column as a literal list, in order; more than most are an error, since the list goes to every task."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} names in {column}")
    return F.array(*(F.lit(v) for v in found))


def overlap(option: Column, state_tokens: Column) -> Column:
    """Shared words of an option and the state, two at most: the bucket of a distractor."""
    return F.least(F.size(F.array_intersect(text.tokens(option), state_tokens)), F.lit(2))


def distractors(options: Column, label: Column, state_text: Column, guid: Column, low: int, high: int, seed: int, bucket: bool = True) -> Column:
    """Places of low to high others, drawn by guid; with bucket, of the gold option's overlap; null where there are fewer than low."""
    tokens = text.tokens(state_text)
    gold = overlap(F.element_at(options, label + 1), tokens)
    places = F.filter(F.sequence(F.lit(0), F.size(options) - 1), lambda i: (i != label) & ((overlap(F.element_at(options, i + 1), tokens) == gold) if bucket else F.lit(True)))
    drawn = F.transform(rand.permuted(places, guid, seed), lambda x: x["item"])
    wanted = F.least(rand.randint(guid, low, high, seed, "n"), F.size(places))
    return F.when(F.size(places) >= low, F.slice(drawn, 1, wanted))


def shown(candidates: DataFrame, seed: int = 7, low: int = 3, high: int = 5, bucket: bool = False) -> DataFrame:
    """Adds shown (options in display order) and gold (display place, from 0) to choice rows; rows without enough distractors go."""
    tidy = F.transform("options", lambda o: text.clean(o))
    rows = once(candidates.where(F.col("kind") == "choice"), options=tidy)
    rows = rows.where(~F.array_contains("options", "") & (F.size(F.array_distinct("options")) == F.size("options")))
    guid, label = F.col("guid"), F.col("label")
    others = distractors(F.col("options"), label, F.array_join(F.map_values("state"), " "), guid, low, high, seed, bucket)
    every = F.sequence(F.lit(0), F.size("options") - 1)
    places = F.when(F.size("options") <= MOST_SHOWN, every).otherwise(F.concat(F.array(label), others))
    rows = once(rows, places=F.transform(rand.permuted(places, guid, seed), lambda x: x["item"])).where(F.col("places").isNotNull())
    return once(rows, shown=F.transform("places", lambda i: F.element_at("options", i + 1)), gold=(F.array_position("places", label) - 1).cast("int")).drop("places")


def lettered(options: Column) -> Column:
    return F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.size(options)), lambda i: F.substring(F.lit(LETTERS), i, F.lit(1))), options)


def json_of(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def question(kind: Column, instructions: Column, criteria: Column) -> Column:
    return json_of(F.create_map(F.lit("decision"), F.struct(kind.alias("type"), instructions.alias("instructions"), criteria.alias("criteria"))))


def answer(probabilities: Column) -> Column:
    return json_of(F.create_map(F.lit("decision"), F.struct(probabilities.alias("probabilities"))))


def decision_rows(candidates: DataFrame, seed: int = 7, kind: str | None = None, **draw) -> DataFrame:
    """Rows that leak their answer, or whose choices aren't 2 to 16, go. Candidates known to be of one kind are read once for it, others once a kind."""
    choice = shown(candidates, seed, **draw)
    choice = once(choice, criteria=lettered(F.col("shown")))
    criteria = F.col("criteria")
    one_hot = F.map_from_arrays(F.map_keys(criteria), F.transform(F.sequence(F.lit(0), F.size("shown") - 1), lambda i: F.when(i == F.col("gold"), 1.0).otherwise(0.0)))
    head = ["guid", "workflow"]
    choices = choice.where(F.size("shown").between(FEWEST, MOST)).select(*head, json_of(F.struct(F.col("state"), criteria.alias("choices"))).alias("state"), question(F.col("kind"), F.col("instructions"), criteria).alias("questions"), answer(one_hot).alias("gold"))
    levels = F.transform(F.sequence(F.lit(0), F.size("options") - 1), lambda i: i.cast("string"))
    score = candidates.where(F.col("kind") == "score")
    scores = score.select(
        *head, json_of(F.col("state")).alias("state"), question(F.col("kind"), F.col("instructions"), F.map_from_arrays(levels, "options")).alias("questions"),
        answer(F.map_from_arrays(levels, F.transform(F.sequence(F.lit(0), F.size("options") - 1), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0)))).alias("gold"),
    )
    noul = candidates.where(F.col("kind") == "noul")
    pair = lambda no, yes: F.create_map(F.lit("false"), no, F.lit("true"), yes)
    criteria = pair(F.try_element_at("options", F.lit(1)), F.try_element_at("options", F.lit(2)))
    nouls = noul.select(*head, json_of(F.col("state")).alias("state"), question(F.col("kind"), F.col("instructions"), criteria).alias("questions"), answer(pair(1 - F.col("p"), F.col("p"))).alias("gold"))
    by_kind = {"choice": choices, "score": scores, "noul": nouls}
    made = by_kind[kind] if kind else choices.unionByName(scores).unionByName(nouls)
    made = once(made, state=F.col("state"), questions=F.col("questions"), gold=F.col("gold"))
    made = once(once(made, low=F.lower("state")), leaky=text.has_leak(F.col("state"), low=F.col("low")))
    return made.where("not leaky").drop("leaky", "low")


def hard_negatives(labels: DataFrame, name: str = "label", most: int = 30, separator: str = "_") -> DataFrame:
    """For each label the most alike others by shared name parts of more than two characters; labels is a list of names."""
    parts = F.array_distinct(F.filter(F.split(name, separator), lambda t: F.length(t) > 2))
    names = labels.select(F.col(name).alias("label"), parts.alias("own"))
    each = names.select("label", F.explode("own").alias("part"))
    alike = each.join(each.select(F.col("label").alias("other"), "part"), "part").where("label <> other").groupBy("label", "other").agg(F.count("*").alias("overlap"))
    # labels that share nothing come last, by name: of the first 2 * most names at most most are alike or the label itself
    first = F.broadcast(names.select(F.col("label").alias("other")).orderBy("other").limit(2 * most + 1))
    rest = names.select("label").crossJoin(first).where("label <> other").join(alike, ["label", "other"], "left_anti").withColumn("overlap", F.lit(0).cast("long"))
    place = F.row_number().over(W.partitionBy("label").orderBy(F.col("overlap").desc(), "other"))
    return alike.select("label", "other", "overlap").unionByName(rest).withColumn("place", place).where(F.col("place") <= most).select("label", "other", F.col("overlap").cast("int"), "place")
