"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A token budget goes down a tree, domain then language then source. At each node it is shared among the children by their
weights; a child takes no more than its documents hold, times the epochs allowed, and what it leaves goes to its siblings by
their weights, so that only what all siblings together can't take is missed by the parent, whose own siblings take it. That
is one water level a node: children sorted by capacity over weight, the level is (budget - what full children hold) / (weight
of the rest) at the first child that it doesn't fill.

A leaf gives each whole epoch that its budget covers, and of the next the longest prefix that fits, in an order drawn anew
each epoch from the seed. Order keys are digests, dealt into cells by their first digits, as many as keep a cell at some CELL_ROWS
rows whatever the leaf holds: sums over cells find the cell in which a prefix ends, and only that cell is sorted, so that no leaf
is ever gathered in one task.

Cases: null domain, language or source are leaves of their own; null and empty texts count one token and so can be chosen;
repeated rows are told apart only by their order key and pass or fail together with ties at the end of a prefix (all rows of
one key count before any is chosen); a very long text is one row of many tokens, taken only where it fits; nodes of one capacity
and weight go by name; rows of one id in several leaves are chosen leaf by leaf; an empty table gives no rows; extra columns pass
through mix_documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decisia.llm.common import WORD, text_of, written

#: Leaves up to which the plan, a row a leaf, is broadcast; a larger one is joined.
BROADCAST_LEAVES = 50_000
LEVELS = ("domain", "lang", "source")
#: Rows of a cell about which cells get another digit, which divides them by 16; three digits at least.
CELL_ROWS = 65_536

# The target weights of the mix, by node name; a node without one weighs 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "es": 2, "fr": 2}
SOURCE_WEIGHTS: dict[str, int] = {}


def domain_of(source: str = "source") -> Column:
    """A source's domain here: its number modulo 4 ("other" without one)."""
    number = F.regexp_extract(F.col(source), "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("int") % 4).cast("string"))).otherwise("other")


def weight_of(column: str, weights: dict[str, int]) -> Column:
    found = F.lit(1)
    for name, weight in weights.items():
        found = F.when(F.col(column) == name, F.lit(weight)).otherwise(found)
    return found.cast("long")


def tokens_of(text_col: str = "text") -> Column:
    """Words, one at least: the unit of the budget."""
    return F.greatest(F.lit(1), F.regexp_count(text_of(text_col), F.lit(WORD))).cast("long")


def order_key(id_col: str, epoch, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(epoch).cast("string") if isinstance(epoch, int) else epoch.cast("string"), F.lit(str(seed))))


def share_out(nodes: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Adds share: each child's part of the parent's budget. nodes has parent columns, name, weight, capacity and the budget column."""
    siblings = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(1))
    order = siblings.orderBy(F.col("capacity") / F.col("weight"), F.col("name"))
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.col(budget) - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = nodes.withColumn("at", level).withColumn("fits", F.col("at") * F.col("weight") <= F.col("capacity"))
    first = F.max(F.when(F.col("fits"), F.col("at"))).over(siblings)  # the first child that isn't filled has the highest level of those
    share = F.when(first.isNull(), F.col("capacity").cast("double")).otherwise(F.least(F.col("capacity").cast("double"), first * F.col("weight")))
    return ranked.withColumn("share", share).drop("at", "fits")


def budgets(leaves: DataFrame, budget_share: float, epochs: int, weights: tuple[dict, dict, dict]) -> DataFrame:
    """leaves(domain, lang, source, tokens) with budget, whole tokens. Both sides of every join here have a row a node."""
    tree = leaves.withColumn("capacity", F.col("tokens") * epochs)
    domains = tree.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("held"))
    total = F.floor(F.sum("held").over(W.partitionBy(F.lit(1))) * F.lit(float(budget_share))).cast("double")
    top = domains.select("domain", F.col("domain").alias("name"), weight_of("domain", weights[0]).alias("weight"), "capacity", total.alias("budget"))
    top = share_out(top, [], "budget").select("domain", F.col("share").alias("budget"))
    mid = tree.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(top, "domain")
    mid = share_out(mid.withColumn("name", F.col("lang")).withColumn("weight", weight_of("lang", weights[1])), ["domain"], "budget").select("domain", "lang", F.col("share").alias("budget"))
    low = tree.join(mid, ["domain", "lang"])
    low = share_out(low.withColumn("name", F.col("source")).withColumn("weight", weight_of("source", weights[2])), ["domain", "lang"], "budget")
    return low.select(*LEVELS, "tokens", F.floor("share").cast("long").alias("budget"))


def mix(docs: DataFrame, budget_share: float = 0.6, epochs: int = 2, seed: int = 7, weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each choice of a document: doc_id, domain, lang, source, epoch, n_tokens, order_key."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), domain_of().alias("domain"), F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source"), tokens_of(text_col).alias("n_tokens")
    )
    rows = written(rows, "rows")
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    digits = F.least(F.lit(32), F.lit(3) + F.greatest(F.lit(0), F.ceil(F.log(F.col("rows") / (4096 * CELL_ROWS)) / math.log(16)))).cast("int")
    plan = budgets(leaves, budget_share, epochs, weights).join(leaves.select(*LEVELS, digits.alias("digits")), list(LEVELS))
    plan = F.broadcast(plan) if leaves.count() <= BROADCAST_LEAVES else plan
    full = F.floor(F.col("budget") / F.col("tokens")).cast("int")
    drawn = (
        rows.join(plan, list(LEVELS))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(full, F.lit(epochs - 1)))))
        .withColumn("rest", F.col("budget") - F.col("tokens") * F.col("epoch"))
        .withColumn("order_key", order_key("doc_id", F.col("epoch"), seed))
        .withColumn("cell", F.substring("order_key", F.lit(1), F.col("digits")))
        .drop("tokens", "budget", "digits")
    )
    leaf = [*LEVELS, "epoch"]
    sums = drawn.groupBy(*leaf, "rest", "cell").agg(F.sum("n_tokens").alias("held"))
    upto = F.sum("held").over(W.partitionBy(*leaf).orderBy("cell"))
    cells = sums.withColumn("upto", upto).withColumn("done", F.col("upto") <= F.col("rest")).withColumn("room", F.col("rest") - F.col("upto") + F.col("held"))
    cells = cells.where((F.col("room") > 0)).select(*leaf, "cell", "done", "room")
    near = drawn.drop("rest").join(cells, [*leaf, "cell"])
    out = ["doc_id", *LEVELS, "epoch", "n_tokens", "order_key"]
    within = W.partitionBy(*leaf, "cell").orderBy("order_key").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = near.where(~F.col("done")).withColumn("used", F.sum("n_tokens").over(within)).where(F.col("used") <= F.col("room"))
    return near.where("done").select(out).unionAll(last.select(out))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """The documents of a mix of one epoch, with all their columns."""
    chosen = mix(docs, epochs=1, id_col=id_col, **parameters).select(F.col("doc_id").alias("_id"), *(F.col(x).alias(f"_{x}") for x in LEVELS)).distinct()
    leaf = (domain_of() == chosen["_domain"]) & (F.coalesce(docs["lang"], F.lit("?")) == chosen["_lang"]) & (F.coalesce(docs["source"], F.lit("?")) == chosen["_source"])
    return docs.join(chosen, docs[id_col].eqNullSafe(chosen["_id"]) & leaf, "left_semi")
