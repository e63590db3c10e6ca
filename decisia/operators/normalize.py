"""Validation and repair of decision rows: the first failing check names the reason; what passes is put in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisia.functions import text
from decisia.functions.once import once
from decisia.functions.vectors import total

FEWEST, MOST, TINY = 2, 16, 10
MAP, LIST = "map<string,string>", "array<string>"


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def starts(c: Column, sign: str) -> Column:
    """Whether a JSON text, known to be whole, is an object ({) or a list ([)."""
    return F.coalesce(F.ltrim(c).startswith(sign), F.lit(False))


def parsed(df: DataFrame) -> DataFrame:
    """The row with its parts as columns: qid, type, criteria (keys and texts in order), gold keys and values; what can't be read is null.

    Each text is checked once as a whole; parts of a whole text are whole, so their kinds show in their first sign.
    """
    df = once(df, state=F.col("state"), questions=F.col("questions"), gold=F.col("gold"))  # whatever made them is worked out once
    out = once(
        df, _q=F.from_json("questions", MAP), _g=F.from_json("gold", MAP), _s=F.from_json("state", MAP), _read=is_json(F.col("state")) & is_json(F.col("questions")) & is_json(F.col("gold")),
        _objects=starts(F.col("questions"), "{") & starts(F.col("gold"), "{"), _low=F.lower("state"),
    )
    qid = F.try_element_at(F.map_keys("_q"), F.lit(1))
    out = once(out, qid=qid, _question=F.from_json(F.try_element_at("_q", qid), MAP), _probs=F.try_element_at(F.from_json(F.try_element_at("_g", qid), MAP), F.lit("probabilities")))
    criteria = F.try_element_at("_question", F.lit("criteria"))
    is_map, is_list = starts(criteria, "{"), starts(criteria, "[")
    out = once(
        out, qtype=F.try_element_at("_question", F.lit("type")), instructions=F.try_element_at("_question", F.lit("instructions")),
        criteria_kind=F.when(criteria.isNull(), "none").when(is_map, "map").when(is_list, "list").otherwise("other"),
        _fields=F.when(is_map, F.from_json(criteria, MAP)), _items=F.when(is_list, F.from_json(criteria, LIST)), _probabilities=F.when(starts(F.col("_probs"), "{"), F.from_json("_probs", MAP)),
    )
    ordinals = F.transform(F.sequence(F.lit(0), F.size("_items") - 1), lambda i: i.cast("string"))
    is_map, is_list = F.col("criteria_kind") == "map", F.col("criteria_kind") == "list"
    return once(
        out, keys=F.when(is_map, F.map_keys("_fields")).when(is_list & (F.size("_items") > 0), ordinals), texts=F.when(is_map, F.map_values("_fields")).when(is_list, F.col("_items")),
        gold_keys=F.map_keys("_probabilities"), gold_values=F.transform(F.map_values("_probabilities"), lambda v: v.try_cast("double")),
    )


def reason() -> Column:
    """Why a parsed row goes; null if it stays."""
    keys, gold, values, kind = F.col("keys"), F.col("gold_keys"), F.col("gold_values"), F.col("criteria_kind")
    same = F.array_sort(keys) == F.array_sort(gold)
    numbers = F.transform(keys, lambda k: k.try_cast("int"))
    ordinal = F.array_sort(keys) == F.array_sort(F.transform(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: i.cast("string")))
    choice = (
        F.when((kind != "map") | (F.size(keys) < FEWEST), "bad_criteria")
        .when(~same, "criteria_gold_key_mismatch")
        .when(F.size(keys) > MOST, f"choice_arity_gt_{MOST}")
    )
    score = (
        F.when(~kind.isin("map", "list") | keys.isNull() | (F.size(keys) == 0) | F.exists(numbers, lambda n: n.isNull()), "bad_criteria")
        .when(~ordinal, "score_keys_not_ordinal")
        .when(~same, "score_gold_key_mismatch")
    )
    noul = F.when(F.array_sort(gold) != F.array(F.lit("false"), F.lit("true")), "noul_gold_keys").when(~kind.isin("map", "none"), "bad_criteria")
    by_type = F.when(F.col("qtype") == "choice", choice).when(F.col("qtype") == "score", score).when(F.col("qtype") == "noul", noul).otherwise("unknown_qtype")
    bad = F.coalesce(gold.isNull() | (F.size(gold) == 0) | F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    return (
        F.when(~F.col("_read"), "bad_json")
        .when(~F.col("_objects") | (F.size("_q") != 1), "bad_shape")
        .when(~F.map_contains_key("_g", F.col("qid")), "gold_qid_missing")
        .when(bad, "bad_gold")
        .when(F.exists(values, lambda v: v < 0), "negative_gold")
        .when(total(values) <= 0, "gold_zero_sum")
        .when(by_type.isNotNull(), by_type)
        .when(F.coalesce(F.exists(F.map_keys("_s"), lambda k: k.rlike(text.FORBIDDEN_KEYS)), F.lit(False)), "forbidden_state_key")
        .when(text.has_leak(F.col("state"), low=F.col("_low")), "answer_marker_in_state")
        .when(F.length("norm") < TINY, "empty_state")
    )


def normalised(df: DataFrame, rescale: bool = True) -> DataFrame:
    """Adds reason, notes, and for kept rows the one form: qtype, keys, texts, probs (rescaled to one unless asked not to), norm.

    Score levels come in the order of their numbers; the question is called decision whatever its name was.
    """
    scalar = F.coalesce(F.try_variant_get(F.try_parse_json("state"), "$", "string"), F.col("state"))
    rows = once(parsed(df), norm=text.norm_text(F.when(F.col("_read") & starts(F.col("state"), "{"), text.listed(F.col("_s"))).otherwise(scalar)))
    by_number = (F.col("qtype") == "score") & (F.col("criteria_kind") == "map")
    ordinal = F.transform(F.array_sort(F.transform("keys", lambda k: k.try_cast("int"))), lambda i: i.cast("string"))
    rows = once(rows, reason=reason(), _order=F.when(by_number, ordinal).otherwise(F.coalesce("keys", "gold_keys")))
    texts = F.transform("_order", lambda k: F.try_element_at("texts", F.array_position("keys", k).cast("int")))
    values = F.transform("_order", lambda k: F.try_element_at("gold_values", F.array_position("gold_keys", k).cast("int")))
    kept = F.col("reason").isNull()
    rows = once(rows, _texts=F.when(kept, texts), _values=F.when(kept, values), _sum=total(F.col("gold_values")))
    off = F.abs(F.col("_sum") - 1) > 1e-9
    notes = F.array(F.when(by_number, "score_dict_to_list"), F.when(F.col("qid") != "decision", "qid_renamed"), F.when(off, "gold_rescaled"))
    probs = F.when(off, F.transform("_values", lambda v: v / F.col("_sum"))).otherwise(F.col("_values")) if rescale else F.col("_values")
    out = once(rows, probs=probs, notes=F.when(kept, F.filter(notes, lambda n: n.isNotNull())), keys=F.when(kept, F.col("_order")), texts=F.col("_texts"))
    return out.drop("_q", "_g", "_s", "_objects", "_low", "_read", "_question", "_probs", "_fields", "_items", "_probabilities", "_order", "_texts", "_values", "_sum", "gold_values", "gold_keys")
