"""Canonical text: cleaning, state keys, tokens, leak patterns, language tags."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that Java, RE2 and Python agree on.
SPACES = r"[ \t\n\r\f]+"

# Patterns whose presence in a state gives its answer away. The letters and the gap differ between variants.
LEAK_VARIANTS = {"wide": ("A-P0-9", r"\s*"), "audit": ("A-P0-9", r"\s+"), "narrow": ("A-F0-9", r"\s*")}
LEAK_PATTERNS = {
    "answer_mark": r"(?i)\banswer\s*[:=]\s*[{letters}]\b",
    "answerkey": r"(?i)\banswerkey\b",
    "answer_key": r"(?i)\banswer\s+key\b",
    "correct_is": r"(?i)\bcorrect\s+(answer|option|choice|label)\s*(is|:|=)",
    "the_answer_is": r"(?i)\bthe\s+answer\s+is\s*[{letters}]\b",
    "gold_label": r"(?i)\b(gold|correct|true)\s+(label|index|option|choice)\b",
    "korean_answer": "정답\\s*[:：]?",
    "ground_truth": r"(?i)\bground{gap}truth\b",
    "json_field": r'(?i)"(answer|answerkey|label|target|gold)"\s*:',
}
#: Each pattern holds one of these, in any case.
LEAK_CUES = ("answer", "correct", "gold", "true", "정답", "ground", "label", "target")
FORBIDDEN_KEYS = r"(?i)^(answer|answerkey|answer_key|label|gold|target|correct)$"
INFORMATIONAL = {"answer": r"(?i)\banswer", "correct": r"(?i)\bcorrect", "gold": r"(?i)\bgold\b", "korean": "정답"}
PLACEHOLDERS = ("none", "n/a", "na", "null")

# Three-letter language codes and their two-letter forms.
ISO3 = {
    "afr": "af", "amh": "am", "ara": "ar", "arb": "ar", "ary": "ar", "aze": "az", "ben": "bn", "bul": "bg", "ces": "cs",
    "dan": "da", "deu": "de", "ell": "el", "eng": "en", "est": "et", "fas": "fa", "fil": "tl", "fin": "fi", "fra": "fr",
    "guj": "gu", "hau": "ha", "heb": "he", "hin": "hi", "hun": "hu", "hye": "hy", "ibo": "ig", "ind": "id", "isl": "is",
    "ita": "it", "jav": "jv", "jpn": "ja", "kan": "kn", "kat": "ka", "kaz": "kk", "khm": "km", "kir": "ky", "kmr": "ku",
    "kor": "ko", "lav": "lv", "lit": "lt", "mal": "ml", "mar": "mr", "mlg": "mg", "mon": "mn", "msa": "ms", "mya": "my",
    "nep": "ne", "nld": "nl", "nob": "nb", "nya": "ny", "orm": "om", "pan": "pa", "pol": "pl", "por": "pt", "ron": "ro",
    "rus": "ru", "sin": "si", "slk": "sk", "slv": "sl", "sna": "sn", "som": "so", "spa": "es", "srp": "sr", "swa": "sw",
    "swe": "sv", "swh": "sw", "tam": "ta", "tel": "te", "tgl": "tl", "tha": "th", "tir": "ti", "tur": "tr", "ukr": "uk",
    "urd": "ur", "vie": "vi", "xho": "xh", "yor": "yo", "zho": "zh", "zul": "zu",
}


def clean(text: Column) -> Column:
    """White space runs to one space, ends trimmed, null to the empty string."""
    return F.coalesce(F.trim(F.regexp_replace(text.cast("string"), SPACES, " ")), F.lit(""))


def strip_answer(text: Column) -> Column:
    """clean() and without a trailing answer mark."""
    return clean(F.regexp_replace(clean(text), r"(?i)\s*\banswer\s*[:=]\s*[A-F0-9]\b\.?\s*$", ""))


def norm_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


def norm_state(state: Column) -> Column:
    """An object's fields as k=v in the order of keys, joined by ' || '; any other value as its text; then norm_text."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(state)).startswith("OBJECT"), F.lit(False))
    scalar = F.coalesce(F.try_variant_get(F.try_parse_json(state), "$", "string"), state)
    return norm_text(F.when(is_object, listed(F.from_json(state, "map<string,string>"))).otherwise(scalar))


def listed(fields: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(fields, k), F.lit("None")))), " || ")


def key_of(normal: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(normal, 256), 1, length)


def row_key(normal: Column, questions: Column) -> Column:
    """The whole digest of a state with its questions: rows that ask other things of one state differ."""
    return F.sha2(F.concat(normal, F.lit("###"), questions), 256)


def tokens(text: Column) -> Column:
    """Distinct words of letters and digits of more than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) > 2))


def leak_patterns(variant: str = "wide") -> dict[str, str]:
    letters, gap = LEAK_VARIANTS[variant]
    return {name: p.replace("{letters}", letters).replace("{gap}", gap) for name, p in LEAK_PATTERNS.items()}


def leaks(text: Column, variant: str = "wide") -> Column:
    """Names of the patterns found."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in leak_patterns(variant).items())), lambda x: x.isNotNull())


def has_leak(text: Column, variant: str = "wide", low: Column | None = None) -> Column:
    """One alternation, so one pass of the matcher, and only over texts that hold a word which every pattern asks for one of.
    low: the text in lower case where there is a column of it; inside a condition the expression would be worked out for every word."""
    low = F.lower(text) if low is None else low
    cue = functools.reduce(lambda a, b: a | b, (low.contains(w) for w in LEAK_CUES))
    return F.when(cue, text.rlike("|".join(f"(?:{p})" for p in leak_patterns(variant).values()))).otherwise(False)


def forbidden_key(state: Column) -> Column:
    return F.coalesce(F.exists(F.json_object_keys(state), lambda k: k.rlike(FORBIDDEN_KEYS)), F.lit(False))


def language(tag: Column) -> Column:
    """Lower case, without region and script, two letters where the list has them; '?' and '' are null."""
    short = F.regexp_extract(F.lower(F.trim(tag)), r"^([^-_]*)", 1)
    names = F.create_map(*(F.lit(x) for pair in ISO3.items() for x in pair))
    return F.when(short.isin("", "?"), None).otherwise(F.coalesce(F.element_at(names, short), short))


def rendered(name: Column, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(": "), text))


def flattened(text: Column) -> Column:
    """A JSON list or object as its values joined by spaces; any other text as it is."""
    listed = F.array_join(F.from_json(text, "array<string>"), " ")
    fields = F.array_join(F.map_values(F.from_json(text, "map<string,string>")), " ")
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json(text)), F.lit(""))
    return F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), fields).otherwise(text)


def number_in(name: Column, before: str = "shard_") -> Column:
    """The number after a prefix in a name; null without one."""
    return F.regexp_extract(name, f"{before}([0-9]+)", 1).try_cast("long")


def human_bytes(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that is below them, cut to two decimals."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", F.floor(n * 100 / 1024**power) / 100)).otherwise(out)
    return out


def human_count(n: Column) -> Column:
    """Counts in thousands, millions and billions, cut to two decimals."""
    out = n.cast("long").cast("string")
    for value, unit in ((10**3, "K"), (10**6, "M"), (10**9, "B")):
        out = F.when(n >= value, F.format_string(f"%.2f{unit}", F.floor(n * 100 / value) / 100)).otherwise(out)
    return out
