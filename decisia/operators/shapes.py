"""Shape adapters: source rows to candidates (guid, workflow, kind, instructions, state, options, label, p).

An adapter is a function of a frame and keyword columns; it is pure, row by row, and drops the rows that its shape rejects.
state is a map of strings; options the choices or levels; label the place of the gold one; p the share of true for noul.
Register further ones in ADAPTERS by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisia.functions.text import PLACEHOLDERS, clean, flattened

LETTERS = "ABCDEFGHIJKLMNOP"
ADAPTERS: dict[str, Callable[..., DataFrame]] = {}

# Names and instructions used where a source gives none.
NLI_NAMES = ("entailment", "neutral", "contradiction")
NOUL_CRITERIA = ("No — the property is absent.", "Yes — the property is present.")
NLI_LOCAL = {
    "ko": ("함의", "중립", "모순"),
    "ja": ("含意", "中立", "矛盾"),
    "zh": ("蕴含", "中立", "矛盾"),
}
# Names of the 28 emotions of the binary emotion query.
EMOTIONS = (
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion", "curiosity", "desire", "disappointment",
    "disapproval", "disgust", "embarrassment", "excitement", "fear", "gratitude", "grief", "joy", "love", "nervousness",
    "optimism", "pride", "realization", "relief", "remorse", "sadness", "surprise", "neutral",
)


# Sentiment names in the language of the reviews.
SENTIMENT_LOCAL = {"positive": "ポジティブ", "negative": "ネガティブ", "neutral": "中立"}


def adapter(name: str):
    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ADAPTERS[name] = fn
        return fn

    return register


def texts(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def state_of(language: Column, **fields: Column) -> Column:
    pairs = [x for name, value in fields.items() for x in (F.lit(name), value)]
    return F.create_map(F.lit("language"), F.coalesce(language, F.lit("en")), *pairs)


def candidates(df: DataFrame, guid: Column, workflow: Column, kind: str, instructions: str | Column, state: Column, options: Column, label: Column, p: Column | None = None, ok: Column | None = None) -> DataFrame:
    if "_more" in df.columns:  # state fields that the source's entry adds
        state = F.map_concat(state, F.col("_more"))
    made = df.select(
        guid.cast("string").alias("guid"),
        workflow.alias("workflow"),
        F.lit(kind).alias("kind", metadata={"kind": kind}),
        (F.lit(instructions) if isinstance(instructions, str) else instructions).alias("instructions"),
        state.alias("state"),
        options.alias("options"),
        label.cast("int").alias("label"),
        (p if p is not None else F.lit(None)).cast("double").alias("p"),
        (ok if ok is not None else F.lit(True)).alias("_ok"),
    )
    within = F.lit(True) if kind == "noul" else F.col("label").between(0, F.size("options") - 1)
    return made.where(F.coalesce(F.col("_ok") & within, F.lit(False))).drop("_ok")


@adapter("nli")
def nli(df, guid, workflow, language, premise, hypothesis, label, names=NLI_NAMES, instructions="What is the relation?"):
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, premise=clean(premise), hypothesis=clean(hypothesis)), texts(names), label)


@adapter("nli_local")
def nli_local(df, guid, workflow, language, premise, hypothesis, label, names=None, fields=("premise", "hypothesis"), instructions="What is the relation?"):
    """Option names in the row's language where the list has it. names: their order in the source, shown as 'local(name)'; fields: how the source calls the two texts."""
    local = F.create_map(*(x for lang, own in NLI_LOCAL.items() for x in (F.lit(lang), texts(own))))
    ok = (clean(premise) != "") & (clean(hypothesis) != "")
    if names is None:
        options = F.coalesce(F.element_at(local, language), texts(NLI_NAMES))
    else:
        shown = lambda n: F.coalesce(F.try_element_at(F.element_at(local, language), F.array_position(texts(NLI_NAMES), n).cast("int")), n)
        options = F.transform(texts(names), lambda n: F.concat(shown(n), F.lit("("), n, F.lit(")")))
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, **dict(zip(fields, (clean(premise), clean(hypothesis)), strict=True))), options, label, ok=ok)


def label_place(raw: Column, names: Column) -> Column:
    """An integer, a digit string, or a name in any case."""
    by_name = F.array_position(F.transform(names, lambda n: F.lower(F.trim(n))), F.lower(F.trim(raw.cast("string")))) - 1
    return F.when(raw.cast("string").rlike("^-*[0-9]+$"), raw.cast("string").try_cast("int")).otherwise(by_name)


@adapter("label_int")
def label_int(df, guid, workflow, language, text, label, names, json_text=False, instructions="Which label fits?"):
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, text=clean(flattened(text) if json_text else text)), texts(names), label_place(label, texts(names)))


@adapter("label_str")
def label_str(df, guid, workflow, language, text, label, names, instructions="Which label fits?"):
    place = F.array_position(names if isinstance(names, Column) else texts(names), label.cast("string")) - 1
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, text=clean(text)), names if isinstance(names, Column) else texts(names), place)


def answer_place(answer: Column, options: Column) -> Column:
    """A letter, a number from one, or the option's own text, in this order."""
    a = F.trim(answer.cast("string"))
    letter = F.instr(F.lit(LETTERS), F.upper(a)) - 1
    return F.when((F.length(a) == 1) & (F.instr(F.lit(LETTERS), F.upper(a)) > 0), letter).when(a.rlike("^[0-9]+$"), a.try_cast("int") - 1).otherwise(F.array_position(options, a) - 1)


@adapter("choices_list")
def choices_list(df, guid, workflow, language, question, options, answer, integer=False, instructions="Which option is the correct answer?"):
    made = F.transform(options, clean)
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, question=clean(question)), made, answer if integer else answer_place(answer, made))


@adapter("dict_choices")
def dict_choices(df, guid, workflow, language, question, choices, answer, instructions="Which option is the correct answer?"):
    """choices: a map; options in the order of its keys, the answer a key."""
    keys = F.array_sort(F.map_keys(choices))
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, question=clean(question)), F.transform(keys, lambda k: clean(F.element_at(choices, k))), F.array_position(keys, F.trim(answer)) - 1)


@adapter("copa")
def copa(df, guid, workflow, language, premise, first, second, label, question=None, instructions="Which alternative fits?"):
    fields = {"premise": clean(premise)} | ({"question": clean(question)} if question is not None else {})
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, **fields), F.array(clean(first), clean(second)), label)


@adapter("story_cloze")
def story_cloze(df, guid, workflow, language, sentences, first, second, answer, instructions="Which sentence is the correct ending of the story?"):
    options = F.array(clean(first), clean(second))
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, story=F.concat_ws(" ", *(clean(s) for s in sentences))), options, answer.try_cast("int") - 1, ok=~F.array_contains(options, ""))


@adapter("pair_binary")
def pair_binary(df, guid, workflow, language, first, second, label, names=("no", "yes"), fields=("text", "text_2"), instructions="Do the texts match?"):
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, **dict(zip(fields, (clean(first), clean(second)), strict=True))), texts(names), label)


@adapter("abc_columns")
def abc_columns(df, guid, workflow, language, question, options, answer, from_one=False, instructions="Which option is the correct answer?"):
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, question=clean(question)), F.array(*(clean(o) for o in options)), answer - 1 if from_one else answer)


@adapter("placeholder_options")
def placeholder_options(df, guid, workflow, language, question, options, answer, instructions="Which option is the correct answer?"):
    """Empty and placeholder options go; the answer's place is counted again."""
    kept = F.filter(F.transform(options, clean), lambda o: (o != "") & ~F.lower(o).isin(*PLACEHOLDERS))
    gold = clean(F.try_element_at(options, answer.cast("int") + 1))
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, question=clean(question)), kept, F.array_position(kept, gold) - 1)


@adapter("ordinal")
def ordinal(df, guid, workflow, language, text, level, levels, instructions="Which level fits?"):
    return candidates(df, guid, workflow, "score", instructions, state_of(language, text=clean(text)), texts(levels), level)


@adapter("soft_binary")
def soft_binary(df, guid, workflow, language, text, score, scale=None, instructions="Does the property hold?"):
    v = score.cast("double")
    if scale:
        v = (v - scale[0]) / (scale[1] - scale[0])
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return candidates(df, guid, workflow, "noul", instructions, state_of(language, text=clean(text)), texts(NOUL_CRITERIA), F.lit(None), p, ok=v.isNotNull())


@adapter("blank_sentence")
def blank_sentence(df, guid, workflow, language, sentence, first, second, answer, instructions="Which option fills the blank?"):
    """Two options that must differ; the answer counts from one; jp is ja."""
    lang = F.when(language == "jp", "ja").otherwise(language)
    return candidates(df, guid, workflow, "choice", instructions, state_of(lang, sentence=clean(sentence)), F.array(clean(first), clean(second)), answer.try_cast("int") - 1, ok=clean(first) != clean(second))


@adapter("cause_effect")
def cause_effect(df, guid, workflow, language, premise, question, first, second, label):
    says = F.when(question == "cause", "Which alternative is the cause?").when(question == "effect", "Which alternative is the effect?").otherwise("Which alternative fits?")
    return candidates(df, guid, workflow, "choice", says, state_of(language, premise=clean(premise)), F.array(clean(first), clean(second)), label)


@adapter("parallel_questions")
def parallel_questions(df, guid, workflow, language, text, questions, choices, answers, most_chars=3000, instructions="Which option is the correct answer?"):
    """Parallel arrays of questions, option lists and answers: the question of most options, the first of equals; two to four options."""
    sizes = F.transform(choices, F.size)
    at = F.array_position(sizes, F.array_max(sizes)).cast("int")
    options = F.filter(F.transform(F.element_at(choices, at), clean), lambda o: o != "")
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, text=F.substring(clean(text), 1, most_chars), question=clean(F.element_at(questions, at))), options, F.array_position(options, clean(F.element_at(answers, at))) - 1, ok=F.size(options).between(2, 4))


@adapter("lettered_options")
def lettered_options(df, guid, workflow, language, question, options, answer, instructions="Which option is the correct answer?"):
    """Options in one string, 'a ) x , b ) y'."""
    parts = F.split(options, r"\s*,\s*(?=[a-eA-E]\s*\))")
    made = F.transform(parts, lambda p: clean(F.regexp_replace(p, r"^\s*[a-eA-E]\s*\)\s*", "")))
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, question=clean(question)), made, F.instr(F.lit("abcde"), F.lower(F.trim(answer))) - 1)


@adapter("code_names")
def code_names(df, guid, workflow, language, text, code, names: dict[str, str], instructions="Which label fits?"):
    """Codes to readable names; a list whose names collide is refused."""
    if len(set(names.values())) != len(names):
        return candidates(df, guid, workflow, "choice", instructions, state_of(language, text=clean(text)), texts(()), F.lit(-1), ok=F.lit(False))
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, text=clean(text)), texts(list(names.values())), F.array_position(texts(list(names)), code.cast("string")) - 1)


@adapter("emotion_query")
def emotion_query(df, guid, workflow, text, labels):
    """Several labels a row to one yes-or-no query, drawn by the checksum of the text: a label of the row at 0.85, or one that it lacks at 0.15."""
    t = clean(text)
    h = F.crc32(t)
    own = F.array_sort(F.array_distinct(labels))
    pool = F.when(h % 2 == 0, own).otherwise(F.array_except(F.sequence(F.lit(0), F.lit(len(EMOTIONS) - 1)), own))
    name = F.try_element_at(texts(EMOTIONS), F.try_element_at(pool, (F.pmod(F.floor(h / 2), F.greatest(F.size(pool), F.lit(1))) + 1).cast("int")) + 1)
    p = F.when(h % 2 == 0, 0.85).otherwise(0.15)
    says = F.format_string("Does the comment express the emotion '%s'? Answer with P(true).", name)
    options = F.array(F.format_string("The comment does not express %s.", name), F.format_string("The comment expresses %s.", name))
    return candidates(df, guid, workflow, "noul", says, state_of(F.lit("en"), text=t, emotion=name), options, F.lit(None), p, ok=(t != "") & (F.size(own) > 0) & name.isNotNull())


@adapter("sentiment_local")
def sentiment_local(df, guid, workflow, language, text, label, names=("positive", "negative"), instructions="このレビューの感情はどちらですか?"):
    """Sentiment names in the reviews' language, others as they are."""
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, text=clean(text)), texts([SENTIMENT_LOCAL.get(n, n) for n in names]), label, ok=clean(text) != "")


@adapter("span_pronoun")
def span_pronoun(df, guid, workflow, language, text, first, second, label, says="文中的「%s」指的是「%s」吗?", names=("否", "是")):
    """Whether one span of a text stands for another: both are named in the instructions and in the state."""
    s1, s2 = clean(first), clean(second)
    ok = (s1 != "") & (s2 != "") & (clean(text) != "")
    return candidates(df, guid, workflow, "choice", F.format_string(says, s2, s1), state_of(language, text=clean(text), span1=s1, span2=s2), texts(names), label, ok=ok)


@adapter("soft_pair")
def soft_pair(df, guid, workflow, language, first, second, score, most=5.0, criteria=NOUL_CRITERIA, fields=("sentence1", "sentence2"), instructions="Do the two sentences have the same meaning? Answer with P(same)."):
    """Two texts and how alike they are, from nothing to most."""
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score.cast("double") / most))
    ok = (clean(first) != "") & (clean(second) != "") & v.isNotNull()
    return candidates(df, guid, workflow, "noul", instructions, state_of(language, **dict(zip(fields, (clean(first), clean(second)), strict=True))), texts(criteria), F.lit(None), v, ok=ok)


@adapter("fixed_fields")
def fixed_fields(df, guid, workflow, language, label, state, options, instructions, filled=False):
    """Any choice: named state fields, options that are names or columns; filled asks for no empty option."""
    made = F.array(*(clean(o) if isinstance(o, Column) else F.lit(o) for o in options)) if isinstance(options, (list, tuple)) else F.transform(options, clean)
    ok = ~F.array_contains(made, "") if filled else F.lit(True)
    return candidates(df, guid, workflow, "choice", instructions, state_of(language, **{k: clean(v) for k, v in state.items()}), made, label, ok=ok)


def suite(df: DataFrame, config: Column, branches: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Dispatch by configuration name: each branch adapts its own rows; rows of other configurations go."""
    out = None
    for name, branch in branches.items():
        made = branch(df.where(config == name))
        out = made if out is None else out.unionByName(made)
    return out and out.withColumn("kind", F.col("kind").alias("kind", metadata={}))  # of several kinds


Branch = Callable[..., DataFrame]


def _choice(says: str, options, *fields: str, label: str = "label", filled: bool = False) -> Branch:
    """fields are columns, or name=expression."""
    pairs = dict(f.split("=", 1) if "=" in f else (f, f) for f in fields)

    def branch(df: DataFrame, guid: Column, workflow: Column, language: Column) -> DataFrame:
        made = [F.expr(o[1:]) if o.startswith("=") else o for o in options] if isinstance(options, tuple) else F.expr(options)
        return fixed_fields(df, guid, workflow, language, F.expr(label), {k: F.expr(v) for k, v in pairs.items()}, made, says, filled)

    return branch


def _named(names: tuple[str, ...], says: str, *fields: str) -> Branch | None:
    """None where the names of a configuration aren't known: its rows go."""
    return _choice(says, names, *fields) if names else None


SPANS = "span1_text", "span2_text"
NLI_WORDS = "CASE lower(label) WHEN 'entailment' THEN 0 WHEN 'neutral' THEN 1 WHEN 'contradiction' THEN 2 END"


def suites(names: dict[str, tuple[str, ...]] | None = None) -> dict[str, dict[str, Branch | None]]:
    """Branches by suite and configuration; names: label names of configurations whose rows don't tell. A branch of None drops its rows."""
    names = names or {}
    of = lambda config: tuple(names.get(config, ()))
    inference = "가설과 전제의 관계는?"

    def similarity(df, guid, workflow, language):
        return soft_pair(df, guid, workflow, language, F.col("sentence1"), F.col("sentence2"), F.col("label"), criteria=("두 문장은 의미가 다르다.", "두 문장은 의미가 같다."), instructions="두 문장의 의미가 같은가? P(같다)로 답하라.")

    tweets: dict[str, Branch | None] = {"emoji": _named(of("emoji"), "Which emoji best matches the tweet?", "text"), "emotion": _named(of("emotion"), "Which emotion does the tweet express?", "text"), "sentiment": _named(of("sentiment"), "What is the sentiment of the tweet?", "text")}
    tweets |= {c: _named(of(c), f"Is the tweet {c}?", "text") for c in ("offensive", "hate", "irony")}
    for target in ("abortion", "atheism", "climate", "feminist", "hillary"):
        tweets[f"stance_{target}"] = _named(of(f"stance_{target}"), "What is the stance toward the target?", "text", f"target='{target}'")
    return {
        "klue": {
            "ynat": _named(of("ynat"), "기사의 주제 분류는 무엇인가?", "title"),
            "nli": _choice("두 문장의 논리적 관계는 무엇인가?", ("함의(entailment)", "중립(neutral)", "모순(contradiction)"), "premise", "hypothesis", label=NLI_WORDS),
            "sts": similarity,
        },
        "kobest": {
            "boolq": _choice("지문에 근거할 때 질문의 답은?", ("아니오", "예"), "paragraph", "question"),
            "copa": _choice("인과관계상 알맞은 대안은?", ("=alternative_1", "=alternative_2"), "premise", "question", filled=True),
            "sentineg": _choice("문장의 감정은?", ("부정", "긍정"), "text=sentence"),
            "hellaswag": _choice("이어질 가장 자연스러운 문장은?", "endings", "context"),
            "wic": _choice("두 문장에서 단어의 의미가 같은가?", ("다르다", "같다"), "sentence1", "sentence2", "word"),
        },
        "super_glue": {
            "boolq": _choice("지문에 근거해 질문에 답하라.", ("no", "yes"), "passage", "question"),
            "copa": _choice("알맞은 선택지는?", ("=choice1", "=choice2"), "premise", "question"),
            "rte": _choice(inference, ("entailment", "not_entailment"), "premise", "hypothesis"),
            "cb": _choice(inference, ("entailment", "contradiction", "neutral"), "premise", "hypothesis"),
            "axb": _choice(inference, ("entailment", "not_entailment"), "sentence1", "sentence2"),
            "axg": _choice(inference, ("entailment", "not_entailment"), "premise", "hypothesis"),
            "wic": _choice("두 문장에서 단어의 의미가 같은가?", ("different", "same"), "sentence1", "sentence2", "word"),
            "multirc": _choice("제시된 답이 지문에 근거해 맞는가?", ("false", "true"), "paragraph", "question", "answer"),
            "wsc.fixed": _choice("대명사가 가리키는 것은?", tuple(f"={x}" for x in SPANS), "text", "span1=span1_text", "span2=span2_text"),
            "record": None,
        },
        "tweet_eval": tweets,
    }


@adapter("suite")
def suite_row(df, guid, workflow, language, suite, config, names=None):
    """The rows of one configuration of a suite; a configuration without a branch gives none."""
    branch = suites(names).get(suite, {}).get(config)
    if branch is None:
        return candidates(df, guid, workflow, "choice", "", state_of(language), texts(()), F.lit(-1), ok=F.lit(False))
    return branch(df, guid, workflow, language)


@adapter("graded")
def graded(df, guid, workflow, language, first, second, score, levels, instructions="How alike are the texts?"):
    """A real score to the nearest level, halves to the even one, clamped to the list."""
    level = F.least(F.lit(len(levels) - 1), F.greatest(F.lit(0), F.bround(score.cast("double")).cast("int")))
    return candidates(df, guid, workflow, "score", instructions, state_of(language, text=clean(first), text_2=clean(second)), texts(levels), level, ok=score.isNotNull())


def soft_values(soft: Column, keys: Column) -> Column:
    """A soft label, JSON of a map or a list over keys, as values that sum to one in the order of keys; null where it doesn't fit or sums to zero."""
    fields, items = F.from_json(soft, "map<string,double>"), F.from_json(soft, "array<double>")
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json(soft)), F.lit(""))
    values = F.when(kind.startswith("OBJECT"), F.transform(keys, lambda k: F.coalesce(F.try_element_at(fields, k), F.lit(0.0)))).when(kind.startswith("ARRAY") & (F.size(items) == F.size(keys)), items)
    sums = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(sums > 0, F.transform(values, lambda v: v / sums))


def soft_truth(soft: Column, label: Column) -> Column:
    """The share of true from a boolean, a number or a map with true; 'None' and null leave the label's own."""
    text = F.lower(F.trim(soft))
    number = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(F.coalesce(text.try_cast("double"), F.try_element_at(F.from_json(soft, "map<string,double>"), F.lit("true"))))
    return F.coalesce(F.when(number.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))), F.when(F.lower(label).isin("true", "yes", "1"), 1.0).when(F.lower(label).isin("false", "no", "0"), 0.0))


def typed_corpus(df: DataFrame, most_options: int = 32, most_levels: int = 8, skip: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, source, primitive, state, instructions, options, label, soft_label) of a corpus that has the three types already.

    Gives guid, workflow, kind, instructions, state, options and probs: soft where soft_label reads as a distribution, else one-hot. Rows
    with too many options or levels, of skipped sources, or without a usable gold go.
    """
    rows = df.where(~F.col("source").isin(*skip)) if skip else df
    keys = F.when(F.col("primitive") == "score", F.transform(F.sequence(F.lit(0), F.size("options") - 1), lambda i: i.cast("string"))).otherwise(F.col("options"))
    at = F.when(F.col("primitive") == "score", F.coalesce(F.col("label").try_cast("int"), F.array_position("options", F.col("label")).cast("int") - 1)).otherwise(F.array_position("options", F.col("label")).cast("int") - 1)
    hot = F.when(at.between(0, F.size("options") - 1), F.transform(F.sequence(F.lit(0), F.size("options") - 1), lambda i: F.when(i == at, 1.0).otherwise(0.0)))
    truth = soft_truth(F.col("soft_label"), F.col("label"))
    probs = F.when(F.col("primitive") == "noul", F.when(truth.isNotNull(), F.array(1 - truth, truth))).otherwise(F.coalesce(soft_values(F.col("soft_label"), keys), hot))
    fits = F.when(F.col("primitive") == "choice", F.size("options").between(2, most_options)).when(F.col("primitive") == "score", F.size("options").between(2, most_levels)).otherwise(F.col("primitive") == "noul")
    made = rows.where(fits).select(F.col("id").cast("string").alias("guid"), F.col("source").alias("workflow"), F.col("primitive").alias("kind"), "instructions", "state", "options", probs.alias("probs"))
    return made.where("probs is not null")


def guid(name: str, config: Column, split: Column, number: Column) -> Column:
    return F.concat_ws("/", F.lit(name), config, split, number.cast("string"))


def workflow_of(template: str, config: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{config}"), config)
