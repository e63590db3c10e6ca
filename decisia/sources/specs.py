"""The catalog of public sources: what to scan, how to shape it, how many rows to take of each slice.

All of it are fixed values: names, places on the public hub, columns, label names, instructions and budgets of the sources.
"""

from __future__ import annotations

from decisia.sources.files import SourceSpec

RELATION = "What is the logical relation between `premise` and `hypothesis`?"
RELATION_KO, RELATION_JA, RELATION_ZH = "두 문장의 논리적 관계는 무엇인가?", "二つの文の論理的な関係は何ですか?", "两句话之间的逻辑关系是什么?"
NLI = ("entailment", "neutral", "contradiction")
NLI_ZH = ("neutral", "entailment", "contradiction")
STARS = ("1 star", "2 stars", "3 stars", "4 stars", "5 stars")
POLARITY = ("negative", "positive")
PAIR = {"premise": "premise", "hypothesis": "hypothesis", "label": "label"}
SENTENCES = {"first": "sentence1", "second": "sentence2", "label": "label"}
DBPEDIA = ("company", "educational institution", "artist", "athlete", "office holder", "mean of transportation", "building", "natural place", "village", "animal", "plant", "album", "film", "written work")
YAHOO = ("Society & Culture", "Science & Mathematics", "Health", "Education & Reference", "Computers & Internet", "Sports", "Business & Finance", "Entertainment & Music", "Family & Relationships", "Politics & Government")
TNEWS = {
    "100": "新闻故事", "101": "文化", "102": "娱乐", "103": "体育", "104": "财经", "106": "房产", "107": "汽车", "108": "教育",
    "109": "科技", "110": "军事", "112": "旅游", "113": "国际", "114": "股票", "115": "农业", "116": "游戏",
}
MTOP_INTENTS = (
    "IN:GET_WEATHER", "IN:CREATE_CALL", "IN:CREATE_REMINDER", "IN:CREATE_ALARM", "IN:GET_STORIES_NEWS", "IN:SEND_MESSAGE", "IN:PLAY_MUSIC", "IN:GET_EVENT", "IN:GET_CONTACT", "IN:GET_INFO_RECIPES",
    "IN:GET_RECIPES", "IN:CREATE_TIMER", "IN:DELETE_REMINDER", "IN:GET_REMINDER", "IN:UPDATE_CALL", "IN:GET_AVAILABILITY", "IN:GET_TIMER", "IN:GET_MESSAGE", "IN:GET_LOCATION", "IN:END_CALL",
    "IN:QUESTION_NEWS", "IN:GET_ALARM", "IN:ADD_TIME_TIMER", "IN:GET_EMPLOYER", "IN:UPDATE_REMINDER_DATE_TIME", "IN:GET_INFO_CONTACT", "IN:SET_UNAVAILABLE", "IN:PAUSE_TIMER", "IN:GET_TRACK_INFO_MUSIC", "IN:SNOOZE_ALARM",
)
MTOP_DOMAINS = ("alarm", "calling", "event", "messaging", "music", "news", "people", "recipes", "reminder", "timer", "weather")
MTOP_LANGUAGE = "=coalesce(nullif(split(coalesce(lang, 'en_XX'), '_')[0], ''), 'en')"
XNLI = ("en", "fr", "es", "de", "el", "bg", "ru", "tr", "ar", "vi", "th", "zh", "hi", "sw", "ur")
WINOGRANDE = ("winogrande_xl", "winogrande_l", "winogrande_m", "winogrande_s", "winogrande_debiased")
SUPER_GLUE = ("boolq", "copa", "rte", "wic", "cb", "multirc", "record", "wsc.fixed", "axb", "axg")
TWEETS = ("emoji", "emotion", "offensive", "hate", "irony", "sentiment", "stance_abortion", "stance_atheism", "stance_climate", "stance_feminist", "stance_hillary")
SCENARIOS = (
    "af", "am", "ar", "az", "bn", "cy", "da", "de", "el", "en", "es", "fa", "fi", "fr", "he", "hi", "hu", "hy", "id", "is", "it", "ja", "jv", "ka", "km", "kn", "ko", "lv",
    "ml", "mn", "ms", "my", "nb", "nl", "pl", "pt", "ro", "ru", "sl", "sq", "sv", "sw", "ta", "te", "th", "tl", "tr", "ur", "vi", "zh-CN", "zh-TW",
)
PROX = ("af", "ar", "bn", "cs", "de", "es", "fr", "hi", "hu", "id", "it", "ja", "ko", "mr", "ne", "pt", "ru", "sr", "sw", "te", "th", "uk", "ur", "vi", "wo", "yo", "zh", "zu")
XCOPA = ("et", "ht", "id", "it", "qu", "sw", "ta", "th", "tr", "vi", "zh")
XSTORY = ("en", "ru", "zh", "es", "ar", "hi", "id", "te", "sw", "eu", "my")
PAWS = ("de", "en", "es", "fr", "ja", "ko", "zh")
XWINOGRAD = ("en", "fr", "jp", "pt", "ru", "zh")
REVIEWS = ("de", "en", "es", "fr", "ja", "zh")
#: Languages and origins of the multilingual inference set, whose splits are named by both.
INFERENCE = ("ar", "bn", "de", "es", "fa", "fr", "he", "hi", "id", "it", "ja", "ko", "mr", "nl", "pl", "ps", "pt", "ru", "sv", "sw", "ta", "tr", "uk", "ur", "vi", "zh")
ORIGINS = ("anli", "fever", "ling", "mnli", "wanli")


def source(name: str, path: str, workflow: str, shape: str, target: int, columns: dict | None = None, says: str = "", **more) -> SourceSpec:
    """says: the instructions; names, levels and the like go to the adapter."""
    own = {k: more.pop(k) for k in tuple(more) if k in SourceSpec.__dataclass_fields__}
    return SourceSpec(name, path, shape, workflow, columns=columns or {}, options=({"instructions": says} if says else {}) | more, target=target, **own)


def text_label(text: str, label: str = "label") -> dict[str, str]:
    return {"text": text, "label": label}


def question(options, answer: str, text: str = "question") -> dict:
    return {"question": text, "options": options, "answer": answer}


CATALOG = (
    source("massive", "mteb/amazon_massive_intent", "massive-intent", "label_str", 11000, text_label("text"), "Which intent does the user's utterance express?", configs="ALL", language="=lang", draw=(3, 5), bucket=True),
    source("xnli", "facebook/xnli", "xnli-multilingual", "nli", 25000, PAIR, RELATION, configs=XNLI, language="config"),
    source("snli", "stanfordnlp/snli", "snli-nli", "nli", 30000, PAIR, RELATION),
    source("mnli", "nyu-mll/multi_nli", "mnli-nli", "nli", 30000, PAIR, RELATION),
    source("anli", "facebook/anli", "anli-nli", "nli", 50000, PAIR, RELATION, splits=("train_r1", "train_r2", "train_r3")),
    source("vitaminc", "tals/vitaminc", "vitaminc-factcheck", "label_int", 40000, text_label("claim"), "Does `evidence` support, refute, or fail to establish `claim`?", names=("supports", "refutes", "not enough info"), fields={"text_2": "json:evidence"}),
    source("race", "ehovy/race", "race-reading", "choices_list", 80000, question("options", "answer"), configs=("all",), fields={"text": "article"}),
    source("qasc", "allenai/qasc", "qasc-science", "dict_choices", 8000, {"question": "question", "choices": "map_from_arrays(choices.label, choices.text)", "answer": "answerKey"}, fields={"text": "fact1", "text_2": "fact2"}),
    source("aqua_rat", "deepmind/aqua_rat", "aqua-rat", "choices_list", 90000, question("options", "correct")),
    source("winogrande", "allenai/winogrande", "winogrande-coref", "choices_list", 8000, question("array(option1, option2)", "answer", "sentence"), configs=WINOGRANDE),
    source("mmlu_pro", "TIGER-Lab/MMLU-Pro", "mmlu-pro-choice", "choices_list", 12000, question("options", "answer_index"), integer=True, splits=("test",), fields={"text": "category"}),
    source("super_glue", "aps/super_glue", "superglue-{config}", "suite", 9000, suite="super_glue", configs=SUPER_GLUE),
    source("amazon_polarity", "fancyzhx/amazon_polarity", "amazon-polarity", "label_int", 60000, text_label("title"), "Is the review positive or negative?", names=POLARITY, fields={"text_2": "content"}, take="shuffle"),
    source("yelp_polarity", "fancyzhx/yelp_polarity", "yelp-polarity", "label_int", 40000, text_label("text"), "Is the review positive or negative?", names=POLARITY, take="shuffle"),
    source("dbpedia_14", "fancyzhx/dbpedia_14", "dbpedia-topic", "label_int", 60000, text_label("title"), "Which topic does the document belong to?", names=DBPEDIA, fields={"text_2": "content"}, draw=(3, 5), bucket=True, take="shuffle"),
    source("ag_news", "fancyzhx/ag_news", "agnews-topic", "label_int", 30000, text_label("text"), "Which news category does the article belong to?", names=("world", "sports", "business", "sci/tech"), take="shuffle"),
    source("civil_comments", "google/civil_comments", "civil-comments-toxicity", "soft_binary", 80000, {"text": "text", "score": "toxicity"}, "Is this comment toxic? Answer with P(toxic).", take="shuffle"),
    source("measuring_hate", "ucberkeley-dlab/measuring-hate-speech", "measuring-hate-speech", "soft_binary", 60000, {"text": "text", "score": "hate_speech_score"}, "Does this comment express hate speech? Answer with P(hate speech).", scale=(-2.0, 2.0), take="shuffle"),
    source("tweet_eval", "cardiffnlp/tweet_eval", "tweet-{config}", "suite", 8000, suite="tweet_eval", configs=TWEETS),
    source("emotion", "dair-ai/emotion", "emotion-6", "label_int", 16000, text_label("text"), "Which emotion does the text express?", names=("sadness", "joy", "love", "anger", "fear", "surprise")),
    source("sst5", "SetFit/sst5", "sst5-ordinal", "ordinal", 8544, {"text": "text", "level": "label"}, "How positive is the sentiment of the text?", levels=("very negative", "negative", "neutral", "positive", "very positive")),
    source("korean_extra", "klue/klue", "korean-{config}", "suite", 30000, suite="klue", configs=("nli", "sts", "ynat"), language="ko"),
    source("kobest", "skt/kobest_v1", "kobest-{config}", "suite", 9000, suite="kobest", configs=("boolq", "copa", "hellaswag", "sentineg", "wic"), language="ko"),
    source("belebele", "facebook/belebele", "belebele-reading", "choices_list", 900, question("array(mc_answer1, mc_answer2, mc_answer3, mc_answer4)", "correct_answer_num"), "Read `flores_passage`, then choose the correct answer to `question`.", configs="ALL", splits=("test",), language="config", fields={"text": "flores_passage"}),
    source("sib200", "Davlan/sib200", "sib200-topic", "label_str", 1000, text_label("text", "category"), "Which topic does the text belong to?", configs="ALL", splits=("train", "validation", "test"), language="config", draw=(3, 5)),
    source("global_mmlu", "CohereForAI/Global-MMLU", "global-mmlu-{config}", "choices_list", 3500, question("array(option_a, option_b, option_c, option_d)", "answer"), "Choose the correct answer to the question.", configs="ALL", splits=("test",), language="config", fields={"text": "subject"}),
    source("massive_scenario", "mteb/amazon_massive_scenario", "massive-scenario", "label_str", 1800, text_label("text"), "Which virtual-assistant scenario does the user's utterance belong to?", configs=SCENARIOS, language="=lang", draw=(4, 5)),
    source("mmlu_prox", "li-lab/MMLU-ProX", "mmlu-prox-{config}", "placeholder_options", 2500, question("array(" + ", ".join(f"option_{i}" for i in range(10)) + ")", "answer_index"), "Which option is the correct answer to the question?", configs=PROX, splits=("test",), language="config", fields={"category": "category"}, draw=(4, 5)),
    source("include_lite_44", "CohereLabs/include-lite-44", "include-44", "choices_list", 250, question("choices", "answer"), "Which option is the correct answer to the question?", integer=True, configs="ALL", splits=("test",), language="config", fields={"text": "subject"}),
    source("afrisenti", "masakhane/afrisenti", "afrisenti", "label_str", 2500, text_label("tweet"), "What is the sentiment of the tweet?", configs="ALL", language="config"),
    source("masakhanews", "masakhane/masakhanews", "masakhanews", "label_str", 1500, text_label("text", "category"), "Which news category does the article belong to?", configs="ALL", splits=("train", "validation"), language="config", fields={"headline": "headline"}, draw=(4, 5)),
    source("xcopa", "cambridgeltl/xcopa", "xcopa", "cause_effect", 600, {"premise": "premise", "question": "question", "first": "choice1", "second": "choice2", "label": "label"}, configs=XCOPA, splits=("validation", "test"), language="config", fields={"relation": "CASE WHEN lower(question) IN ('cause', 'effect') THEN lower(question) ELSE 'unknown' END"}),
    source("xstory_cloze", "juletxara/xstory_cloze", "xstory-cloze", "story_cloze", 2000, {"sentences": ("input_sentence_1", "input_sentence_2", "input_sentence_3", "input_sentence_4"), "first": "sentence_quiz1", "second": "sentence_quiz2", "answer": "answer_right_ending"}, "Which sentence is the correct ending of the story?", configs=XSTORY, splits=("train", "eval"), language="config"),
    source("paws_x", "google-research-datasets/paws-x", "paws-x", "pair_binary", 8000, SENTENCES, "Are `sentence1` and `sentence2` paraphrases of each other?", names=("not paraphrase", "paraphrase"), configs=PAWS, language="config", take="shuffle"),
    *(source(f"amazon_reviews_{x}", f"SetFit/amazon_reviews_multi_{x}", "amazon-reviews-multi", "ordinal", 12000, {"text": "text", "level": "label"}, "How many stars did the reviewer give?", levels=STARS, language=x, take="shuffle") for x in REVIEWS),
    source("xwinograd", "Muennighoff/xwinograd", "xwinograd", "blank_sentence", 2400, {"sentence": "sentence", "first": "option1", "second": "option2", "answer": "answer"}, "Which noun phrase does the blank `_` in the sentence refer to?", configs=XWINOGRAD, splits=("test",), language="config"),
    *(source(f"mlnli_{x}", "MoritzLaurer/multilingual-NLI-26lang-2mil7", "multilingual-nli", "nli", 250, PAIR, RELATION, splits=tuple(f"{x}_{o}" for o in ORIGINS), language=x, take="shuffle") for x in INFERENCE),
    source("kmmlu", "HAERAE-HUB/KMMLU", "kmmlu-{config}", "abc_columns", 700, {"question": "question", "options": ("A", "B", "C", "D"), "answer": "answer"}, "다음 문제의 알맞은 답을 고르시오.", from_one=True, configs="ALL", language="ko", fields={"subject": "Category"}),
    source("nsmc", "Blpeng/nsmc", "nsmc-sentiment", "label_int", 30000, text_label("document"), "이 영화 리뷰의 감정은 긍정인가 부정인가?", names=("부정", "긍정"), language="ko"),
    source("kor_nli_snli", "kakaobrain/kor_nli", "kornli-snli-ko", "nli_local", 20000, PAIR, RELATION_KO, names=NLI, configs=("snli",), language="ko", take="shuffle"),
    source("kor_nli_mnli", "kakaobrain/kor_nli", "kornli-mnli-ko", "nli_local", 20000, PAIR, RELATION_KO, names=NLI, configs=("multi_nli",), language="ko", take="shuffle"),
    source("jnli", "zenless-lab/jnli", "jnli-ja", "nli_local", 15000, PAIR, RELATION_JA, names=NLI, configs=("default",), language="ja"),
    source("marc_ja", "yangwang825/marc-ja", "marc-ja-sentiment", "sentiment_local", 20000, text_label("text"), language="ja"),
    source("jsts", "zenless-lab/jsts", "jsts-ja", "soft_pair", 12000, {"first": "sentence1", "second": "sentence2", "score": "label"}, "二つの文の意味は同じですか? P(同じ)で答えてください。", criteria=("二つの文は意味が異なる。", "二つの文は意味が同じである。"), language="ja"),
    source("clue_tnews", "clue/clue", "clue-tnews", "code_names", 20000, {"text": "sentence", "code": "label_desc"}, "这条新闻属于哪个类别?", names=TNEWS, configs=("tnews",), language="zh"),
    source("clue_ocnli", "clue/clue", "clue-ocnli", "nli_local", 20000, {"premise": "sentence1", "hypothesis": "sentence2", "label": "label"}, RELATION_ZH, names=NLI_ZH, pair=("sentence1", "sentence2"), configs=("ocnli",), language="zh"),
    source("clue_cmnli", "clue/clue", "clue-cmnli", "nli_local", 25000, {"premise": "sentence1", "hypothesis": "sentence2", "label": "label"}, RELATION_ZH, names=NLI_ZH, pair=("sentence1", "sentence2"), configs=("cmnli",), language="zh", take="shuffle"),
    source("clue_afqmc", "clue/clue", "clue-afqmc", "pair_binary", 15000, SENTENCES, "这两个句子表达的意思相同吗?", names=("意思不同", "意思相同"), pair=("sentence1", "sentence2"), configs=("afqmc",), language="zh"),
    source("clue_wsc", "clue/clue", "clue-wsc2020", "span_pronoun", 1200, {"text": "text", "first": "target.span1_text", "second": "target.span2_text", "label": "label"}, configs=("cluewsc2020",), language="zh"),
    source("c3", "dataset-org/c3", "c3-zh-reading", "parallel_questions", 3000, {"text": "array_join(documents, ' ')", "questions": "questions.question", "choices": "questions.choice", "answers": "questions.answer"}, "根据以上材料回答问题。", configs=("mixed",), language="zh"),
    source("logiqa2", "jeggers/logiqa2_formatted", "logiqa2-reasoning", "choices_list", 12000, question("options", "answer"), "Read the passage and pick the option that must be true.", integer=True, fields={"text": "text"}),
    source("math_qa", "tasksource/math_qa", "math-qa", "lettered_options", 25000, question("options", "correct", "Problem"), "Solve the math problem and pick the correct option."),
    source("social_i_qa", "tasksource/social_i_qa", "social-i-qa", "abc_columns", 25000, {"question": "question", "options": ("answerA", "answerB", "answerC"), "answer": "label"}, "Which answer is the most plausible for the question?", fields={"context": "context"}),
    source("cosmos_qa", "Samsoup/cosmos_qa", "cosmos-qa-commonsense", "choices_list", 20000, question("array(answer0, answer1, answer2, answer3)", "label"), "Pick the option that best answers the question about the context.", integer=True, fields={"text": "context"}),
    source("fever_nli", "pietrolesci/nli_fever", "fever-fact-verification", "nli_local", 30000, PAIR, RELATION, names=NLI, take="shuffle"),
    source("yahoo_topics", "community-datasets/yahoo_answers_topics", "yahoo-answers-topic", "label_int", 20000, text_label("question_title", "topic"), "Which topic does the question belong to?", names=YAHOO, configs=("yahoo_answers_topics",), fields={"text_2": "question_content"}, take="reservoir"),
    source("fin_phrasebank_atrost", "atrost/financial_phrasebank", "financial-phrasebank-sentiment", "label_int", 3000, text_label("sentence"), "What is the sentiment of the financial sentence?", names=("negative", "neutral", "positive")),
    source("fin_phrasebank_warwick", "warwickai/financial_phrasebank_mirror", "financial-phrasebank-sentiment-2", "label_int", 4800, text_label("sentence"), "What is the sentiment of the financial sentence?", names=("negative", "neutral", "positive")),
    source("go_emotions", "google-research-datasets/go_emotions", "go-emotions-binary", "emotion_query", 20000, {"text": "text", "labels": "labels"}, configs=("simplified",)),
    source("glue_mrpc", "nyu-mll/glue", "glue-mrpc", "pair_binary", 3600, SENTENCES, "Do the two sentences express the same meaning?", names=("not_equivalent", "equivalent"), configs=("mrpc",)),
    source("glue_qqp", "nyu-mll/glue", "glue-qqp", "pair_binary", 20000, {"first": "question1", "second": "question2", "label": "label"}, "Are the two questions duplicates of each other?", names=("not_duplicate", "duplicate"), configs=("qqp",), take="shuffle"),
    source("glue_sst2", "nyu-mll/glue", "glue-sst2", "label_int", 20000, text_label("sentence"), "Is the sentiment of the movie review positive or negative?", names=POLARITY, configs=("sst2",)),
    source("glue_cola", "nyu-mll/glue", "glue-cola", "label_int", 8000, text_label("sentence"), "Is the sentence grammatically acceptable?", names=("unacceptable", "acceptable"), configs=("cola",)),
    source("glue_qnli", "nyu-mll/glue", "glue-qnli", "pair_binary", 15000, {"first": "question", "second": "sentence", "label": "label"}, "Does the sentence contain the answer to the question?", names=("entailment", "not_entailment"), configs=("qnli",), take="shuffle"),
    source("glue_rte", "nyu-mll/glue", "glue-rte", "pair_binary", 2400, SENTENCES, "Does the first sentence entail the second one?", names=("entailment", "not_entailment"), configs=("rte",)),
    source("glue_wnli", "nyu-mll/glue", "glue-wnli", "pair_binary", 600, SENTENCES, "Does the first sentence entail the second one?", names=("not_entailment", "entailment"), configs=("wnli",)),
    source("glue_stsb", "nyu-mll/glue", "glue-stsb", "soft_pair", 5700, {"first": "sentence1", "second": "sentence2", "score": "label"}, criteria=("The two sentences have different meanings.", "The two sentences have the same meaning."), configs=("stsb",)),
    source("mtop_intent", "tasksource/mtop", "mtop-intent", "label_str", 20000, text_label("question", "intent"), "Which intent does the user's utterance express?", names=MTOP_INTENTS, language=MTOP_LANGUAGE, fields={"task": "'intent'"}, take="reservoir"),
    source("mtop_domain", "tasksource/mtop", "mtop-domain", "label_str", 20000, text_label("question", "domain"), "Which domain does the user's utterance belong to?", names=MTOP_DOMAINS, language=MTOP_LANGUAGE, fields={"task": "'domain'"}, take="reservoir"),
)


def catalog() -> list[SourceSpec]:
    return list(CATALOG)
