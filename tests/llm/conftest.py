import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, maybe string, h int, sig string, label string, v long, _id string, a int, epoch string, mark string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["the", "an", "re", "on", "ti", "es", "or", "ing"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, near copies, and extra columns with names used inside."""
    near = prose(5, 200)
    texts = [None, "", " ", "one", "one two three four", prose(1, 60), prose(1, 60), prose(1, 60).replace(" ", " \n", 3), near, near + " more", "x " + near, near.upper(), prose(7, 40_000), "mail a@b.co +1 (201) 555-0123 10.0.0.1 4111 1111 1111 1111", "Ünïcødé " * 30, "cut<|endoftext|> here"]
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[8], (None, "lost id " + prose(9, 30), "de", "odd", 3), (None, prose(1, 60), "de", "src1", 3)]
    return spark.createDataFrame([(*r, "x", 1, "s", "l", 5, "i", 2, "e", "m") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


