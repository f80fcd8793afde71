import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, key string, n string"
WORDS = ["alpha", "Beta", "gamma", "Délta", "eps", "zeta!", "éta", "theta,", "iota.", "kappa", "1", "22"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 9) if r.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows; near copies and passages."""
    base, passage = prose(1, 300), "\n" + prose(2, 60) + "\n"
    near = base.split(" ")
    near[150] = "changed"
    texts = [
        (1, base), (2, base.upper()), (3, " ".join(near)), (4, ""), (5, None), (6, " \n\t "), (7, "one two"), (7, "one two"), (7, "ONE two"),
        (None, prose(3, 80)), (8, prose(4, 40) + passage + prose(5, 90)), (9, prose(6, 70) + passage + prose(7, 30)), (10, "x " * 3000), (11, prose(8, 20_000)),
        (12, "a@b.com 10.0.0.1; 4111 1111 1111 1111; +1 (555) 123-4567"), (13, "日本語 テキスト 🙂 ΣΑΣ ﬁ é"), (14, "<|endoftext|> it's <|startoftext|>"),
        *[(100 + i, f"Shared line of the host number {i % 3}.\n" + prose(100 + i, 70)) for i in range(40)],
        *[(200 + i, base + f" tail{i}") for i in range(12)], *[(300 + i, "same text in many rows") for i in range(9)],
    ]
    out = []
    for i, (doc, text) in enumerate(texts):
        lang = [None, "en", "fr"][i % 3]
        source = None if i % 11 == 0 else f"s{i % 2}"
        out.append((doc, text, lang, source, None if i % 5 == 0 else len(text or ""), "clash", None, "x"))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
