import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, _id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties and extra columns."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "ünï", "x9"]
    line = " ".join(rng.choice(words) + str(i) for i in range(60))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, "the alpha of the beta and so on", "en", "a", 5),
        (3, "!!! 123 ...", None, "a", 1), (4, line, "en", None, 9), (5, line, "en", "b", 9), (5, line, "en", "b", 9),
        (6, "head line\n" + line + "\ntail of it", "de", "b", 9), (7, "word", "en", "c", 4), (8, "word", None, "c", 4),
        (9, " ".join(rng.choice(words) for _ in range(30_000)), "en", "c", 1), (10, "der die das und " * 40, "de", "c", 1),
        (11, "日本語のテキスト", None, "d", 8), (12, "a" * 50_000, "en", "d", 1),
    ]
    return spark.createDataFrame([(*r, "s", "t", "u") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
