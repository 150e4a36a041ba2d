import random

import pytest

WORDS = "the quick brown fox jumps over lazy dog while seven small birds sing loud songs near old river".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    text = []
    for k in range(n):
        word = r.choice(WORDS) + str(r.randrange(40))
        text.append(word.capitalize() + "." if k % 9 == 8 else word)
        if k % 25 == 24:
            text[-1] += "\n"
    return " ".join(text).replace("\n ", "\n")


LONG = prose(1, 6000)
#: Nulls in any column, empty and very long texts, ties, repeated rows, and columns with names that
#: operators use themselves.
ODD = [
    (1, prose(2, 120), "en", "a", 1, 0.5, "x", 7),
    (2, prose(2, 120), "en", "a", None, 0.5, None, 7),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, 1.0, "x", 1),
    (4, "", "en", "b", 0, 1.0, "x", 1),
    (5, LONG, "en", "b", 9, 0.0, "x", 1),
    (6, prose(3, 70), "de", None, 9, 0.0, "x", 1),
    (6, prose(3, 70), "de", None, 9, 0.0, "x", 1),
    (6, prose(4, 70), "de", "c", 9, 0.0, "x", 1),
    (None, prose(5, 60), "fr", "c", 9, 0.0, "x", 1),
    (None, prose(5, 60), "fr", "c", 9, 0.0, "x", 1),
    (7, "a b\n\n\t\n" + prose(3, 70) + "\ntoken = 'abcdef0123456789abcdef0123'", "fr", "d", 9, 0.0, "x", 1),
    (8, "one", "fr", "d", 9, 0.0, "x", 1),
    (-9, "éß ü 😀 " + prose(6, 30), "fr", "d", 9, 0.0, "x", 1),
]
ODD = [(*row, "x", None, 1) for row in ODD]
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, label string, size long, "
    "spans string, copies long, root long"
)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(ODD, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
