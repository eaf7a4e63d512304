import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "And", "of", "reading", "ñandú", "über", "a", "stone,", "river.", "Cloud", "x1", "日本"]


def corpus(n=80, seed=0):
    """Documents with every awkward case: nulls, empty and long texts, ties, repeats, near copies, unusual white space."""
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(rng.randrange(5, 80))]
        text = " ".join(words).replace(" x1", "\nx1")
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    rows += [
        (100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\n ", "en", "s1", 4), (103, long, "en", "s0", len(long)),
        (104, rows[3][1], "en", "s0", 5), (105, rows[3][1], "en", "s2", 5), (105, rows[3][1], "en", "s2", 5), (106, "one", "en", "s4", 3),
        (None, "no id at all", "en", "s0", 12), (107, rows[7][1] + " tail", "en", "s0", 5), (108, "double  space\x0b and\u00a0odd\r\nlines \n\n end ", "en", "s1", 5),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def nulls(spark):
    return spark.createDataFrame([(None,) * 5] * 3, KIND)
