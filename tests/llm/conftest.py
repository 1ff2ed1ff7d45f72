import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


def sentence(rng, n=80):
    return " ".join(rng.choice(["the", "of", "alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "tree"]) + rng.choice(["", "", "s", "ing", str(rng.randrange(50))]) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def texts():
    """Clean texts, exact and near copies, blank, null, empty, very long and repeated rows; no-break spaces and non-ASCII."""
    rng = random.Random(5)
    rows = [(k, sentence(rng, 60 + k)) for k in range(30)]
    base = rows[3][1]
    rows += [(100 + k, base) for k in range(12)]
    words = base.split()
    rows += [(200 + k, " ".join([*words, f"tail{k}"])) for k in range(12)]
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "one"), (304, "One two"), (305, "one two"), (306, "It's  50% über naïve　x's\r\n\n  end  "), (307, "x" * 5000), (308, sentence(rng, 30_000))]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with extra columns, some named as outputs of operators are."""
    rows = [(i, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), 0.5, "no") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
