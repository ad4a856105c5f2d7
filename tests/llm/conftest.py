import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, note string"


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids, repeats, a long text, odd characters."""
    rng = random.Random(7)
    words = "alpha beta gamma delta Epsilon zeta eta theta iota kappa été naïve 中文 x1 #! |".split()
    rows = [(None, "no id here but some words"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "token = 'abcdefghijklmnop'")]
    for i in range(10, 60):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 90)))))
    rows += [(60 + i, rows[20][1]) for i in range(12)] + [(80, rows[30][1] + " tail"), (81, "long " * 30000), (82, "\x1c\x85\xa0 q\x00w é\n\n b")]
    return [(i, t, None if i is None or i % 5 == 0 else "en", None, None, "n") for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
