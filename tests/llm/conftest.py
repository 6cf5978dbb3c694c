import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, rank int, grp string, kept boolean, spans string, row string, h long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and clashing columns."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "river", "stone", "market", "winter", "Écho", "naïve"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = say(30_000)
    copy = say(80)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, long, "en", None), (5, long + " end", "en", None), (6, copy, "fr", "b"), (7, copy, "fr", "b"), (8, copy, "fr", "b"),
        (8, copy, "fr", "b"), (9, "one", "en", "b"), (10, say(40), None, None), (None, say(30), "en", "a"), (11, "12345 !!", "en", "a"), (12, "mail x.y@host.org, +1 (555) 123-4567, 10.0.0.1", "en", "a"),
    ]
    return spark.createDataFrame([(*r, 0, 1, 2, 3, "g", True, "s", "r", 4) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
