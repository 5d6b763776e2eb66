import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use for columns of their own
CLASHING = {"_key": "'k'", "row": "1", "size": "2", "fp": "3", "_at": "4", "mark": "5", "times": "6", "found": "7", "keys": "8", "shard": "9", "held_out": "10"}


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents from rows (doc_id, text, lang, source), by default with columns of clashing names."""

    def make(rows, clashing=True):
        df = spark.createDataFrame([(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows], SCHEMA)
        return df.withColumns({k: F.expr(v) for k, v in CLASHING.items()}) if clashing else df

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls everywhere, empty and blank texts, ties, repeated rows, a very long text, other scripts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "the", "er", "on", "ti", "ou"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    long, base = text(60_000), text(80)
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n ", None, None),
        (4, base, "en", "a"),
        (5, base.replace(" ", "  \n", 3), "fr", "b"),
        (6, base, "en", None),
        (6, base, "en", None),
        (None, base, None, "b"),
        (None, "nur hier", "de", "b"),
        (7, base + " anon", "en", "c"),
        (8, long, "en", "a"),
        (9, long + " ti", "en", "b"),
        (10, "x" * 50_000, "fr", "c"),
        (11, "123 456 !!", "en", "a"),
        (12, "Привет мир", "ru", "a"),
        (13, "the Über ▁ \U0001f600 \u3000end\x0bof\x1cline", "en", "é"),
        (14, text(2), None, "a"),
        (14, text(3), None, "a"),
        *[(20 + i, text(rng.randint(0, 40)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "ω", None])) for i in range(40)],
    ]
