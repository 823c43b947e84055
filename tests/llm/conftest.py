import random

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A function from (doc_id, text[, lang[, source]]) rows to a table like `documents`."""
    def build(rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] else 0) for r in rows]
        return spark.createDataFrame(full, T.StructType.fromDDL(DOCS))

    return build


@pytest.fixture
def prose():
    """Deterministic invented prose: prose(seed, n_words)."""
    def write(seed, n):
        dice = random.Random(seed)
        return " ".join("".join(dice.choice(["th", "er", "on", "an", "re", "in", "st", "ou", "le", "ba"]) for _ in range(dice.randint(1, 4)))
                        for _ in range(n))

    return write


@pytest.fixture
def edge_rows(prose):
    """NULLs, empty, blank and very long texts, ties and repeated rows."""
    long = prose("long", 30_000)
    return [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (4, "a b c"), (5, "A  b\nc"), (6, long), (7, long), (None, "no id"), (8, "123 !!! ###"),
            (9, "déjà vu\x0b日本語 🙂 <|endoftext|> end")]
