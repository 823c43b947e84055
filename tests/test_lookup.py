"""Hints: the compiled expression and the q-gram index agree with a plain search."""

import pytest

from ledgerloom.operators.lookup import first_hint

TEXTS = ["The Blue Fig", "figs and FIGURES", "nothing", "", "İstanbul fig", "a\nblue\nfig", "aaaaaaaaaab",
         "xx a long beginning two", "a long beginning"]
HINTS = [(3, "FIG", "Figs"), (1, "blue fig", "Blue Fig"), (2, "figure", "Figures"), (4, "\nblue", "Line"), (5, "aaab", "As"),
         (6, "thing", "Thing"), (7, "a long beginning one", "One"), (8, "a long beginning two", "Two"), (9, "blue fig", "Late")]


@pytest.mark.parametrize("inline_limit", [100, 3, 0])
def test_first_hint(spark, inline_limit):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    hints = spark.createDataFrame(HINTS, "pos bigint, pattern string, vendor string")
    got = {r["id"]: (r["pos"], r["vendor"]) for r in first_hint(texts, hints, "id", inline_limit=inline_limit).collect()}
    want = {}
    for i, text in enumerate(TEXTS):
        found = sorted((pos, vendor) for pos, pattern, vendor in HINTS if pattern.lower() in text.lower())
        want[i] = found[0] if found else (None, None)
    assert got == want


def test_every_length_and_place_of_a_pattern(spark):
    """Patterns of 1 to 12 characters at every offset of a text, with characters beyond the basic plane before them."""
    alphabet = "ab🙂cdé"
    body = "".join(alphabet[(i * i + i // 3) % 6] for i in range(60))
    texts = spark.createDataFrame([(k, "🙂" * (k % 3) + body[k:]) for k in range(40)], "id int, text string")
    patterns = sorted({body[i:i + n] for n in range(1, 13) for i in range(0, 48, 5)})
    hints = spark.createDataFrame([(n, p, f"v{n}") for n, p in enumerate(patterns)], "pos bigint, pattern string, vendor string")
    for first in (0, len(patterns) // 2, len(patterns) - 6):
        part = hints.where(f"pos >= {first}")
        found = first_hint(texts, part, "id", inline_limit=0)
        got = {r.id: r.pos for r in found.collect()}
        assert got == {r.id: min((n for n, p in enumerate(patterns) if n >= first and p in r.text), default=None) for r in texts.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_hints(spark):
    texts = spark.createDataFrame([(1, "x")], "id int, text string")
    hints = spark.createDataFrame([], "pos bigint, pattern string, vendor string")
    assert [tuple(r) for r in first_hint(texts, hints, "id").collect()] == [(1, None, None)]


@pytest.mark.parametrize("inline_limit", [100, 0])
def test_edges_are_alike_either_way(spark, inline_limit):
    """Repeated and NULL keys, NULL texts, and NULL, empty and repeated patterns."""
    texts = spark.createDataFrame([(1, "has blue"), (2, "fig"), (2, "blue fig"), (None, "blue"), (3, None), (4, "none")], "id int, text string")
    hints = spark.createDataFrame([(5, "FIG", "Fig"), (6, "blue", "Blue"), (6, "blue", "Again"), (7, None, "Null"), (8, "FIG", None)],
                                  "pos bigint, pattern string, vendor string")
    got = sorted(map(tuple, first_hint(texts, hints, "id", inline_limit=inline_limit).collect()), key=str)
    shown = [(i, p) for i, p, _ in got]
    assert shown == sorted([(1, 6), (2, 5), (2, 5), (None, 6), (3, None), (4, None)], key=str)
    everywhere = hints.union(spark.createDataFrame([(9, "", "Any")], hints.schema))
    got = {(i, p, v) for i, p, v in map(tuple, first_hint(texts, everywhere, "id", inline_limit=inline_limit).collect()) if p == 9 or i == 3}
    assert got == {(4, 9, "Any"), (3, None, None)}


def test_rules_with_many_hints(spark):
    from ledgerloom.operators.answers import read_texts
    from ledgerloom.rules import Rules

    many = Rules(hints=tuple((f"KEY{n:04d}", f"Vendor {n}") for n in range(2000)))
    docs = spark.createDataFrame([(1, "x key1234 and key0777"), (2, "Plain Shop")], "k int, text string")
    got = {r.k: (r.reading.hinted, r.reading.vendor) for r in read_texts(docs, many).collect()}
    assert got == {1: (True, "Vendor 777"), 2: (False, "Plain Shop")}
