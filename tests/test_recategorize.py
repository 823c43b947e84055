"""Verdicts after any change of the rules equal a full run, and untouched documents are not judged."""

import random

import pytest

from ledgerloom.operators import extract
from ledgerloom.plans.recategorize import StoredVerdicts, untouched
from ledgerloom.rules import Condition, Matcher, Rules


def test_untouched_winners():
    assert untouched(list("abc"), list("abc")) == {"a", "b", "c", ""}
    assert untouched(list("abc"), list("abcx")) == {"a", "b", "c"}
    assert untouched(list("abc"), list("axbc")) == {"a"}
    assert untouched(list("abc"), list("ac")) == {"a", "c", ""}
    assert untouched(list("abc"), list("xabc")) == set()
    assert untouched([], list("a")) == set() and untouched(list("a"), []) == {""}


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_full_run(spark, tmp_path, seed):
    dice = random.Random(seed)
    words = ["oak", "elm", "ash", "fir", "yew", "bay"]
    docs = spark.createDataFrame([(f"d{n}", dice.choice(words), " ".join(dice.choices(words, k=2))) for n in range(60)], "doc string, vendor string, text string").cache()
    new = lambda: Matcher(f"m{dice.randint(0, 99)}", dice.choice("XYZ"), any=(Condition(*dice.sample([None, dice.choice(words)], 2)),))
    matchers, stored = [new() for _ in range(6)], StoredVerdicts(spark, str(tmp_path))
    assert stored.refresh(docs, Rules(matchers=tuple(matchers))) == 60
    for _ in range(3):
        kind = dice.choice(["insert", "drop", "swap", "same"])
        at = dice.randrange(len(matchers))
        if kind == "insert":
            matchers.insert(at, new())
        elif kind == "drop":
            matchers.pop(at)
        elif kind == "swap":
            matchers[at], matchers[0] = matchers[0], matchers[at]
        rules = Rules(matchers=tuple(matchers))
        n = stored.refresh(docs, rules)
        want = {r.doc: (r.v.category, r.v.matcher) for r in docs.selectExpr("doc", f"{extract.categorize('vendor', 'text', rules)} AS v").collect()}
        assert {r.doc: (r.category, r.matcher) for r in stored.table.read().collect()} == want
        assert n == 0 if kind == "same" else n <= 60
    more = docs.unionByName(spark.createDataFrame([("new", "oak", "elm")], docs.schema))
    assert stored.refresh(more, rules) == 1
