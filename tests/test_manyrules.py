"""Very many rules: literals of patterns, and verdicts equal to the compiled expression and to a plain loop."""

import random
import re

from ledgerloom.operators import extract, manyrules
from ledgerloom.operators.answers import read_texts
from ledgerloom.rules import Condition, Matcher, Rules


def test_literals_of_patterns():
    assert manyrules.literals("HOTEL") == ["hotel"] and manyrules.literals(r"\bINN\b") == ["inn"]
    assert manyrules.literals("AIR LINES|AIRWAYS") == [" lines", "ways"] and manyrules.literals("north|sea") == ["north", "sea"]
    assert manyrules.literals("(?:abc)+x?defg") == ["defg"] and manyrules.literals("(abcd|ef)*g") == ["g"]
    assert manyrules.literals("[0-9]+") is None and manyrules.literals("a*|b") is None and manyrules.literals("ab|c?") is None
    assert manyrules.literals("(?<=longer)ab") == ["ab"] and manyrules.literals("(?!longer)ab") == ["ab"]
    assert manyrules.literals("not ( a pattern") is None and manyrules.literals("é") is None


def verdicts(spark, rows, rules):
    df = spark.createDataFrame(rows, "id int, vendor string, text string")
    found = manyrules.with_category(df, "vendor", "text", "v", rules)
    assert found.columns == [*df.columns, "v"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    return {r.id: tuple(r.v) for r in found.collect()}, df


def test_equal_to_the_compiled_expression(spark):
    dice = random.Random(4)
    words = ["inn", "Café", "mill", "ſtore", "KIOSK", "İnn", "bar", "bargain", "x y", "12", "a.b"]
    condition = lambda: Condition(*(dice.choice([None, *[re.escape(w) for w in words], "b[ar]+", "inn|mill", r"\bbar\b", "[0-9]+", "s", "kiosk", "store"])
                                    for _ in range(2)))
    rules = Rules(matchers=tuple(Matcher(f"m{n}", f"c{n % 5}", any=tuple(condition() for _ in range(dice.randint(0, 2))),
                                         all=tuple(condition() for _ in range(dice.randint(0 if n % 9 else 1, 2)))) for n in range(40)))
    rows = [(n, dice.choice([None, "", *words]), dice.choice([None, "", " ".join(dice.choices(words, k=dice.randint(1, 6)))])) for n in range(120)]
    for part in (rules, Rules(matchers=rules.matchers[20:]), Rules(), Rules(matchers=(Matcher("all", "c"),))):
        got, df = verdicts(spark, rows, part)
        want = {r.id: tuple(r.v) for r in df.selectExpr("id", f"{extract.categorize('vendor', 'text', part)} AS v").collect()}
        assert got == want


def test_five_thousand_rules(spark):
    dice = random.Random(6)
    word = lambda: "".join(dice.choices("abcdeo", k=dice.randint(3, 7)))
    patterns = [dice.choice(["{}", r"\b{}", "{}[0-9]?", "(?:{}|{})", "{}.{}"]).format(word(), word()) for _ in range(5000)]
    rules = Rules(matchers=tuple(Matcher(f"m{n}", f"c{n % 9}", any=(Condition(text_re=p),)) for n, p in enumerate(patterns)))
    rows = [(n, "v", " ".join(word().upper() if dice.random() < 0.2 else word() for _ in range(dice.randint(0, 30)))) for n in range(80)]
    got, df = verdicts(spark, rows, rules)
    for n, _, text in rows:
        first = next((k for k, p in enumerate(patterns) if re.search(p, text, re.I)), None)
        assert got[n] == (("Uncategorized", None) if first is None else (f"c{first % 9}", f"m{first}"))
    docs = df.selectExpr("id", "text")
    read = {r.id: (r.reading.category, r.reading.matcher) for r in read_texts(docs, rules).where("reading.vendor IS NOT NULL").collect()}
    assert read and all(read[n] == got[n] for n in read)


def test_whole_words_of_patterns():
    assert manyrules.words(r"\bINN\b") == ["inn"] and manyrules.words(r"^a1\b.*") == ["a1"] and manyrules.words(r"x+ \bmill$") == ["mill"]
    assert manyrules.words(r"\bab\b|\bcd\b") == ["ab", "cd"] and manyrules.words(r"(?:\bab\b)+") == ["ab"]
    assert manyrules.words(r"\b(?:inn|mill)\b") == ["inn", "mill"] and manyrules.words(r"\b(?:inn)+\b") is None and manyrules.words(r"(x|\b)inn\b") is None
    assert all(manyrules.words(p) is None for p in ("inn", r"\binn", r"\binn\B", r"\bin+\b", r"\ba b\b", r"(\bab\b)?", r"\bab\b|cd", "\\bé\\b"))


def test_words_at_their_edges(spark):
    """A word next to other letters, marks and folded characters is met as the pattern itself would be."""
    rules = Rules(matchers=tuple(Matcher(w, w, any=(Condition(text_re=rf"\b{w}\b"),)) for w in ("kiosk", "the", "a_1", "is")))
    texts = ["KIOSK", "ſthe", "éthe the", "the\u0301", "\u212aıoſk", "x a_1.", "a_12", "İs", "this", "-is-", None, "the\u200dre", "1is is"]
    rows = [(n, None, text) for n, text in enumerate(texts)]
    got, df = verdicts(spark, rows, rules)
    assert got == {r.id: tuple(r.v) for r in df.selectExpr("id", f"{extract.categorize('vendor', 'text', rules)} AS v").collect()}


def test_a_text_is_not_repeated_for_the_rules_it_may_meet(spark):
    """One row of a text leaves each join, whatever the number of rules whose words it holds."""
    rules = Rules(matchers=tuple(Matcher(f"m{n}", "c", any=(Condition(text_re=rf"\bw{n}\b"),)) for n in range(400)))
    df = spark.createDataFrame([(1, "v", " ".join(f"w{n}" for n in range(399, -1, -1)))], "id int, vendor string, text string")
    found = manyrules.with_category(df, "vendor", "text", "v", rules)
    assert [tuple(r.v) for r in found.collect()] == [("c", "m0")]
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in shown.splitlines() if "Generate" in line]
    assert generated and all("__text" not in line and "text#" not in line for line in generated)
