"""One text in, one value out, for every rule that is easy to get wrong."""

import pytest

from ledgerloom.functions import text as TX
from ledgerloom.operators import extract
from ledgerloom.rules import Condition, Matcher, Rules, rules_from_dict


def check(evaluate, expression, cases):
    found = evaluate(expression, [text for text, _ in cases])
    assert [(t, v) for (t, _), v in zip(cases, found)] == cases


def test_dates(evaluate):
    check(evaluate, extract.date_of("text"), [
        ("on 2024-03-09 at noon", "2024-03-09"),
        ("2024/3/9", "2024-03-09"),
        ("12/31/2023", "2023-12-31"),
        ("31/12/2023", "2023-12-31"),
        ("25-10-27", "2027-10-25"),
        ("1/2/099", "2099-01-02"),
        ("3/4/999", "0999-03-04"),
        ("March 5, 2024", "2024-03-05"),
        ("sept 5,2024", "2024-09-05"),
        ("Maybe 12, 2024", "2024-05-12"),
        ("Smarch 12, 2024", None),
        ("2024-13-40", None),
        ("2024-02-30 then 2024-02-29", "2024-02-29"),
        ("0000-01-01", None),
        ("13/13/2020", None),
        ("1/2/2020 and 2021-05-06", "2021-05-06"),
        ("x2024-01-01", None),
        ("٢٠٢٤-01-01", None),
        ("", None),
        (None, None),
    ])


def test_amounts(evaluate):
    check(evaluate, extract.amount_of("text"), [
        ("Total: $1,234.50", 1234.5),
        ("TOTAL 1234.56", 123.0),
        ("TOTAL 12 345", 12345.0),
        ("total 45\n123", None),
        ("Subtotal 90.00\nTax 5.00\nTotal 95.00", 95.0),
        ("due 1.00\ndue 2.00\ndue 3.00\ndue 4.00\ndue 5.00\ndue 900.00", 5.0),
        ("paid $7.25", 7.25),
        ("pay 0.00", None),
        ("USD 44", 44.0),
        ("apples 12.34\npears 56.78", 56.78),
        ("no money", None),
        ("", None),
        (None, None),
    ])


def test_amount_candidate_limit(evaluate):
    text = "due 1.00\ndue 2.00\ndue 3.00\ndue 4.00\ndue 5.00\ndue 900.00"
    assert evaluate(extract.amount_of("text", 6), [text]) == [900.0]


RULES = rules_from_dict({
    "vendor_blacklist": ["jane roe"],
    "vendor_hints": {"blue fig": "Blue Fig Ltd", "fig": "Figs"},
    "matchers": [{"name": "Inns", "category": "Stay",
                  "vendor_extract": [{"pattern": "[A-Z][a-z]+ Inn"}, {"pattern": "Jane Roe's \\w+"}],
                  "any": [{"vendor_re": "inn"}]}],
})


def test_vendors(evaluate):
    check(evaluate, extract.vendor_of("text", RULES), [
        ("at the BLUE FIG today", "Blue Fig Ltd"),
        ("a fig", "Figs"),
        ("hello\nat Thorn Inn tonight", "Thorn Inn"),
        ("thorn inn", "thorn inn"),
        ("Customer: Bob\nTHANK YOU\nGood Bread\n1 Long Street With Many Words", "Good Bread"),
        ("some words here\nACME CORP", "ACME CORP"),
        ("Jane Roe\nOther Shop", "Other Shop"),
        ("Jane Roe's Inns and more", "Jane Roe's Inns and more"),
        ("12345\n***\n\n", "12345"),
        ("Aa\n12 34 ab", "12 34 ab"),
        ("  \n\t\n", None),
        ("", None),
        (None, None),
    ])


def test_vendor_lines_far_below_are_not_seen(evaluate):
    top = "\n".join(["1234"] * 20)
    assert evaluate(extract.vendor_of("text", Rules()), [top + "\nReal Vendor"]) == ["1234"]


def test_empty_blacklist_entry_hides_every_line(evaluate):
    rules = Rules(blacklist=("",))
    assert evaluate(extract.vendor_of("text", rules), ["Visa\nGood Bread"]) == ["Visa"]


def test_line_scores(evaluate):
    score = TX.let("ls", TX.lines("text"), extract.best_line("ls", Rules()) + ".score")
    check(evaluate, score, [
        ("Bread", 120), ("BREAD", 170), ("ab\nBread", 117), ("Loaf", 100),
        ("one two three four", 105), ("x" * 55, 70), ("a b c d e f", None), ("room 1234", None), ("12 rooms", None),
        ("rooms 1²", None), ("rooms 1", 120),
    ])


def test_line_breaks_and_blanks_follow_python(evaluate):
    text = "\xa0a b　\r\n\x1c c\x85 d\x0b\x0c \ne\x1f"
    assert evaluate(TX.lines("text"), [text]) == [[s.strip() for s in text.splitlines() if s.strip()]]
    blanks = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    assert evaluate(TX.strip("text"), [blanks + "x" + blanks]) == ["x"]


def test_categories(evaluate):
    rules = Rules(matchers=(
        Matcher("never", "A", any=(Condition(),)),
        Matcher("both", "B", any=(Condition(text_re="bread"), Condition(vendor_re="baker")),
                all=(Condition(text_re="paid"), Condition())),
        Matcher("echo", "E", any=(Condition(text_re=r"(\d)\1"), Condition(text_re="zz"))),
        Matcher(None, "C", any=(Condition(text_re="^start"),)),
        Matcher("rest", "D", all=(Condition(vendor_re="x"),)),
    ))
    verdict = extract.categorize("'Baker & Co'", "text", rules)
    check(evaluate, f"concat({verdict}.category, '/', coalesce({verdict}.matcher, '-'))", [
        ("PAID for BREAD", "B/both"), ("paid", "B/both"), ("bread", "Uncategorized/-"),
        ("room 33", "E/echo"), ("start", "C/-"), ("line\nstart", "Uncategorized/-"), (None, "Uncategorized/-"),
    ])
    catch_all = Rules(matchers=(Matcher("all", "Z"),))
    assert evaluate(extract.categorize("text", "text", catch_all) + ".category", [None]) == ["Z"]
    assert evaluate(extract.categorize("text", "text", Rules()) + ".category", ["x"]) == ["Uncategorized"]


def test_rules():
    assert rules_from_dict({}).categories == ("Uncategorized",)
    assert rules_from_dict({"matchers": [{"category": ""}]}).matchers[0].category == "Uncategorized"
    assert Rules(blacklist=("Example: me", "Bob")).without_example_blacklist().blacklist == ("Bob",)
    with pytest.raises(ValueError):
        rules_from_dict({"matchers": [{"any": [{"text_re": "(?P<a>x)"}]}]})


def test_rules_file(spark, tmp_path):
    from ledgerloom.rules import load_rules

    path = tmp_path / "rules.json"
    path.write_text('{"vendor_hints": {"b": "2", "a": "1"},\n "matchers": [{"name": "m", "any": [{"text_re": "x"}]}]}')
    rules = load_rules(spark, str(path))
    assert rules.hints == (("b", "2"), ("a", "1"))
    assert rules.matchers == (Matcher("m", any=(Condition(text_re="x"),)),)
    missing = load_rules(spark, str(tmp_path / "none.json"))
    assert missing == Rules() and missing.categories == ()


def test_scalars(evaluate):
    check(evaluate, TX.slug("text"), [("Food/Grocery  & Co!", "food-grocery-co"), ("--", ""), ("É", "")])
    check(evaluate, TX.money("CAST(text AS DOUBLE)"), [
        ("1234.5", "$1,234.50"), ("-1", "$-1.00"), ("0.125", "$0.12"), ("2.675", "$2.67"), (None, "")])
    check(evaluate, TX.week_label("CAST(text AS DATE)"), [
        ("2023-01-01", "2023-W01"), ("2024-01-01", "2024-W00"), ("2024-01-07", "2024-W01"), ("2024-12-31", "2024-W52")])
    check(evaluate, TX.month_key("text"), [("2024-05-06", "2024-05"), ("2024", "Unknown"), (None, "Unknown")])
    check(evaluate, TX.month_caption("text"), [
        ("2025-10", "October 2025"), ("2025-13", "2025-13"), ("10/27/2", "10/27/2"), ("Unknown", "Unknown")])
    check(evaluate, TX.source_file("text"), [("a.b.JPG", "a.b.pdf"), ("plain", "plain.pdf"), (".jpg", ".jpg.pdf")])
    check(evaluate, f"CAST({TX.is_document('text')} AS STRING)", [
        ("a.JPG", "true"), ("a.tiff", "true"), ("a.txt", "false"), (".pdf", "false"), ("pdf", "false")])


def test_fingerprints(evaluate):
    import hashlib

    same = TX.fingerprint("'2024-01-02'", "text", "3.1D")
    want = hashlib.sha256(b"2024-01-02|caf\xc3\xa9|3.10").hexdigest()
    assert evaluate(same, ["Café", " \tCAFÉ\n"]) == [want, want]
    empty = TX.fingerprint("CAST(NULL AS STRING)", "text", "CAST(NULL AS DOUBLE)")
    assert evaluate(empty, [None, " "]) == [hashlib.sha256(b"||").hexdigest()] * 2
