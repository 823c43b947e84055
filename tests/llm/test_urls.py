import random
import re

import numpy as np

from ledgerloom.llm import urls
from ledgerloom.llm.parameters import URL_RULES

RULES = [urls.Rule(*r) for r in URL_RULES]


def as_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i:i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "\\":
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + ("." if glob[i] == "?" else re.escape(glob[i])), i + 1
    return re.compile(out.encode(), re.S)


def test_automaton_equals_regex():
    dice = random.Random(5)
    globs = ["".join(dice.choice("ab/.*?") for _ in range(dice.randint(1, 12))) for _ in range(60)] + ["", "**", "\\*a", "a\\?"]
    texts = ["".join(dice.choice("ab/.*?") for _ in range(dice.randint(0, 14))).encode() for _ in range(400)]
    machine = urls.ShiftAnd([g.encode() for g in globs])
    assert machine.words > 4
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = machine.hits(data, np.cumsum([0, *map(len, texts)]))
    for j, glob in enumerate(globs):
        if "***" in glob:
            continue
        pattern = as_regex(glob)
        assert [bool(x) for x in found[:, j]] == [pattern.fullmatch(t) is not None for t in texts], glob


def test_verdicts(spark):
    cases = {
        "http://Example.ORG/es/1?x#y": ("example.org", "/es/1", "example.org/es/", "block"),
        "https://a.example.org/en/12": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "https://notexample.org/en/12": ("notexample.org", "/en/12", "org/", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/a.org/de/": ("x.com", "/a.org/de/", None, "allow"),
        "http://x.org": ("x.org", "", None, "allow"),
        "http://x.org?/es/": ("x.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://org/a://b": ("org", "/a://b", "org/", "allow"),
        "http://x.org/" + "p" * 100_000: ("x.org", "/" + "p" * 100_000, "org/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(cases)], "page_id long, url string, host string, rule string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages.union(pages), RULES).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())
    assert urls.judge(pages.limit(0), RULES).count() == 0
    assert urls.judge(pages, [], default="block").where("verdict = 'block'").count() == len(cases)


def test_first_of_equal_rules_wins(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x")], "page_id long, url string")
    rules = [urls.Rule("block", "a.b", "/"), urls.Rule("allow", "a.b", "/")]
    assert urls.judge(pages, rules).first().verdict == "block"


def test_glob_rules_equal_regex(spark):
    """Rules with wildcards, through judge, against regular expressions over host and path."""
    dice = random.Random(8)
    hosts, paths = ["a.com", "b.a.com", "xa.com", "a.org", "aa.co.uk", "a"], ["", "/", "/x/1.html", "/x/y/1.pdf", "/img/a?b", "/x*y", "/X/1.HTML", "/é/1.html"]
    urls_ = [f"http://{h}{p}" for h in hosts for p in paths]
    rules = [urls.Rule("block", "a.com", "/x/*.html", True), urls.Rule("allow", "?.com", "/**.pdf", True), urls.Rule("block", "*.co.*", "/", True),
             urls.Rule("block", "a.com", "/x\\*y", True), urls.Rule("allow", "a.org", "/x*y"), urls.Rule("block", "a.*", "/", True)]
    rules += [urls.Rule("block", "".join(dice.choice("a.*?") for _ in range(4)), "/" + "".join(dice.choice("x/*?1") for _ in range(4)), True) for _ in range(40)]
    rules = [r for r in rules if "***" not in r.host + r.path]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    ranked = sorted(rules, key=lambda r: -len(r.name))
    for i, url in enumerate(urls_):
        host, path = urls.canonical(url)
        fits = [r for r in ranked if as_regex(r.globs()[0].decode()).fullmatch(f".{host}{path}".encode())]
        assert found[i] == ((fits[0].name, fits[0].verdict) if fits else (None, "allow")), url
    assert {r for r, _ in found.values() if r} >= {"a.com/x/*.html", "*.co.*/"}
