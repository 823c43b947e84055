"""Patterns in Python's dialect match in Spark what they match in Python."""

import json
import re
import warnings

import pytest

from ledgerloom.functions.dialect import PatternError, to_java
from ledgerloom.functions.text import quote
from ledgerloom.operators import extract
from ledgerloom.rules import Matcher, Rules, load_rules, rules_from_dict

PATTERNS = [r"foo\Z", "[a&&b]x", "a{,3}b", "[]a]x", "[^]a[]x", "x{y}", "x{2}y", "2}", r"[\b\\]", r"(\d)\1", r"a\x41", "[[|]", "(?i:FOO)", "^a|b$",
            r"\041", "[^^]x", "[a^]x", "a{2,}", r"[\w&&x]+y"]
TEXTS = ["foo", "foo\n", "ax", "&x", "x", "aaab", "b", "]x", "ax]", "x{y}", "xxy", "2}", "\\", "11", "aA", "[", "|", "FOO", "a\nb", "!", "^x", "aa", "&y", "qx", ""]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_matches(evaluate, pattern):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)
        want = [re.search(pattern, t) is not None for t in TEXTS]
    assert evaluate(f"text RLIKE {quote(extract.AS_WRITTEN + to_java(pattern))}", TEXTS) == want


@pytest.mark.parametrize("pattern", [r"\p{L}", "(?P<a>x)", "(?a)x", "(", r"\h", r"\Qx\E", "(a)?(?(1)b|c)"])
def test_refused_with_its_text(spark, tmp_path, pattern):
    with pytest.raises(PatternError, match=re.escape(repr(pattern))):
        rules_from_dict({"matchers": [{"any": [{"text_re": pattern}]}]})
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"matchers": [{"any": [{"text_re": pattern}]}]}))
    with pytest.raises(PatternError):
        load_rules(spark, str(path))


def test_an_empty_match_is_a_match(evaluate):
    rules = Rules(matchers=(Matcher("m", vendor_extract=("x*",)),))
    assert evaluate(extract.pattern_vendor("text", rules), ["abc", "xxa", None]) == ["", "xx", None]
