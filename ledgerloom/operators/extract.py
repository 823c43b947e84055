"""Date, amount, vendor and category from a text column.

Everything here is a Spark SQL expression: it runs as one narrow stage next to the
scan, with no Python worker and no shuffle. Functions take and return SQL text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ledgerloom.functions import patterns as P
from ledgerloom.functions.text import Sql, amount_from_text, let, lines, quote, string_array
from ledgerloom.rules import Condition, Matcher, Rules
from ledgerloom.schemas import UNCATEGORIZED

IGNORE_CASE = "(?idU)"
EVERY_LINE = "(?imdU)"
AS_WRITTEN = "(?dU)"

NO_TEXT = "CAST(NULL AS STRING)"


def _guarded(pattern: str) -> str:
    """The same pattern behind a cheap look ahead at its first character.

    Most places of a text are ruled out before the costly parts: the Unicode word
    boundary, or the list of labels.
    """
    for opening in ("[0-9]", "[A-Za-z]"):
        if pattern.startswith(r"\b(" + opening):
            return f"(?={opening}){pattern}"
    labels = re.match(r"\(\?:([a-z][^()]*)\)", pattern)
    if labels:
        initials = "".join(sorted({label[0] for label in labels[1].split("|")}))
        return f"(?=[{initials}]){pattern}"
    return pattern


# --- date -------------------------------------------------------------------

def _iso_date(y: Sql, m: Sql, d: Sql) -> Sql:
    """ISO text of a calendar day, NULL when there is no such day (years start at 1)."""
    parts = ", ".join(f"lpad(CAST({part} AS STRING), {width}, '0')"
                      for part, width in ((y, 4), (m, 2), (d, 2)))
    return let("iso", f"concat_ws('-', {parts})",
               f"CASE WHEN {y} >= 1 AND try_cast(iso AS DATE) IS NOT NULL THEN iso END")


def _numbers(match: Sql) -> Sql:
    return f"transform(split(translate({match}, '/', '-'), '-'), p -> CAST(p AS INT))"


_YEAR_FIRST = let("n", _numbers("m"), _iso_date("n[0]", "n[1]", "n[2]"))

_YEAR_LAST = let("n", _numbers("m"), _iso_date(
    "CASE WHEN n[2] < 100 THEN n[2] + 2000 ELSE n[2] END",
    "CASE WHEN n[0] > 12 AND n[1] <= 12 THEN n[1] ELSE n[0] END",
    "CASE WHEN n[0] > 12 AND n[1] <= 12 THEN n[0] ELSE n[1] END",
))

_MONTH_NAME = let("n", f"split(regexp_replace(m, {quote('(?U)[\\s,]+')}, ','), ',')", _iso_date(
    "CAST(n[2] AS INT)",
    f"array_position({string_array(P.MONTHS)}, lower(substring(n[0], 1, 3)))",
    "CAST(n[1] AS INT)",
))


def date_of(text: Sql) -> Sql:
    """First valid date: year-first forms, then year-last forms, then month names."""
    def first_valid(pattern: str, reader: Sql) -> Sql:
        found = f"regexp_extract_all({text}, {quote(IGNORE_CASE + _guarded(pattern))}, 0)"
        return f"get(filter(transform({found}, m -> {reader}), iso -> iso IS NOT NULL), 0)"

    return "coalesce({}, {}, {})".format(
        first_valid(P.DATE_YEAR_FIRST, _YEAR_FIRST),
        first_valid(P.DATE_YEAR_LAST, _YEAR_LAST),
        first_valid(P.DATE_MONTH_NAME, _MONTH_NAME),
    )


@dataclass(frozen=True)
class Limits:
    """How much of a text is looked at; None means all of it."""

    amount_candidates: int | None = P.AMOUNT_CANDIDATES
    vendor_lines: int | None = P.VENDOR_LINES
    last_resort_lines: int | None = P.LAST_RESORT_LINES
    prompt_chars: int | None = P.PROMPT_CHARS


# --- amount -----------------------------------------------------------------

def _cut(items: Sql, limit: int | None) -> Sql:
    """The first items; None means all of them."""
    return items if limit is None else f"slice({items}, 1, {int(limit)})"


def amount_of(text: Sql, candidate_limit: int | None = P.AMOUNT_CANDIDATES) -> Sql:
    """Largest of the first candidates (None: of all), labelled amounts coming first."""
    found = ", ".join(
        f"regexp_extract_all({text}, {quote(EVERY_LINE + _guarded(p))}, 1)" for p in P.AMOUNT_PATTERNS)
    values = f"transform(concat({found}), a -> {amount_from_text('a')})"
    return f"array_max({_cut(f'filter({values}, v -> v > 0)', candidate_limit)})"


# --- vendor -----------------------------------------------------------------

def hint_vendor(text: Sql, rules: Rules) -> Sql:
    """Vendor of the first hint that occurs in the text, ignoring case."""
    if not rules.hints:
        return NO_TEXT
    tests = " ".join(f"WHEN contains(low, lower({quote(key)})) THEN {quote(vendor)}"
                     for key, vendor in rules.hints)
    return let("low", f"lower({text})", f"CASE {tests} END")


def blacklisted(c: Sql, rules: Rules) -> Sql:
    tests = [f"contains(lower({c}), {quote(b.lower())})" for b in rules.blacklist]
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def pattern_vendor(text: Sql, rules: Rules) -> Sql:
    """Whole match of the first matcher pattern whose match is not blacklisted."""
    found = [
        let("hit", f"IF({text} RLIKE {quote(AS_WRITTEN + p)}, regexp_extract({text}, {quote(AS_WRITTEN + p)}, 0), NULL)",
            f"CASE WHEN NOT {blacklisted('hit', rules)} THEN hit END")
        for m in rules.matchers for p in m.vendor_extract
    ]
    return f"coalesce({', '.join(found)})" if found else NO_TEXT


def _is_skipped(line: Sql) -> Sql:
    pattern = IGNORE_CASE + "|".join(f"(?:{p})" for p in P.SKIP_LINE_PATTERNS)
    return f"{line} RLIKE {quote(pattern)}"


def _count(line: Sql, chars: str) -> Sql:
    return f"length({line}) - length(regexp_replace({line}, {quote(f'[{chars}]+')}, ''))"


def _score(line: Sql, position: Sql) -> Sql:
    spaces = f"length({line}) - length(replace({line}, ' ', ''))"
    return (
        f"{P.TOP_SCORE} - {P.LINE_PENALTY} * {position}"
        f" + IF(length({line}) BETWEEN {P.CAPITALS_LENGTHS[0]} AND {P.CAPITALS_LENGTHS[1]} AND upper({line}) = {line}, {P.CAPITALS_BONUS}, 0)"
        f" + IF(length({line}) BETWEEN {P.NAME_LENGTHS[0]} AND {P.NAME_LENGTHS[1]}, {P.NAME_BONUS}, 0)"
        f" - IF(length({line}) > {P.LONG_LINE}, {P.LONG_PENALTY}, 0)"
        f" - IF({spaces} > {P.MANY_SPACES}, {P.SPACES_PENALTY}, 0)"
    )


def _may_name_vendor(line: Sql, rules: Rules) -> Sql:
    letters = _count(line, r"\p{L}")
    digits = _count(line, r"\p{Nd}" + P.DIGIT_SIGNS)
    enough = let("letters", letters, f"letters >= 3 AND {digits} < greatest(2, letters DIV 3)")
    return (f"length({line}) BETWEEN {P.VENDOR_LENGTHS[0]} AND {P.VENDOR_LENGTHS[1]} "
            f"AND length({line}) - length(replace({line}, ' ', '')) < {P.TOO_MANY_SPACES} "
            f"AND NOT {_is_skipped(line)} AND NOT {blacklisted(line, rules)} AND {enough}")


def best_line(text_lines: Sql, rules: Rules, line_limit: int | None = P.VENDOR_LINES) -> Sql:
    """Struct (score, line) of the best of the first lines (None: of all); ties go to the earlier one.

    The score is cheap, so only a line that would beat the best so far is examined.
    """
    scored = f"transform({_cut(text_lines, line_limit)}, (ln, i) -> named_struct('score', {_score('ln', 'i')}, 'line', ln))"
    better = f"(best IS NULL OR c.score > best.score) AND {_may_name_vendor('c.line', rules)}"
    return (f"aggregate({scored}, CAST(NULL AS STRUCT<score: INT, line: STRING>), "
            f"(best, c) -> IF({better}, c, best))")


def last_resort_line(text_lines: Sql, rules: Rules, line_limit: int | None = P.LAST_RESORT_LINES) -> Sql:
    """First usable one of the first lines (None: of all), else simply the first line."""
    usable = f"length(ln) >= {P.VENDOR_LENGTHS[0]} AND NOT {blacklisted('ln', rules)} AND NOT {_is_skipped('ln')}"
    return f"coalesce(get(filter({_cut(text_lines, line_limit)}, ln -> {usable}), 0), get({text_lines}, 0))"


def line_vendor(text: Sql, rules: Rules, limits: Limits = Limits()) -> Sql:
    return let("ls", lines(text), f"coalesce({best_line('ls', rules, limits.vendor_lines)}.line, "
                                  f"{last_resort_line('ls', rules, limits.last_resort_lines)})")


def unhinted_vendor(text: Sql, rules: Rules, limits: Limits = Limits()) -> Sql:
    return f"coalesce({pattern_vendor(text, rules)}, {line_vendor(text, rules, limits)})"


def vendor_of(text: Sql, rules: Rules, limits: Limits = Limits()) -> Sql:
    return f"coalesce({hint_vendor(text, rules)}, {unhinted_vendor(text, rules, limits)})"


# --- category ---------------------------------------------------------------

def _alternation(patterns: list[str]) -> list[str]:
    """One pattern in place of several, unless numbered back references forbid it."""
    if len(patterns) < 2 or any(f"\\{n}" in p for p in patterns for n in range(1, 10)):
        return patterns
    return ["|".join(f"(?:{p})" for p in patterns)]


def _occurs(c: Sql, pattern: str) -> Sql:
    return f"coalesce({c}, '') RLIKE {quote(IGNORE_CASE + pattern)}"


def _any_of(vendor: Sql, text: Sql, conditions: tuple[Condition, ...]) -> Sql:
    tests = [_occurs(vendor, p) for p in _alternation([c.vendor_re for c in conditions if c.vendor_re])]
    tests += [_occurs(text, p) for p in _alternation([c.text_re for c in conditions if c.text_re])]
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def _matches(m: Matcher, vendor: Sql, text: Sql) -> Sql:
    tests = [_any_of(vendor, text, m.any)] if m.any else []
    for c in m.all:
        tests += [_occurs(col, p) for col, p in ((vendor, c.vendor_re), (text, c.text_re)) if p]
    return " AND ".join(tests) if tests else "true"


def categorize(vendor: Sql, text: Sql, rules: Rules) -> Sql:
    """struct(category, matcher) of the first matcher that applies."""
    def verdict(category: str, matcher: str | None) -> Sql:
        return f"named_struct('category', {quote(category)}, 'matcher', {quote(matcher)})"

    fallback = verdict(UNCATEGORIZED, None)
    tests = " ".join(f"WHEN {_matches(m, vendor, text)} THEN {verdict(m.category, m.name)}"
                     for m in rules.matchers)
    return f"CASE {tests} ELSE {fallback} END" if tests else fallback


def condition_hits(vendor: Sql, text: Sql, condition: Condition) -> Sql:
    """Whether either pattern of one condition occurs; used to report on rules."""
    return _any_of(vendor, text, (condition,))
