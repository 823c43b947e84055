"""Categories by very many rules: the rules are data, and only those are tried whose required literals a text holds.

A pattern needs some literal text to match: from its syntax tree, the longest run of plain characters that every match contains, or
one such run for each alternative. A run between two word boundaries has to be a whole word of the text: such words are met by equality.
The other literals are looked for together, by the q-grams of `lookup`. A matcher
is tried on a text if one of its literals is there, or if it has none. What is tried are its conditions as an array,
with patterns from columns, so the plan has the same size for any number of rules.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import Sql, quote
from ledgerloom.operators.extract import IGNORE_CASE
from ledgerloom.operators.lookup import may_hold
from ledgerloom.rules import Condition, Matcher, Rules
from ledgerloom.schemas import UNCATEGORIZED

MAX_INLINE_MATCHERS = 300
# Other characters than A-Z that ignoring case makes equal to an ASCII letter, and those letters.
_FOLDED, _PLAIN = "ſKıİ", "skii"
_EDGES = (C.AT_BOUNDARY, C.AT_BEGINNING, C.AT_BEGINNING_STRING, C.AT_END, C.AT_END_STRING)
_WORD = "[a-z0-9_]+"  # word characters to any regular expression, so no boundary lies inside


def _runs(tree) -> list[str] | None:
    """Literals of which every match of a parsed pattern contains at least one; None if none is sure."""
    best: list[str] | None = None

    def better(found: list[str] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    run = ""
    for op, value in list(tree) + [(None, None)]:
        if op is C.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        better([run] if run else None)
        run = ""
        if op is C.SUBPATTERN:
            better(_runs(value[3]))
        elif op is C.BRANCH:
            parts = [_runs(part) for part in value[1]]
            if all(parts):
                better([x for part in parts for x in part])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            better(_runs(value[2]))
        elif op is C.ATOMIC_GROUP:
            better(_runs(value))
    return best


def _whole(tree, before: bool = False, after: bool = False) -> list[str] | None:
    """Whole words of which every match of a parsed pattern contains at least one; None if none is sure.

    `before` and `after` tell whether the pattern stands next to edges of words.
    """
    items = list(tree)
    ends = [op is C.AT and value in _EDGES for op, value in items] + [after]
    run, edge = "", before  # characters since an edge of a word, and whether there was one
    for n, (op, value) in enumerate(items + [(None, None)]):
        if op is C.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if ends[n]:
            if edge and re.fullmatch(_WORD, run):
                return [run]
            run, edge = "", True
            continue
        inside = (edge and not run, n < len(items) and ends[n + 1])
        run, edge, found = "", False, None
        if op is C.SUBPATTERN:
            found = _whole(value[3], *inside)
        elif op is C.BRANCH:
            parts = [_whole(part, *inside) for part in value[1]]
            found = [x for part in parts for x in part] if all(parts) else None
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            found = _whole(value[2])
        elif op is C.ATOMIC_GROUP:
            found = _whole(value, *inside)
        if found:
            return found
    return None


def _found(pattern: str, look: Callable) -> list[str] | None:
    try:
        return look(parser.parse(pattern))
    except Exception:  # noqa: BLE001 - a pattern in Java's dialect that Python's parser does not read
        return None


def literals(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match contains one; None if that cannot be told."""
    return _found(pattern, _runs)


def words(pattern: str) -> list[str] | None:
    """Lower-case whole words of which every match contains one; None if that cannot be told."""
    return _found(pattern, _whole)


def required(m: Matcher, of_pattern: Callable[[str], list[str] | None] = literals) -> list[str] | None:
    """Literals (or words) of which vendor or text must hold one if the matcher applies; None: any text may do."""
    def of(c: Condition) -> list[str] | None:
        parts = [of_pattern(p) for p in (c.vendor_re, c.text_re) if p]
        return [x for part in parts for x in part] if parts and all(parts) else None

    found = []
    if m.any:  # one of its patterns has to hit; a condition without a pattern never does
        parts = [of(c) for c in m.any if c.vendor_re or c.text_re]
        if not parts:
            return []
        if all(parts):
            found.append([x for part in parts for x in part])
    for c in m.all:  # each pattern has to hit
        found += [x for x in (of_pattern(p) for p in (c.vendor_re, c.text_re) if p) if x]
    return max(found, key=lambda x: min(map(len, x)), default=None)


_CONDITIONS = "array<struct<vendor_re: string, text_re: string>>"


def _table(rows: DataFrame, rules: Rules, positions: list[int] | None = None) -> DataFrame:
    """pos and struct `rule` (pos, category, matcher, any, all) of each matcher (or those at some positions), with patterns ready to use."""
    def ready(conditions: tuple[Condition, ...]) -> list[tuple[str | None, str | None]]:
        return [tuple(IGNORE_CASE + p if p else None for p in (c.vendor_re, c.text_re)) for c in conditions]

    chosen = [(n, rules.matchers[n]) for n in (range(len(rules.matchers)) if positions is None else positions)]
    return rows.sparkSession.createDataFrame(
        [(n, m.category, m.name, ready(m.any), ready(m.all)) for n, m in chosen],
        f"pos bigint, category string, matcher string, any {_CONDITIONS}, all {_CONDITIONS}").select(
        "pos", F.struct("pos", "category", "matcher", "any", "all").alias("rule"))


def _applies(vendor: Sql, text: Sql) -> Sql:
    """Whether a matcher (struct r with any, all) applies, as in `extract.categorize`."""
    hit = {name: f"(c.{name} IS NOT NULL AND coalesce({column}, '') RLIKE c.{name})" for name, column in (("vendor_re", vendor), ("text_re", text))}
    each = " AND ".join(f"(c.{name} IS NULL OR coalesce({column}, '') RLIKE c.{name})" for name, column in (("vendor_re", vendor), ("text_re", text)))
    return f"(size(r.any) = 0 OR exists(r.any, c -> {hit['vendor_re']} OR {hit['text_re']})) AND forall(r.all, c -> {each})"


def _tries(keyed: DataFrame, by_word: list[tuple[int, str]], by_literal: list[tuple[int, str]]) -> DataFrame:
    """__pair, pos: the matchers that have one of their words or literals in a text."""
    entries = lambda found: keyed.sparkSession.createDataFrame(found, "pos bigint, pattern string")
    tries = keyed.sparkSession.createDataFrame([], "__pair bigint, pos bigint")
    if by_word:
        held = keyed.select("__pair", F.explode(F.array_distinct(F.regexp_extract_all("__low", F.lit(_WORD), F.lit(0)))).alias("pattern"))
        tries = tries.unionByName(held.join(F.broadcast(entries(by_word)), "pattern").select("__pair", "pos"))
    if by_literal:
        held = may_hold(keyed.select(F.col("__low").alias("low")), entries(by_literal).withColumn("vendor", F.lit(None).cast("string")))
        sure = F.transform(F.filter("__held", lambda h: F.contains(F.col("__low"), h["pattern"])), lambda h: h["pos"])
        texts = keyed.withColumn("__text_hash", F.xxhash64("__low")).join(held, "__text_hash")
        tries = tries.unionByName(texts.select("__pair", F.explode(F.array_distinct(sure)).alias("pos")))
    return tries


def with_category(rows: DataFrame, vendor: str, text: str, name: str, rules: Rules) -> DataFrame:
    """`rows` with struct(category, matcher) of the first matcher that applies, for any number of matchers.

    The matchers to try are found per hash of vendor and text and met by it, in one row for each text, so a text is not repeated for its
    tries; equal hashes only add tries. The rules are configuration, so tables of them are broadcast.
    """
    low = F.lower(F.translate(F.concat_ws("\n", F.coalesce(vendor, F.lit("")), F.coalesce(text, F.lit(""))), _FOLDED, _PLAIN))
    pair = F.xxhash64(F.coalesce(vendor, F.lit("")), F.coalesce(text, F.lit("")))
    by_word, by_literal, always = [], [], []
    for n, m in enumerate(rules.matchers):
        whole, found = required(m, words), required(m)
        if whole:
            by_word += [(n, x) for x in whole]
        elif found is None:
            always.append(n)
        else:
            by_literal += [(n, x) for x in found]
    tries = _tries(rows.select(pair.alias("__pair"), low.alias("__low")), by_word, by_literal)
    tried = tries.join(F.broadcast(_table(rows, rules)), "pos").groupBy("__pair").agg(F.collect_set("rule").alias("__tried"))
    met = rows.withColumn("__pair", pair).join(tried, "__pair", "left")
    each = "coalesce(__tried, array())"
    if always:
        met = met.crossJoin(F.broadcast(_table(rows, rules, always).agg(F.collect_list("rule").alias("__always"))))
        each = f"concat({each}, __always)"
    # In order, and none after the first that applies is tried.
    first = (f"aggregate(array_sort({each}), CAST(NULL AS STRUCT<category: STRING, matcher: STRING>), (found, r) -> IF(found IS NOT NULL, found, "
             f"IF({_applies(f'`{vendor}`', f'`{text}`')}, named_struct('category', r.category, 'matcher', r.matcher), found)))")
    none = f"named_struct('category', {quote(UNCATEGORIZED)}, 'matcher', CAST(NULL AS STRING))"
    return met.selectExpr(*[f"`{c}`" for c in rows.columns], f"coalesce({first}, {none}) AS `{name}`")
