"""Text helpers as Spark SQL expressions.

Each function takes and returns SQL text, for `F.expr` or `selectExpr`. A long
expression then reaches the JVM in one call and is parsed there.
"""

from __future__ import annotations

from collections.abc import Iterable

from ledgerloom.functions import patterns as P

Sql = str


def quote(value: str | None) -> Sql:
    """A string literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values: Iterable[str | None]) -> Sql:
    items = ", ".join(quote(v) for v in values)
    return f"array({items})" if items else "CAST(array() AS ARRAY<STRING>)"


def let(name: str, value: Sql, body: Sql) -> Sql:
    """`body` with `name` standing for `value`, which is computed once per row and only if needed."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def keep_if(name: Sql, value: Sql, condition: Sql) -> Sql:
    """A select item that keeps the row only if the condition on `name` holds.

    A filter after a projection is pushed below it and computes a costly value
    twice; a generator with no or one row computes it once.
    """
    return f"explode(filter(array({value}), {name} -> {condition})) AS {name}"


def missing(c: Sql) -> Sql:
    return f"({c} IS NULL OR {c} = '')"


def none_if_empty(c: Sql) -> Sql:
    return f"nullif({c}, '')"


def strip(c: Sql) -> Sql:
    return f"trim(BOTH {quote(P.BLANKS + P.LINE_BREAKS)} FROM {c})"


def lines(text: Sql) -> Sql:
    """The stripped, non-blank lines of a text, in order."""
    pieces = f"split({text}, {quote(P.LINE_BREAK_CLASS)})"
    return f"filter(transform({pieces}, ln -> {strip('ln')}), ln -> ln <> '')"


def slug(c: Sql) -> Sql:
    return f"trim(BOTH '-' FROM regexp_replace(lower({c}), '[^a-z0-9]+', '-'))"


def amount_from_text(c: Sql) -> Sql:
    """`1,234.50` -> 1234.5; only commas and spaces are dropped, anything else odd gives NULL."""
    return f"try_cast(translate({c}, ', ', '') AS DOUBLE)"


def money(c: Sql) -> Sql:
    return f"coalesce(concat('$', format_number({c}, 2)), '')"


def fixed2(c: Sql) -> Sql:
    """Two decimals, no thousands marks, ties to even as in Python's `%.2f`."""
    return f"format_number(CAST({c} AS DOUBLE), '0.00')"


def week_label(day: Sql) -> Sql:
    """`%Y-W%U`: weeks start on Sunday, days before the first Sunday are week 00."""
    week = f"CAST(floor((dayofyear({day}) + 7 - dayofweek({day})) / 7) AS STRING)"
    return f"concat(lpad(CAST(year({day}) AS STRING), 4, '0'), '-W', lpad({week}, 2, '0'))"


def month_key(date: Sql) -> Sql:
    return f"CASE WHEN length({date}) >= 7 THEN substring({date}, 1, 7) ELSE 'Unknown' END"


def month_caption(key: Sql) -> Sql:
    """`2025-10` -> `October 2025`; a key that is no month stays as it is."""
    day = f"CASE WHEN {key} RLIKE '^[0-9]{{4}}-[0-9]{{2}}$' THEN try_cast(concat({key}, '-01') AS DATE) END"
    return f"coalesce(concat(date_format({day}, 'MMMM'), ' ', substring({key}, 1, 4)), {key})"


def fingerprint(date: Sql, vendor: Sql, amount: Sql) -> Sql:
    """Identity of a receipt: SHA-256 of date, lower-case vendor and amount."""
    name = f"lower({strip(f'coalesce({vendor}, {quote('')})')})"
    amount_text = f"coalesce({fixed2(amount)}, '')"
    return f"sha2(concat_ws('|', coalesce({date}, ''), {name}, {amount_text}), 256)"


def extension(name: Sql) -> Sql:
    """Suffix with its dot as in pathlib: a leading or a final dot starts none."""
    return f"regexp_extract({name}, {quote(r'(?s)^.+(\.[^.]+)$')}, 1)"


def stem(name: Sql) -> Sql:
    return f"substring({name}, 1, length({name}) - length({extension(name)}))"


def is_document(name: Sql) -> Sql:
    listed = ", ".join(quote(e) for e in P.IMAGE_EXTENSIONS + P.PDF_EXTENSIONS)
    return f"lower({extension(name)}) IN ({listed})"


def source_file(name: Sql) -> Sql:
    return f"concat({stem(name)}, '.pdf')"
