"""User rules: loading, checking, and lookup tables made from them.

Rules are configuration, so they are read to the driver once and compiled into
column expressions (`operators.extract`).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.dialect import check_on_jvm, to_java
from ledgerloom.schemas import RULES_SCHEMA, UNCATEGORIZED


@dataclass(frozen=True)
class Condition:
    vendor_re: str | None = None
    text_re: str | None = None


@dataclass(frozen=True)
class Matcher:
    name: str | None = None
    category: str = UNCATEGORIZED
    vendor_extract: tuple[str, ...] = ()
    any: tuple[Condition, ...] = ()
    all: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Rules:
    """Order matters in hints and matchers: the first that matches wins."""

    categories: tuple[str, ...] = ()
    blacklist: tuple[str, ...] = ()
    hints: tuple[tuple[str, str], ...] = ()
    matchers: tuple[Matcher, ...] = field(default=())

    def patterns(self) -> list[str]:
        """All patterns, in Java's dialect."""
        return [p for m in self.matchers for p in (
            *m.vendor_extract, *(x for c in (*m.any, *m.all) for x in (c.vendor_re, c.text_re) if x))]

    def without_example_blacklist(self) -> Rules:
        """Drop blacklist entries that are marked as examples."""
        kept = tuple(b for b in self.blacklist if not b.upper().startswith("EXAMPLE:"))
        return Rules(self.categories, kept, self.hints, self.matchers)


def _checked(pattern: str | None) -> str | None:
    return to_java(pattern) if pattern else None


def _conditions(items: list[dict[str, Any]] | None) -> tuple[Condition, ...]:
    return tuple(
        Condition(_checked(i.get("vendor_re")), _checked(i.get("text_re"))) for i in items or []
    )


def rules_from_dict(raw: dict[str, Any]) -> Rules:
    categories = raw.get("categories")
    matchers = []
    for m in raw.get("matchers") or []:
        found = tuple(
            p for p in (_checked(e.get("pattern")) for e in m.get("vendor_extract") or []) if p
        )
        matchers.append(Matcher(m.get("name") or None, m.get("category") or UNCATEGORIZED, found,
                                _conditions(m.get("any")), _conditions(m.get("all"))))
    return Rules(
        categories=(UNCATEGORIZED,) if categories is None else tuple(categories),
        blacklist=tuple(raw.get("vendor_blacklist") or []),
        hints=tuple((raw.get("vendor_hints") or {}).items()),
        matchers=tuple(matchers),
    )


def load_rules(spark: SparkSession, path: str) -> Rules:
    """Read a rules file; a missing file means no rules.

    Patterns are in Python's dialect. They are translated and compiled once here, so a pattern that
    cannot be used fails now, with its text.
    """
    try:
        # As entries, since a map reaches Python without its order.
        row = spark.read.schema(RULES_SCHEMA).option("multiLine", True).json(path).withColumn(
            "vendor_hints", F.map_entries("vendor_hints")).first()
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in (err.getCondition() or ""):
            return Rules()
        raise
    raw = row.asDict(recursive=True) if row else {}
    hints = raw.get("vendor_hints") or []
    rules = rules_from_dict({**raw, "vendor_hints": {h["key"]: h["value"] for h in hints}})
    for pattern in rules.patterns():
        check_on_jvm(spark, pattern)
    return rules
