"""Document-text-to-ledger analytics as Spark DataFrame jobs."""

from ledgerloom.plans.weekly import WeeklyLedger, canonical_rows, extract, resolve
from ledgerloom.rules import Rules, load_rules, rules_from_dict

__all__ = [
    "Rules",
    "WeeklyLedger",
    "canonical_rows",
    "extract",
    "load_rules",
    "resolve",
    "rules_from_dict",
]
