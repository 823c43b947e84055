"""Fixed schemas of the ledger tables."""

from __future__ import annotations

# One ledger row per document, in export column order.
RECEIPT_COLUMNS = ["date", "vendor", "amount", "category", "matcher", "notes", "source_file", "sha1"]

RECEIPT_SCHEMA = (
    "date string, vendor string, amount double, category string, "
    "matcher string, notes string, source_file string, sha1 string"
)

# What a provider gave for a file: a response, or the error that came instead.
ANSWERS_SCHEMA = "file_hash string, response string, error string"

REJECTS_SCHEMA = ANSWERS_SCHEMA + ", batch_id string"

DUPLICATES_SCHEMA = (
    "week_id string, seq string, kind string, fingerprint string, sha1 string, source_file string, "
    "original_week string, original_file string, seen_in string"
)

CACHE_SCHEMA = (
    "file_hash string, vendor string, date string, category string, "
    "confidence double, reasoning string, cached_at timestamp"
)

# `seq` orders rows inside one commit; `version` orders commits.
REGISTRY_SCHEMA = (
    "fingerprint string, file_hash string, week_id string, date string, vendor string, "
    "amount double, source_file string, seq string, first_seen_timestamp timestamp"
)

EXPORT_SCHEMA = RECEIPT_SCHEMA + ", week_id string, seq string"

LEDGER_SCHEMA = EXPORT_SCHEMA + ", date_source string"

RULES_SCHEMA = (
    "categories array<string>, vendor_blacklist array<string>, vendor_hints map<string,string>, "
    "matchers array<struct<name:string, category:string, "
    "vendor_extract:array<struct<pattern:string>>, "
    "any:array<struct<vendor_re:string,text_re:string>>, "
    "all:array<struct<vendor_re:string,text_re:string>>>>"
)

UNCATEGORIZED = "Uncategorized"
