"""Stored categories that follow changes of the rules: only documents whose verdict a change can alter are read and judged again.

A verdict keeps which matcher won. Matchers that old and new rules have in common, in the same order, are stable. A document whose
winner is stable keeps it unless a matcher that is new, changed or moved now comes before it; all others were tried
before and did not apply. So verdicts with a stable winner ahead of the first unstable matcher stay as they are.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, replace
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import extract, manyrules
from ledgerloom.rules import Matcher, Rules
from ledgerloom.sources.commits import Store
from ledgerloom.sources.tables import StateTable

VERDICT_SCHEMA = "doc string, category string, matcher string, winner string"
NO_WINNER = ""


def identity(m: Matcher) -> str:
    """A hash of all that decides about a matcher's verdicts; the patterns for vendors do not."""
    return hashlib.sha1(json.dumps(asdict(replace(m, vendor_extract=())), sort_keys=True).encode()).hexdigest()


def untouched(old: list[str], new: list[str]) -> set[str]:
    """Identities of winners whose verdicts hold under the new matchers too."""
    stable = {b + k for _, b, n in SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks() for k in range(n)}
    first = next((k for k in range(len(new)) if k not in stable), len(new))
    kept = set(new[:first])
    return kept | {NO_WINNER} if first == len(new) else kept


@dataclass(frozen=True)
class StoredVerdicts:
    spark: SparkSession
    root: str

    @property
    def table(self) -> StateTable:
        return StateTable(self.spark, f"{self.root}/verdicts", VERDICT_SCHEMA, ("doc",))

    def _store(self) -> Store:
        return Store(self.spark, f"{self.root}/rules")

    def refresh(self, docs: DataFrame, rules: Rules) -> int:
        """Bring the verdicts up to date with `docs` (doc, vendor, text) and the rules; returns how many documents were judged.

        Documents that have no verdict yet are judged too. A refresh that failed can be repeated.
        """
        store, ids = self._store(), [identity(m) for m in rules.matchers]
        versions = sorted(store.names(""))
        old = json.loads(store.text(versions[-1])) if versions else None
        keys = docs.select("doc").distinct()
        if old is None or old == ids:
            wanted, batch_id = keys.join(self.table.read(keys).select("doc"), "doc", "left_anti"), uuid.uuid4().hex
        else:
            holds = self.table.read().where(F.col("winner").isin(sorted(untouched(old, ids)) or [None])).select("doc")
            wanted, batch_id = keys.join(holds, "doc", "left_anti"), f"rules {len(versions)}"
        self.table.upsert(self._judged(docs.join(wanted, "doc", "left_semi"), rules, ids), batch_id)
        if old != ids:
            store.create(f"{len(versions):06d}.json", json.dumps(ids))
        return self.table.batch(batch_id).count()

    def _judged(self, docs: DataFrame, rules: Rules, ids: list[str]) -> DataFrame:
        named = Rules(rules.categories, matchers=tuple(replace(m, name=i) for m, i in zip(rules.matchers, ids)))
        if len(ids) > manyrules.MAX_INLINE_MATCHERS:
            found = manyrules.with_category(docs, "vendor", "text", "v", named)
        else:
            found = docs.withColumn("v", F.expr(extract.categorize("vendor", "text", named)))
        names = self.spark.createDataFrame([(i, m.name) for i, m in {i: m for i, m in zip(ids, rules.matchers)}.items()], "winner string, matcher string")
        return found.select("doc", "v.category", F.coalesce("v.matcher", F.lit(NO_WINNER)).alias("winner")).join(names, "winner", "left")
