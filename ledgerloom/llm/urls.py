"""URL filters: all glob rules as one bit-parallel automaton over each canonical URL.

The globs of all rules stand one behind the other in a bit vector of several 64-bit words (Shift-And).
Per character, the vector is shifted, masked with the positions that accept it and joined with
the positions whose star loops on it. A batch of URLs advances together, one character position
at a time. `*` runs over any characters but `/`, `**` over any characters, `?` is one character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches, utf8

@dataclass(frozen=True)
class Rule:
    """verdict for a host and its subdomains, for paths that start with `path`; both are taken literally or, with `glob`, as globs.

    In a glob `*` stays within a host or path segment between slashes, `**` does not, `?` is one character, `\\` takes the next literally.
    """

    verdict: str
    host: str
    path: str = "/"
    glob: bool = False

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[bytes, ...]:
        """Over `.host/path`: the leading dot makes the host itself and its subdomains one case."""
        host, path = (self.host, self.path) if self.glob else (_literal(self.host), _literal(self.path))
        return (f"*.{host}{path}**".encode(),)


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if c in "*?\\" else c for c in text)


class ShiftAnd:
    """Globs packed into 64-bit words."""

    def __init__(self, globs: list[bytes]):
        steps, loops, starts, ends = [], [], [], []
        for glob in globs:
            starts.append(len(steps))
            steps.append(None)  # the state before the first character
            loops.append("")
            i = 0
            while i < len(glob):
                c = glob[i:i + 1]
                if c == b"*":
                    stars = 2 if glob[i:i + 2] == b"**" else 1
                    loops[-1] = "any" if stars == 2 or loops[-1] == "any" else "segment"
                    i += stars
                    continue
                if c == b"\\":
                    i, c = i + 1, glob[i + 1:i + 2]
                    steps.append(c)
                else:
                    steps.append("one" if c == b"?" else c)
                loops.append("")
                i += 1
            ends.append(len(steps) - 1)
        self.words = max(1, -(-len(steps) // 64))
        self.accepts = np.zeros((256, self.words), np.uint64)
        self.loops = np.zeros((256, self.words), np.uint64)
        self.starts = np.zeros(self.words, np.uint64)
        for k, (step, loop) in enumerate(zip(steps, loops)):
            word, bit = k // 64, np.uint64(1 << (k % 64))
            if step == "one":
                self.accepts[:, word] |= bit
            elif step is not None:
                self.accepts[step[0], word] |= bit
            if loop:
                self.loops[:, word] |= bit
                if loop == "segment":
                    self.loops[ord("/"), word] &= ~bit
        for k in starts:
            self.starts[k // 64] |= np.uint64(1 << (k % 64))
        self.ends = np.array(ends, np.int64)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text (bytes between two offsets), which globs match all of it: bool[texts, globs]."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begins, left = offsets[:-1][order], lengths[order]
        state = np.broadcast_to(self.starts, (len(order), self.words)).copy()
        for k in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -k, side="left"))  # texts longer than k come first
            c = data[begins[:n] + k]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.accepts[c]) | (now & self.loops[c])
        found = np.empty((len(order), len(self.ends)), bool)
        found[order] = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & np.uint64(1)
        return found


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for NULL or a text without `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.encode().lower().decode(), rest[:cut]


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row; the longest fitting rule wins.

    Rules of equal length: the one listed first wins. Where no rule fits (also for NULL, empty or
    malformed URLs) rule is NULL and the verdict is `default`. Repeated rows are judged each; other
    columns are not read. URLs of any length are read whole.
    """
    small_batches(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = [(g, k) for k, rule in enumerate(ranked) for g in rule.globs()]
    machine = ShiftAnd([g for g, _ in globs])
    owner = np.array([k for _, k in globs], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [canonical(u) for u in batch.column(1).to_pylist()]
            data, offsets = utf8(pa.array([f".{h}{p}" for h, p in parts], pa.string()))
            found = machine.hits(data, offsets)
            best = owner[found.argmax(axis=1)] if len(owner) else np.zeros(len(parts), np.int64)
            hit = found.any(axis=1) if len(owner) else np.zeros(len(parts), bool)
            chosen = [ranked[k] if h else None for k, h in zip(best.tolist(), hit.tolist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                pa.array([r and r.name for r in chosen], pa.string()),
                pa.array([r.verdict if r else default for r in chosen], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kind = narrow.schema["page_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
