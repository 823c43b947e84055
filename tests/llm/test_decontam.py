import re

import pytest

from ledgerloom.llm import decontam


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture
def case(documents, spark, edge_rows, prose):
    a, b = prose("a", 30), prose("b", 14)
    items = [(1, a), (2, b), (3, " ".join(a.split()[5:20])), (4, "two words"), (5, None), (6, ""), (7, "!!"), (10, "two words")]
    rows = edge_rows + [(20, f"x, {a.upper()} y"), (21, prose("c", 50) + " " + "-".join(b.split()[2:13]) + "."), (22, "Two; WORDS two words"),
                        (23, " ".join(a.split()[:9])), (24, "twowords"), (25, a + " " + b)]
    return rows, items, documents(rows), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_report_equals_brute_force(case, block_bytes):
    rows, items, docs, benchmark = case
    found = decontam.report(docs, benchmark, block_bytes=block_bytes)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()), key=str) == brute(rows, items)


def test_removal(case):
    rows, items, docs, benchmark = case
    clean = [r for r in brute(rows, items) if not r[2]]
    docs = docs.withColumnRenamed("source", "item_id").withColumnRenamed("lang", "items")
    kept = decontam.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in clean)
    cut = {r.doc_id: r.text for r in decontam.cut_spans(docs, benchmark).collect()}
    assert cut[20] == "x,  y" and cut[22] == "" and cut[24] == "twowords" and cut[1] is None
    assert decontam.report(docs.limit(0), benchmark).count() == 0
    assert decontam.report(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
