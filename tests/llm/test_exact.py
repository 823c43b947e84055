import hashlib
import re

from ledgerloom.llm import exact


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [r[0] for r, m in zip(rows, norm) if m == n and r[0] is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, norm.count(n), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(documents, edge_rows, prose):
    same_prefix = prose("p", 200)
    rows = edge_rows + [(20, same_prefix + " x"), (21, same_prefix + " y"), (22, same_prefix + " x"), (23, same_prefix + "\n\nx")]
    assert sorted(map(tuple, exact.report(documents(rows)).collect()), key=str) == brute(rows)


def test_keeps_rows_and_columns(documents, edge_rows):
    docs = documents(edge_rows).withColumnRenamed("source", "keep_id").withColumnRenamed("lang", "body")
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    # NULL, '' are one text, ' ' another; repeated rows of the kept id stay; the long text stays once.
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "4", "5", "6", "8", "9", "None"]
    assert exact.report(documents([])).count() == 0


def test_plan_has_no_python(documents, edge_rows):
    plan = exact.report(documents(edge_rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
