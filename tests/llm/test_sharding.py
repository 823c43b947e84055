import hashlib

import pytest

from ledgerloom.llm import sharding


def brute(rows, limit):
    """Split buckets on their next bit until all fit."""
    bits = [format(int(hashlib.sha256(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), "060b") for i, _ in rows]
    sizes = [len((t or "").encode()) for _, t in rows]
    todo, out = [("", list(range(len(rows))))], {}
    while todo:
        name, members = todo.pop()
        total = sum(sizes[m] for m in members)
        if total <= limit or len(name) == 60:
            out |= {m: (name, total) for m in members}
        else:
            todo += [(name + b, [m for m in members if bits[m][len(name)] == b]) for b in "01"]
    return sorted(((rows[m][0], sizes[m], "b" + n, len(n), t) for m, (n, t) in out.items()), key=str)


@pytest.mark.parametrize("limit", [400, 5000, 1 << 20])
def test_equals_splitting_by_hand(documents, prose, limit):
    rows = [(k, prose(k, k % 40)[:390]) for k in range(300)] + [(500, None), (501, "")]
    assert sorted(map(tuple, sharding.assign(documents(rows), max_bytes=limit).collect()), key=str) == brute(rows, limit)


def test_rows_of_one_key_overflow(documents, edge_rows):
    rows = [(7, "x" * 60 + str(k)) for k in range(20)] + [(7, "y" * 500), (8, "z"), (None, "w")]
    found = sharding.assign(documents(rows), max_bytes=200).collect()
    assert len(found) == len(rows)
    sums = {}
    for r in found:
        sums.setdefault(r.shard, []).append(r.n_bytes)
        assert r.shard_bytes <= 200 or r.n_bytes == 500
    assert all(sum(v) <= 200 or v == [500] for v in sums.values())
    assert sharding.assign(documents([])).count() == 0
    assert sharding.assign(documents(edge_rows)).count() == len(edge_rows)


def test_written_shards(documents, prose, spark, tmp_path):
    docs = documents([(k, prose(k, 30)) for k in range(50)]).withColumnRenamed("source", "shard")
    sharding.write(docs, str(tmp_path / "out"), max_bytes=2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("__shard").distinct().count() > 4


@pytest.mark.parametrize("ids", ["null", "one", "third", "equal"])
def test_written_shards_keep_rows_of_one_id(documents, prose, spark, tmp_path, monkeypatch, ids):
    monkeypatch.setattr(sharding, "SALT_SHARDS", 2)
    name = {"null": lambda k: None, "one": lambda k: 5, "third": lambda k: 5 if k % 3 else k, "equal": lambda k: 5}[ids]
    rows = [(name(k), "same text " * 4 if ids == "equal" else prose(k, 1 + k % 12)) for k in range(90)]
    docs = documents(rows)
    sharding.write(docs, str(tmp_path / "out"), max_bytes=200)
    back = spark.read.schema(docs.schema.add("__shard", "string")).parquet(str(tmp_path / "out")).collect()
    assert sorted(map(str, (r[:2] for r in back))) == sorted(map(str, rows))
    sums = {}
    for r in back:
        sums.setdefault(r["__shard"], []).append(len(r.text.encode()))
    assert all(sum(v) <= 200 or len(v) == 1 for v in sums.values()) and len(sums) > 5
    if ids != "third":
        assert any(s.count(".") == 2 for s in sums)
