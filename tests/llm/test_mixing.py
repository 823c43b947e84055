import pytest

from ledgerloom.llm import mixing
from ledgerloom.llm.parameters import source_schedules, source_weights


def test_targets():
    assert mixing.targets({"a": 100, "b": 100}, {"a": 1, "b": 1}) == {"a": 100, "b": 100}
    assert mixing.targets({"a": 10, "b": 190}, {"a": 1, "b": 1}) == {"a": 30, "b": 170}
    assert mixing.targets({"a": 0, "b": 5}, {"a": 9, "b": 1}) == {"a": 0, "b": 5}
    assert mixing.targets({}, {}) == {}


def rows(prose):
    return [(k, prose(k, 1 + k % 60), None, ("s0", "s1", "s2", None)[0 if k % 3 else k % 4]) for k in range(200)] + [
        (300, None, None, "s1"), (301, "", None, "s2"), (302, " \n", None, None), (303, "one two", None, "s2"), (303, "one two", None, "s2"),
        (None, "no id here", None, "s1")]


def test_every_source_meets_its_target(documents, prose, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)  # many windows per source
    data = rows(prose)
    docs = documents(data).withColumnRenamed("lang", "size")
    found = mixing.plan(docs, source_weights, source_schedules).toPandas()
    again = mixing.plan(docs.repartition(5), source_weights, source_schedules).toPandas()
    order = lambda f: sorted(map(str, f.values.tolist()))
    assert order(found) == order(again) and len(found) == len(data)
    want = [len((t or "").split()) for _, t, *_ in data]
    assert sorted(found["size"]) == sorted(want)
    taken = found.copies.map(lambda c: sum(x["words"] for x in c))
    assert (taken <= 3 * found["size"]).all()
    names = ["s0", "s1", "s2", None]
    sizes = {s: sum(w for w, r in zip(want, data) if r[3] == s) for s in names}
    targets = mixing.targets(sizes, source_weights(names))
    for s in names:
        own = found.source.isna() if s is None else found.source == s
        assert found.target[own].iloc[0] == pytest.approx(targets[s])
        assert found.source_size[own].iloc[0] == sizes[s]
        assert abs(taken[own].sum() - targets[s]) <= 0.5


def test_positions_follow_the_schedule(documents, prose):
    docs = documents([(k, prose(k, 10), None, "s") for k in range(1000)])
    rising = lambda names: {"s": [(0.0, 0.0), (0.5, 1.0), (1.0, 1.0)]}
    found = mixing.report(docs, lambda names: {"s": 1}, rising).toPandas()
    # The schedule's area is 0.25 before the middle and 0.5 after it.
    assert (found.first_position < 0.5).mean() == pytest.approx(1 / 3, abs=0.01)
    assert (found.first_position < 0.25).mean() == pytest.approx(0.0625 / 0.75, abs=0.01)
    assert found.first_position.between(0, 1).all()


def words_of(found, source):
    return sum(len((r.text or "").split()) for r in found if r.source == source)


@pytest.mark.parametrize("ids", ["own", "null", "one", "third"])
def test_mixed_documents(documents, prose, spark, tmp_path, monkeypatch, ids):
    """Every source gives its target to half a document a copy, whatever the ids; all copies are whole rows."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    monkeypatch.setattr(mixing, "FULL_BUCKET_ROWS", 20)
    name = {"own": lambda k: k, "null": lambda k: None, "one": lambda k: 7, "third": lambda k: 7 if (k or 0) % 3 else k}[ids]
    data = [(name(r[0]), r[1], f"lang{k}", r[3]) for k, r in enumerate(rows(prose))]
    docs = documents(data)
    for given in (docs, docs.withColumn("c", docs.source)):
        out = mixing.mixed(given, source_weights, source_schedules)
        assert out.columns == given.columns
    docs.write.parquet(str(tmp_path / "docs"))
    for table in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        kept = mixing.mixed(table, source_weights, source_schedules).collect()
        by_row = {r[2]: r for r in data}
        assert all((r.doc_id, r.text, r.source) == (by_row[r.lang][0], by_row[r.lang][1], by_row[r.lang][3]) for r in kept)
        sizes = {s: sum(len((r[1] or "").split()) for r in data if r[3] == s) for s in ("s0", "s1", "s2", None)}
        targets = mixing.targets(sizes, source_weights(list(sizes)))
        for source, target in targets.items():
            longest = max(len((r[1] or "").split()) for r in data if r[3] == source)
            assert abs(words_of(kept, source) - target) <= longest / 2 + 0.5
    assert mixing.mixed(docs.limit(0), source_weights).count() == 0


def test_taken_words_of_a_hot_id(documents, prose, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    monkeypatch.setattr(mixing, "FULL_BUCKET_ROWS", 10)
    data = [(None, prose(k, 1 + k % 9), None, "s" + str(k % 2)) for k in range(120)]
    found = mixing.report(documents(data), source_weights).collect()
    for source, target in mixing.targets({s: sum(len(r[1].split()) for r in data if r[3] == s) for s in ("s0", "s1")}, {"s0": 1, "s1": 2}).items():
        own = [r for r in found if r.target == pytest.approx(target)]
        assert abs(sum(r.taken for r in own) - target) <= 0.5 and all(r.taken <= 3 * r["size"] for r in own)
