import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash, tokens


def fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_xxh64_of_all_lengths():
    data = np.random.default_rng(1).integers(0, 256, 400).astype(np.uint8)
    begin = np.repeat(np.arange(5), 200)
    end = begin + np.tile(np.arange(200), 5)
    assert tokens.xxh64(data, begin, end).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(begin, end)]


def components(fps):
    label = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j, b in enumerate(fps):
            if (a ^ b).bit_count() <= 4 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_equals_brute_force(documents, edge_rows, prose):
    rows = [r for r in edge_rows if r[0] is not None] + [(100 + k, prose(k % 5, 300) + f" w{k}") for k in range(40)] + [
        (200 + k, prose(k, 20)) for k in range(60)]
    fps = [fingerprint(t) for _, t in rows]
    label = components(fps)
    want = sorted((r[0], fp, min(rows[k][0] for k in range(len(rows)) if label[k] == own)) for r, fp, own in zip(rows, fps, label))
    docs = documents(rows).withColumnRenamed("source", "fp0").withColumnRenamed("lang", "rep")
    found = simhash.components(docs, shingle_words=4, radius=4, n_words=1).collect()
    assert sorted((r.doc_id, r.fp0 % (1 << 64), r.component_id) for r in found) == want
    assert simhash.components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10, 3000])
def test_linker_finds_all_pairs(n):
    dice = np.random.default_rng(n)
    points = dice.integers(0, 1 << 63, n).astype(np.uint64)
    for k in range(n // 2, n):  # chains of near fingerprints
        points[k] = points[k - n // 2] ^ np.uint64(sum(1 << int(b) for b in dice.choice(64, 3, replace=False)))
    linker = simhash.Linker(points[:, None], 4)
    linker.among(np.arange(n))
    for k in range(n // 2, n):
        assert linker.label[k] == linker.label[k - n // 2]
    assert len(set(linker.label.tolist())) == n - n // 2


def test_sure_bands_lose_no_pair():
    dice = np.random.default_rng(0)
    for n in (1000, 1 << 25, 1 << 33):
        bands = simhash.sure_bands(4, n)
        for _ in range(500):
            flips = sum(1 << int(b) for b in dice.choice(64, 4, replace=False))
            assert any(flips & mask == 0 for _, mask in bands)


def test_large_partitions_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 20)
    points = [(k, k) for k in range(150)]  # all within few bits of each other
    found = simhash.stars(simhash.links(spark.createDataFrame(points, "fp0 long, rep long"), 4)).collect()
    assert {r.b for r in found} == {0} and len(found) == 149


def test_long_chains_are_joined(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(100)] + [(202, 201)], "a long, b long")
    assert sorted(map(tuple, simhash.stars(edges).collect())) == [(k, 0) for k in range(1, 101)] + [(202, 201)]


def test_near_copies_are_dropped(documents, prose):
    texts = {k: prose(k, 250).split() for k in range(30)}
    rows = [(k, " ".join(t)) for k, t in texts.items()]
    rows += [(100 + k, " ".join(["changed" if i % 60 == 30 else w for i, w in enumerate(t)])) for k, t in texts.items()]
    docs = documents(rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= set(range(30)) and len(ids) <= 32  # similarity about 0.85: hardly any is missed


def jaccard(a, b):
    a, b = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_copies_equal_brute_force(spark, documents, prose):
    """All pairs of similarity 0.8 or more are linked and no others, also with few words, other first words and repeated passages."""
    rows = []
    for k in range(60):
        words = prose(k, 12 + 5 * k).split()
        rows.append((10 * k, " ".join(words)))
        for c, share in enumerate((0.80, 0.79, 0.82, 0.85, 0.77)):
            n = round(len(words) * (1 / share - 1))
            rows.append((10 * k + 1 + c, " ".join([f"new{k}{c}{i}" for i in range(n)] + words)))
        rows.append((10 * k + 6, " ".join(words * 9)))
    rows += [(1000, "a b c d e f g h i"), (1001, "a b c d e f g h"), (1002, "a b c d e f g"), (1003, None), (1003, " ")]
    label = {i: i for i, _ in rows}
    for i, x in rows:
        for j, y in rows:
            if i < j and i // 10 == j // 10 and x and y and jaccard(x, y) >= 0.8 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {r: low if v == high else v for r, v in label.items()}
    found = {r.doc_id: r.component_id for r in simhash.near_copies(documents(rows)).collect()}
    assert found == label
    assert simhash.near_copies(documents(rows).limit(0)).count() == 0


def test_near_copies_that_only_one_partner_links(spark, documents, prose):
    """In a bucket no text is left out because the first one is unlike it; a row is dropped for its own text, not its id."""
    words = prose("x", 200).split()
    chain = [(k, " ".join(words[10 * k:] + [f"tail{k}w{i}" for i in range(10 * k)])) for k in range(12)]
    other = [(7, prose("y", 80)), (None, chain[0][1])]
    kept = simhash.drop_near_duplicates(documents(chain + other)).collect()
    want = {i: i for i, _ in chain}
    for i, x in chain:
        for j, y in chain:
            if i < j and jaccard(x, y) >= 0.8:
                want = {r: want[i] if v == want[j] else v for r, v in want.items()}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept) == sorted(
        (i is None, i or 0, t) for i, t in [c for c in chain if want[c[0]] == c[0]] + other)


def test_pairs_that_agree_on_one_band_are_counted():
    sets = [np.arange(100, dtype=np.uint64), np.arange(10, 100, dtype=np.uint64)]
    both = np.arange(2)
    assert simhash.links_of_sets(sets, np.array([[1, 2, 3], [1, 4, 5]], np.uint64), both.copy(), both, both) == [(0, 1)]


def test_keys_of_fingerprints_within_the_radius_are_counted(spark):
    nodes = spark.createDataFrame([(bytearray([k]), fp) for k, fp in ((1, 0), (2, 0), (3, 15), (4, -1), (5, 31 << 20))], "key binary, fp0 long")
    assert sorted((r.a[0], r.b[0]) for r in simhash._within_radius(nodes).collect()) == [(2, 1), (3, 1)]
    data = np.frombuffer(b"a b c d e f ga b c", np.uint8)
    offsets = np.array([0, 13, 18])
    hashes, full, start = simhash.shingles_of(data, offsets, 5)
    fp = simhash._bands(hashes, full, start, 2)[1].to_numpy().view(np.uint64)
    assert fp.tolist() == simhash.fingerprints_of(data, offsets, 5)[:, 0].tolist()
