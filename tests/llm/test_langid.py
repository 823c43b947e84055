import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid

SYLLABLES = {"aa": ["th", "er", "on", "in"], "bb": ["sch", "ung", "keit", "en"], "cc": ["ción", "os", "ue", "ado"]}


def text_of(lang, seed, n):
    s = SYLLABLES[lang]
    return " ".join("".join(s[(seed * 7 + k * k + j) % 4] for j in range(1 + (k + seed) % 3)) for k in range(n))


@pytest.fixture
def labelled(documents):
    return documents([(k, text_of(("aa", "bb", "cc")[k % 3], k, 60), ("aa", "bb", "cc")[k % 3]) for k in range(120)] + [
        (200, None, "aa"), (201, "text without label", None), (202, "", "bb")])


def test_held_out_accuracy_and_rejection(labelled, documents, edge_rows):
    models = langid.fit(labelled, train=F.col("doc_id") % 4 != 2)
    assert models.languages == ["aa", "bb", "cc"]
    found = langid.predict(labelled, models).join(labelled.select("doc_id", "lang", "text"), "doc_id").where("doc_id < 200").collect()
    assert all(r.lang == r.lang_pred and not r.rejected and 0 <= r.score <= 1 for r in found)
    edges = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(documents(edge_rows), models).collect() if r.lang_pred == "und"}
    assert edges == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (8, "und", 0.0)}
    noise = documents([(1, "zqxj vvkw qqzz xwvj kkqz " * 40)])
    assert langid.predict(noise, models).first().rejected


def test_keep_identified(labelled, documents):
    models = langid.fit(labelled, train=F.lit(True))
    docs = labelled.withColumnRenamed("source", "lang_pred").withColumnRenamed("n_chars", "score")
    kept = langid.keep_identified(docs, models)
    assert kept.columns == docs.columns and kept.where("doc_id < 200").count() == 120
    assert kept.where("doc_id in (200, 202)").count() == 0


def test_no_labels(documents):
    docs = documents([(1, "some text"), (2, None)])
    models = langid.fit(docs, train=F.lit(True))
    assert [(r.lang_pred, r.rejected) for r in langid.predict(docs, models).collect()] == [("und", True)] * 2
    assert langid.predict(docs.limit(0), models).count() == 0


def test_model_is_a_distribution():
    fitted = {"aa": langid.kneser_ney(langid.Counter({"abab": 3, "ba": 2, "abc": 1}), 4)}
    models = langid.Models.of(fitted, 4)
    known = sorted({g for g in fitted["aa"]["grams"] if len(g) == 1})
    # All ways to go on after "ab": each known symbol, and any unknown one.
    weight, p = fitted["aa"]["weights"], fitted["aa"]["grams"]

    def prob(h, c):
        for k in range(len(h) + 1):
            g = h[k:] + c
            if g in p:
                return 10 ** (p[g] + sum(weight.get(h[j:], 0.0) for j in range(k)))
        return 10 ** (fitted["aa"]["unknown"] + sum(weight.get(h[j:], 0.0) for j in range(len(h))))

    assert sum(prob(" ab", c) for c in known) + prob(" ab", "?") == pytest.approx(1.0)
    by_hand = langid.np.log10(prob(" ", "a") * prob(" a", "b") * prob(" ab", "c") * prob("abc", " "))
    assert models.word_scores(["abc"])[0, 0] == pytest.approx(by_hand)


def test_languages_of_long_texts_are_learned(documents):
    """Every text long, nearly every text long, or most texts NULL: all are languages like any other."""
    rows = [(k, text_of("aa", k, 60), "aa") for k in range(60)]
    rows += [(100 + k, text_of("bb", k, 6000), "bb") for k in range(12)]
    rows += [(1000 + k, text_of("cc", k, 5000 if k % 50 else 60), "cc") for k in range(300)]
    rows += [(2000 + k, None if k % 50 else "кот дом лес мир " * 20 + f" {k}", "dd") for k in range(1000)]
    assert min(len(t.encode()) for _, t, lang in rows if lang == "bb") > langid.SAMPLE_BYTES
    models = langid.fit(documents(rows), train=F.lit(True), sample_texts=10)
    assert models.languages == ["aa", "bb", "cc", "dd"]
    new = documents([(k, text_of(lang, 1000 + k, 80), lang) for k, lang in enumerate(("aa", "bb", "cc"))])
    assert {(r.doc_id, r.lang_pred) for r in langid.predict(new, models).collect()} == {(0, "aa"), (1, "bb"), (2, "cc")}


@pytest.mark.parametrize("same", [None, 1, 2, 3])
def test_rows_of_one_id(documents, same):
    rows = [(same, text_of(lang, k, 60) + f" {k}", lang) for lang in ("aa", "bb") for k in range(2000)]
    models = langid.fit(documents(rows + rows[:1] * 3000), train=F.lit(True), sample_texts=20)
    assert models.languages == ["aa", "bb"]


def plain_model(texts):
    """Interpolated Kneser-Ney by its formula: a function from word to log10 probability, over dicts of counts."""
    raw = [langid.Counter() for _ in range(6)]
    for text in texts:
        for word in langid.words_of(text):
            padded = f" {word} "
            for i in range(1, len(padded)):
                for k in range(1, 5):
                    if i - k + 1 >= 0:
                        raw[k][padded[i - k + 1:i + 1]] += 1
    counts = {4: raw[4]}
    for k in (3, 2, 1):
        counts[k] = langid.Counter()
        for g in raw[k + 1]:
            counts[k][g[1:]] += 1
        for g, n in raw[k].items():
            if len(g) > 1 and g[0] == " ":
                counts[k][g] = n
    discount = {}
    for k, c in counts.items():
        once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        discount[k] = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)

    def p(history, c):
        k = len(history) + 1
        below = p(history[1:], c) if history else 1 / (len(counts[1]) + 1)
        after = {g: n for g, n in counts[k].items() if g[:-1] == history}
        if not after:
            return below
        total = sum(after.values())
        return max(after.get(history + c, 0) - discount[k], 0) / total + discount[k] * len(after) / total * below

    def word(w):
        padded = f" {w} "
        return sum(math.log10(p(padded[max(0, i - 3):i], padded[i])) for i in range(1, len(padded)))

    return word


def test_predictions_equal_a_plain_model(spark, documents):
    """Every row of a small table: the language of the lowest cross-entropy per symbol under models by the formula, ties by name."""
    rows = [(k, text_of(("aa", "bb", "cc")[k % 3], k, 5 + k % 9), ("aa", "bb", "cc")[k % 3]) for k in range(60)]
    rows += [(100 + k, text_of(("aa", "bb", "cc")[k % 3], k, 3) + " " + text_of(("bb", "cc", "aa")[k % 3], k, 3), None) for k in range(30)]
    rows += [(200, None, "aa"), (201, "", None), (202, "12 34", "bb"), (203, "zz q", None), (204, "é ß", None), (3, rows[3][1], rows[3][2])]
    twins = [(300 + k, "same same words", name) for k in range(8) for name in ("xx", "yy")]
    docs = documents(rows + twins)
    models = langid.fit(docs, train=F.lit(True))
    ranked = {}
    hashed = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64(F.lit("langid"), "doc_id", "text").alias("h")).distinct()
    for r in sorted(hashed.collect(), key=lambda r: r.h):
        ranked.setdefault(r.lang, []).append(r.text)
    plain = {lang: plain_model([t for i, t in enumerate(texts, 1) if i % langid.CALIBRATION_SHARE]) for lang, texts in ranked.items()}
    checked = 0
    for r, (_, text, _) in zip(langid.predict(docs, models).collect(), rows + twins):
        words = langid.words_of(text)
        if not words:
            assert r.lang_pred == "und"
            continue
        entropy = {lang: -sum(map(score, words)) / sum(len(w) + 1 for w in words) for lang, score in plain.items()}
        best = min(entropy.values())
        close = sorted(lang for lang, e in entropy.items() if e < best + 1e-9)
        assert r.lang_pred == close[0] or len(close) > 1 and r.lang_pred in close and set(close) != {"xx", "yy"}, (text, entropy)
        checked += 1
    assert checked >= 100
