"""Language identification with interpolated Kneser-Ney character models, one per language.

A model predicts each letter of a word, and its end, from the letters before it. It is stored as sorted arrays of
n-gram hashes with, for every language side by side, the log probability of the last letter and the backoff weight of
the n-gram as a history. A text gets the language of the lowest cross-entropy per symbol; it is rejected if even that
one is higher than texts of the language ever are, by a limit calibrated on texts the models have not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import small_batches, written
from ledgerloom.llm.tokens import mix

UNDETERMINED = "und"
ORDER = 4
# Bound of the sample that the models are fitted on; all other steps see all texts.
SAMPLE_TEXTS = 500  # per language, the first by a hash of their id and text
SAMPLE_BYTES = 16_384  # per text on average: texts, of any length, are taken in hash order until that much is reached
LEAST_TEXTS = 20  # that are taken however long they are
DRAWN = 1.5  # times the texts wanted that are ranked
CALIBRATION_SHARE = 5  # every fifth sampled text calibrates the models of the others
REJECTED_SHARE, REJECTION_MARGIN = 0.001, 2.0
CACHED_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")
_C = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    found = _WORD.findall(text.lower()) if text else []
    return found if all(map(str.isalpha, found)) else [w for part in found for w in "".join(
        c if c.isalpha() else " " for c in part).split()]


def kneser_ney(words: Counter, order: int) -> dict:
    """grams: per order, n-gram to log10 probability of its last symbol; weights: history to log10 backoff weight; unknown."""
    raw: list[Counter] = [Counter() for _ in range(order + 1)]
    for word, n in words.items():
        text = f" {word} "
        for i in range(1, len(text)):
            for k in range(1, min(order, i + 1) + 1):
                raw[k][text[i - k + 1:i + 1]] += n
    probabilities, weights, lower = {}, {}, {}
    unknown = 1.0
    for k in range(1, order + 1):
        counts = raw[k]
        if k < order:  # in how many ways an n-gram is continued to the left; at the beginning of a word, how often it occurs
            counts = Counter(g[1:] for g in raw[k + 1])
            counts.update({g: n for g, n in raw[k].items() if g[0] == " " and len(g) > 1})
        of_counts = Counter(counts.values())
        d = of_counts[1] / (of_counts[1] + 2 * of_counts[2]) if of_counts[1] else 0.5
        d = min(max(d, 0.05), 0.95)
        total, kinds = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        current = {}
        for g, n in counts.items():
            h = g[:-1]
            below = lower[g[1:]] if k > 1 else 1 / (kinds[""] + 1)
            current[g] = (n - d) / total[h] + d * kinds[h] / total[h] * below
        if k == 1:
            unknown = d * kinds[""] / total[""] / (kinds[""] + 1) if counts else 1.0
        else:
            weights |= {h: math.log10(d * kinds[h] / total[h]) for h in total}
        probabilities |= {g: math.log10(p) for g, p in current.items()}
        lower = current
    return {"grams": probabilities, "weights": weights, "unknown": math.log10(unknown)}


def _hash_step(before: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(before * _C + code + np.uint64(1))


def _gram_hash(gram: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in gram:
        h = _hash_step(h, np.array([ord(c)], np.uint64))
    return int(h[0])


@dataclass
class Models:
    """All languages: per order, sorted hashes, log probabilities and backoff weights (n-grams x languages)."""

    languages: list[str]
    order: int
    keys: list[np.ndarray]
    log_p: list[np.ndarray]
    weight: list[np.ndarray]
    unknown: np.ndarray
    usual: np.ndarray | None = None  # mean cross-entropy of each language's texts
    limit: float = math.inf
    sharpness: float = 1.0

    @classmethod
    def of(cls, fitted: dict[str, dict], order: int) -> "Models":
        languages = sorted(fitted)
        unknown = np.array([fitted[l]["unknown"] for l in languages])
        keys, log_p, weight, below = [], [], [], {"": unknown}
        for k in range(1, order + 1):
            grams = sorted({g for l in languages for g in fitted[l]["grams"] if len(g) == k} |
                           {h for l in languages for h in fitted[l]["weights"] if len(h) == k})
            rows = {}
            for g in grams:
                rest = below.get(g[1:], unknown)
                rows[g] = np.array([fitted[l]["grams"].get(g, fitted[l]["weights"].get(g[:-1], 0.0) + rest[j] if k > 1 else rest[j])
                                    for j, l in enumerate(languages)])
            hashes = np.array([_gram_hash(g) for g in grams], np.uint64)
            by_hash = np.argsort(hashes)
            keys.append(hashes[by_hash])
            log_p.append(np.array([rows[g] for g in grams]).reshape(len(grams), len(languages))[by_hash])
            weight.append(np.array([[fitted[l]["weights"].get(g, 0.0) for l in languages] for g in grams]).reshape(len(grams), len(languages))[by_hash])
            below = rows
        return cls(languages, order, keys, log_p, weight, unknown)

    def _find(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[k - 1]
        if not len(keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log10 probability of each word, its end included, under each language."""
        out = np.zeros((len(words), len(self.languages)))
        step = 20_000
        for i in range(0, len(words), step):
            out[i:i + step] = self._word_scores(words[i:i + step])
        return out

    def _word_scores(self, words: list[str]) -> np.ndarray:
        code = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.array([len(w) + 2 for w in words])
        first = np.cumsum(size) - size
        place = np.arange(len(code)) - np.repeat(first, size)
        # gram[k][i]: hash of the k symbols that end at i
        gram = [np.zeros(len(code), np.uint64)]
        for k in range(1, self.order + 1):
            before = np.zeros(len(code), np.uint64)
            before[1:] = gram[-1][:-1]
            gram.append(_hash_step(before, code))
        total = np.zeros((len(code), len(self.languages)))
        todo = np.flatnonzero(place > 0)
        for k in range(self.order, 0, -1):
            deep = place[todo] + 1 >= k
            here = todo[deep]
            at, found = self._find(k, gram[k][here])
            total[here[found]] += self.log_p[k - 1][at[found]]
            missed = here[~found]
            if k > 1:
                h, known = self._find(k - 1, gram[k - 1][missed - 1])
                total[missed[known]] += self.weight[k - 2][h[known]]
            else:
                total[missed] += self.unknown
            todo = np.concatenate([todo[~deep], missed])
        return np.add.reduceat(total, first, axis=0)


class Judge:
    """Scores texts by their words, each distinct word once while it stays in the cache."""

    def __init__(self, models: Models):
        self.models, self.known = models, {}
        self.scores, self.symbols = np.zeros((0, len(models.languages))), np.zeros(0, np.int64)

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: log10 probability under each language, number of symbols (0: no letters)."""
        words = [words_of(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known, self.scores, self.symbols = {}, self.scores[:0], self.symbols[:0]
        new = list(set().union(*words).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, self.models.word_scores(new)])
            self.symbols = np.concatenate([self.symbols, np.array([len(w) + 1 for w in new])])
        n = np.array([len(w) for w in words], np.int64)
        at = np.fromiter((self.known[w] for part in words for w in part), np.int64, int(n.sum()))
        full = np.flatnonzero(n)
        log_p, symbols = np.zeros((len(texts), len(self.models.languages))), np.zeros(len(texts), np.int64)
        if len(full):
            first = (np.cumsum(n) - n)[full]
            log_p[full] = np.add.reduceat(self.scores[at], first, axis=0)
            symbols[full] = np.add.reduceat(self.symbols[at], first)
        return log_p, symbols

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (`und` without letters or models), its probability among all, and whether it is rejected."""
        if not self.models.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        log_p, symbols = self.totals(texts)
        none = symbols == 0
        best = log_p.argmax(axis=1)
        odds = np.power(10.0, self.models.sharpness * (log_p - log_p.max(axis=1, keepdims=True)))
        score = np.where(none, 0.0, odds.max(axis=1) / odds.sum(axis=1))
        excess = self.excess(log_p, symbols, best)
        names = [UNDETERMINED if no else self.models.languages[b] for no, b in zip(none.tolist(), best.tolist())]
        return names, score, none | (excess > self.models.limit)

    def excess(self, log_p: np.ndarray, symbols: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Cross-entropy above what is usual in the language; in short texts, which vary more, it counts less."""
        if self.models.usual is None:
            return np.zeros(len(symbols))
        n = np.maximum(symbols, 1)
        return (-log_p[np.arange(len(n)), language] / n - self.models.usual[language]) * np.sqrt(np.minimum(n, 400))


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        order: int = ORDER, sample_texts: int = SAMPLE_TEXTS, sample_bytes: int = SAMPLE_BYTES) -> Models:
    """Models of all values of `lang_col` in the training rows, from a bounded sample of whole texts.

    Rows with NULL as text or language are not drawn, and repeated rows once; texts of any length are, whole, until
    sample_texts or sample_texts * sample_bytes bytes are reached. Each language is fitted in a task of its own; the
    driver gets one count per language, the fitted n-grams and the calibration texts, bounded by the sample.
    """
    lang, text = F.col(lang_col).cast("string"), F.col(text_col)
    h = F.xxhash64(F.lit("langid"), F.col(id_col), text)
    labelled = docs.where(F.coalesce(train, F.lit(False)) & lang.isNotNull() & text.isNotNull())
    units = written(labelled.groupBy(lang.alias("lang"), h.alias("h")).agg(F.max(F.octet_length(text)).cast("long").alias("size")), "langid-units")
    # A share of the hash range per language holds more than the texts wanted, so no task ranks more than a few of them.
    shares = {r["lang"]: min(1.0, DRAWN * max(sample_texts, 100) / r["n"])
              for r in units.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return Models.of({}, order)
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    by_hash = Window.partitionBy("lang").orderBy("h")
    ranked = (units.where(F.col("h") / F.lit(2.0 ** 64) + 0.5 <= share)
              .withColumn("rank", F.row_number().over(by_hash))
              .withColumn("before", F.coalesce(F.sum("size").over(by_hash.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    chosen = ranked.where((F.col("rank") <= sample_texts) & ((F.col("before") < sample_texts * sample_bytes) | (F.col("rank") <= LEAST_TEXTS)))
    sample = (labelled.select(lang.alias("lang"), h.alias("h"), text.alias("text"))
              .join(F.broadcast(chosen.select("lang", "h", "rank")), ["lang", "h"])
              .groupBy("lang", "rank").agg(F.min("text").alias("text")))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["lang", "text", "rank"]).to_pylist(), key=lambda r: r["rank"])
        held = [r["text"] for r in rows if r["rank"] % CALIBRATION_SHARE == 0]
        model = kneser_ney(Counter(w for r in rows if r["rank"] % CALIBRATION_SHARE for w in words_of(r["text"])), order)
        return pa.table({
            "lang": [rows[0]["lang"]], "grams": pa.array([list(model["grams"])], pa.list_(pa.string())),
            "log_p": pa.array([list(model["grams"].values())], pa.list_(pa.float64())),
            "histories": pa.array([list(model["weights"])], pa.list_(pa.string())),
            "weight": pa.array([list(model["weights"].values())], pa.list_(pa.float64())),
            "unknown": [model["unknown"]], "held": pa.array([held], pa.list_(pa.string()))})

    rows = sample.groupBy("lang").applyInArrow(run, (
        "lang string, grams array<string>, log_p array<double>, histories array<string>, weight array<double>, "
        "unknown double, held array<string>")).collect()
    models = Models.of({r.lang: {"grams": dict(zip(r.grams, r.log_p)), "weights": dict(zip(r.histories, r.weight)), "unknown": r.unknown}
                        for r in rows if r.grams}, order)
    return _calibrated(models, {r.lang: r.held for r in rows if r.grams})


def _calibrated(models: Models, held: dict[str, list[str]]) -> Models:
    judge = Judge(models)
    log_p, symbols = judge.totals([t for l in models.languages for t in held[l]])
    truth = np.repeat(np.arange(len(models.languages)), [len(held[l]) for l in models.languages])
    full = symbols > 0
    log_p, symbols, truth = log_p[full], symbols[full], truth[full]
    if not len(truth):
        return models
    entropy = -log_p[np.arange(len(truth)), truth] / symbols
    models.usual = np.array([np.median(entropy[truth == j]) if (truth == j).any() else np.median(entropy) for j in range(len(models.languages))])
    excess = judge.excess(log_p, symbols, truth)
    models.limit = REJECTION_MARGIN * max(float(np.quantile(excess, 1 - REJECTED_SHARE)), 1.0)

    def loss(sharpness: float) -> float:
        scaled = sharpness * math.log(10) * (log_p - log_p.max(axis=1, keepdims=True))
        return float(np.mean(np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(truth)), truth]))

    models.sharpness = min((2.0 ** -k for k in range(8)), key=loss)
    return models


def _judged(docs: DataFrame, models: Models, text_col: str) -> DataFrame:
    """`docs` with __lang, __score, __rejected."""
    small_batches(docs.sparkSession)
    shared, index = docs.sparkSession.sparkContext.broadcast(models), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            language, score, rejected = judge.judge(batch.column(index).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names, "__lang", "__score", "__rejected"])

    out = docs.withColumns({"__lang": F.lit(None).cast("string"), "__score": F.lit(None).cast("double"), "__rejected": F.lit(None).cast("boolean")})
    return docs.mapInArrow(run, out.schema)


def predict(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row, from its whole text alone.

    A text without letters (NULL, empty, digits only) is `und` with score 0 and rejected; so is any text if no language
    was learned. Equal cross-entropies: the first language by name. Repeated rows are judged each.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _judged(narrow, models, "text").select("doc_id", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"),
                                                  F.col("__rejected").alias("rejected"))


def keep_identified(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not rejected, with their own columns (which may not be named __lang, __score, __rejected)."""
    return _judged(docs, models, text_col).where(~F.col("__rejected")).drop("__lang", "__score", "__rejected")
