"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all rows that may be learned from.  Weights are trained by
follow-the-regularised-leader with L1 and L2 penalties on a bounded hash sample, so most are exactly
zero; a temperature fitted on a held-back part of the sample calibrates the probabilities.  The sample
has about ``TRAIN_ROWS`` rows of all languages alike, and about ``LEAST_ROWS`` (or all) of each rarer
one; ``MOST_LANGUAGES``, the most frequent, are learned.  Rows whose
``crc32`` of the id leaves remainder 1 by 3 are never learned from.

Defined results: null text, and text without a letter, is ``und`` with score 0; a null ``doc_id`` is
not held out and not learned from; equal texts get equal predictions; with nothing to learn from all
rows are ``und``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, map_texts, prepare, require
from .ngrams import counted, ngram_codes

BITS = 15
#: Rows that weights are fitted on, about.
TRAIN_ROWS = 4000
#: Rows of a language that the sample aims at where an even share would bring fewer.
LEAST_ROWS = 100
#: Languages that are learned at most; real corpora have some hundreds.
MOST_LANGUAGES = 1000
UNDETERMINED = "und"
#: Calibrated probability below which a filter rejects a document.
LEAST_SCORE = 0.4


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        at, x = vector(text, self.idf)
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values of unit length."""
    at, count = counted(ngram_codes(text, BITS), BITS)
    x = count * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


class Ftrl:
    """Follow-the-regularised-leader (proximal) for several classes, one row of state a bucket."""

    def __init__(self, buckets: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
        self.z = np.zeros((buckets + 1, classes))  # the last row is the bias
        self.n = np.zeros_like(self.z)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, target: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        error = softmax(x @ w)
        error[target] -= 1
        g = x[:, None] * error
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def temperature_of(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature of least log loss on rows that weights haven't seen."""

    def loss(t: float) -> float:
        scaled = logits / t
        scaled -= scaled.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(targets)), targets]))

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    return float(min(grid, key=loss)) if len(targets) else 1.0


def fit(rows: list[tuple[str, str]], idf: np.ndarray, epochs: int = 3) -> Model:
    """Train on (text, language); every fifth row of a language calibrates."""
    languages = sorted({lang for _, lang in rows})
    index = {lang: i for i, lang in enumerate(languages)}
    data = [(*vector(t, idf), index[lang]) for t, lang in rows]
    place, counted_ = [], dict.fromkeys(range(len(languages)), 0)
    for *_, k in data:
        place.append(counted_[k])
        counted_[k] += 1
    # The first rows of a language teach, whatever it has.
    held, seen = [d for i, d in zip(place, data) if i % 5 == 4], [d for i, d in zip(place, data) if i % 5 != 4]
    ftrl = Ftrl(len(idf), max(1, len(languages)))
    order = np.random.RandomState(5)
    for _ in range(epochs):
        for i in order.permutation(len(seen)):
            ftrl.learn(*seen[i])
    weights = ftrl.weights(slice(None))
    bias, weights = weights[-1], weights[:-1].astype(np.float32)
    logits = np.array([x @ weights[at] + bias for at, x, _ in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights, bias, temperature_of(logits, np.array([k for *_, k in held], int)))


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and of rows with each bucket; one partial count for each task and bucket."""

    def count(batches):
        total, found = 0, np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                marked = np.zeros(1 << BITS, bool)
                marked[ngram_codes(text, BITS)] = True
                found += marked
                total += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], total))], names=["bucket", "n"])

    counts = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency, total = np.zeros(1 << BITS), 0
    for bucket, n in counts.collect():  # at most one row a bucket
        if bucket < 0:
            total = n
        else:
            frequency[bucket] = n
    return total, frequency


def language_sample(usable: DataFrame, most: int = TRAIN_ROWS, least: int = LEAST_ROWS) -> DataFrame:
    """``text, lang`` of a hash sample of all languages, denser where a language is rare."""
    # One row for each language comes back.
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    share = most / max(most, sum(sizes.values()))
    rates: dict[float, list[str]] = {}
    for lang, n in sizes.items():
        rates.setdefault(min(1.0, max(share, least / n)), []).append(lang)
    mark = F.pmod(F.xxhash64("doc_id", "text", F.lit(31)), F.lit(1 << 30))
    chosen = F.lit(False)
    for rate, langs in rates.items():
        chosen = chosen | (F.col("lang").isin(langs) & (mark < int((1 << 30) * rate)))
    return usable.filter(chosen).limit(2 * (most + least * len(sizes))).select("text", "lang")


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Learn from ``text`` and ``lang`` of rows that aren't held out."""
    prepare(docs.sparkSession)
    rest = F.crc32(F.col("doc_id").cast("string")) % 3
    usable = require(docs, "doc_id", "text", "lang").filter((rest != 1) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    total, frequency = document_frequencies(usable)
    idf = (np.log((1 + total) / (1 + frequency)) + 0.1).astype(np.float32)
    if not total:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    sample = language_sample(usable, most)

    def learn(batches):
        rows = [r for b in batches for r in zip(b.column("text").to_pylist(), b.column("lang").to_pylist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(rows), idf))], pa.binary())], names=["model"])

    # The sample is bounded, so one task may hold it; only weights come back.
    return pickle.loads(bytes(sample.coalesce(1).mapInArrow(learn, "model binary").collect()[0][0]))


_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Predicted language and calibrated probability of every whole text."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        predicted = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        names, scores = zip(*predicted)
        columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return map_texts(require(docs, "doc_id", "text").select("doc_id", "text", held.alias("held_out")), run, _SCHEMA)


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, whole rows, whose language is determined with at least this probability."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> list[bool]:
        found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        return [name != UNDETERMINED and score >= least for name, score in found]

    return filter_texts(docs, keep)


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
