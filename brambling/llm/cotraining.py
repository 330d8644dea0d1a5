"""Quality classifier by co-training: text content and page metadata teach each other.

Two logistic classifiers see disjoint views of a document: hashed character n-grams and word
repetition of its text; and source, language, length and line layout.  In each round both label the
rows of a bounded unlabelled pool they are surest of, for the other's training set.  Each view is
calibrated (Platt) on labelled rows that neither has seen, and a logistic combination of the two
log-odds scores every document.  A document is rejected below the threshold of least cost on the
calibration rows, where losing a good document costs as much as keeping ``GOOD_COST`` bad ones.

Defined results: null text or metadata is the empty text or its own category; null labels are not
learned from, a document labelled both ways counts as good; without labels of both kinds every
document scores 1 and is kept; equal rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, map_texts, prepare
from .ngrams import counted, hash_sample, ngram_codes

BITS = 14
#: Labelled rows (a quarter of them calibrate) and rows of the unlabelled pool, about.
LABELLED_ROWS = 3000
POOL_ROWS = 4000
ROUNDS = 4
#: Pseudo-labels that each view gives in a round, of each class in proportion.
EXCHANGE = 200
#: What losing a good document costs, in bad documents kept.
GOOD_COST = 20.0
#: Highest threshold: a document that is more likely good is kept.
MOST_THRESHOLD = 0.5
_META_BITS = 10
METADATA = ("source", "lang", "n_chars")

Vector = tuple[np.ndarray, np.ndarray]


def content_vector(text: str) -> Vector:
    """Unit n-gram counts, and the share of repeated words in ten steps."""
    at, count = counted(ngram_codes(text, BITS), BITS)
    x = np.sqrt(count)
    words = text.split()
    repeated = 10 * (len(words) - len(set(words))) // max(1, len(words))
    return np.append(at, (1 << BITS) + repeated), np.append(x / np.sqrt(max(1e-12, float(x @ x))), 1.0)


def metadata_vector(source: str | None, lang: str | None, n_chars: int | None, text: str) -> Vector:
    """Categories and binned layout, hashed."""
    lines = text.count("\n") + 1
    facts = {
        "source": source,
        "lang": lang,
        "chars": None if n_chars is None else int(2 * np.log2(1 + max(0, n_chars))),
        "lines": int(2 * np.log2(lines)),
        "line_length": int(2 * np.log2(1 + len(text) / lines)),
    }
    at = np.array(sorted({zlib.crc32(f"{k}={v}".encode()) % (1 << _META_BITS) for k, v in facts.items()}))
    return at, np.full(len(at), 1 / np.sqrt(len(at)))


@dataclass
class Logistic:
    """Logistic regression by AdaGrad over sparse rows, with weight decay at each touch."""

    size: int
    w: np.ndarray = field(default=None)
    b: float = 0.0

    def fit(self, rows: list[tuple[Vector, int]], epochs: int = 4, rate: float = 0.5, decay: float = 1e-4) -> Logistic:
        self.w, seen, b_seen, self.b = np.zeros(self.size), np.full(self.size, 1e-2), 1e-2, 0.0
        order = np.random.RandomState(3)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                (at, x), y = rows[i]
                error = 1 / (1 + np.exp(-np.clip(self.w[at] @ x + self.b, -30, 30))) - y
                g = error * x + decay * self.w[at]
                seen[at] += g * g
                b_seen += error * error
                self.w[at] -= rate * g / np.sqrt(seen[at])
                self.b -= rate * error / np.sqrt(b_seen)
        return self

    def logit(self, v: Vector) -> float:
        return float(np.clip(self.w[v[0]] @ v[1] + self.b, -30, 30))


def platt(logits: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Slopes and intercept (last) of calibrated log-odds, by Newton's method with a small ridge."""
    x = np.column_stack([logits, np.ones(len(y))])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (p - target) + ridge * beta)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def least_cost_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The score below which rejecting costs least, at most ``MOST_THRESHOLD``.

    Cost is flat between neighbouring scores: the middle of the best gap, in log-odds, is taken; of
    equally good gaps the widest.  One odd label moves the cost by one row, not the threshold to it.
    """
    order = np.argsort(scores, kind="stable")
    odds = np.log(np.clip(scores[order], 1e-9, 1 - 1e-9)) - np.log1p(-np.clip(scores[order], 1e-9, 1 - 1e-9))
    top = np.log(MOST_THRESHOLD / (1 - MOST_THRESHOLD))
    low = np.concatenate([[odds[0] - 2.0], odds])
    high = np.concatenate([odds, [max(top, odds[-1])]])
    cost = np.concatenate([[0.0], np.cumsum(np.where(y[order] == 1, GOOD_COST, -1.0))])
    usable = (low <= top) & (high > low)
    usable[0] = True
    best = np.flatnonzero(usable & (cost == cost[usable].min()))
    gap = best[np.argmax(np.minimum(high[best], top) - low[best])]
    return float(1 / (1 + np.exp(-(low[gap] + min(high[gap], top)) / 2)))


@dataclass
class CoModel:
    views: list[Logistic]
    calibrations: list[np.ndarray]
    combination: np.ndarray
    threshold: float

    def scores(self, vectors: tuple[Vector, Vector]) -> tuple[float, float, float]:
        """Calibrated probability of good quality: combined, by content, by metadata."""
        odds = [c[0] * v.logit(x) + c[1] for v, c, x in zip(self.views, self.calibrations, vectors)]
        joint = self.combination[:2] @ odds + self.combination[2]
        return tuple(float(1 / (1 + np.exp(-np.clip(o, -30, 30)))) for o in (joint, *odds))


def co_train(labelled: list[tuple[tuple[Vector, Vector], int]], pool: list[tuple[Vector, Vector]]) -> CoModel | None:
    """Exchange the surest pseudo-labels over rounds, then calibrate on unseen labelled rows."""
    held, seen = labelled[::4], [r for i, r in enumerate(labelled) if i % 4]
    if {y for _, y in seen} != {0, 1} or {y for _, y in held} != {0, 1}:
        return None
    sizes = ((1 << BITS) + 11, 1 << _META_BITS)
    training = [[(v[k], y) for v, y in seen] for k in (0, 1)]
    good = sum(y for _, y in seen) / len(seen)
    free = list(range(len(pool)))
    for round_ in range(ROUNDS + 1):
        views = [Logistic(n).fit(rows) for n, rows in zip(sizes, training)]
        if round_ == ROUNDS or not free:
            break
        taken: set[int] = set()
        for k in (0, 1):
            ranked = sorted(free, key=lambda i: (views[k].logit(pool[i][k]), i))
            ends = ((ranked[: max(1, round(EXCHANGE * (1 - good)))], 0), (ranked[-max(1, round(EXCHANGE * good)) :], 1))
            for rows, y in ends:
                sure = [i for i in rows if (views[k].logit(pool[i][k]) > 2.2) == bool(y) and abs(views[k].logit(pool[i][k])) > 2.2]
                training[1 - k] += [(pool[i][1 - k], y) for i in sure]
                taken.update(sure)
        free = [i for i in free if i not in taken]
    y = np.array([t for _, t in held])
    logits = np.array([[view.logit(x) for view, x in zip(views, v)] for v, _ in held])
    calibrations = [platt(logits[:, k], y) for k in (0, 1)]
    odds = np.column_stack([c[0] * logits[:, k] + c[1] for k, c in enumerate(calibrations)])
    model = CoModel(views, calibrations, platt(odds, y), MOST_THRESHOLD)
    model.threshold = least_cost_threshold(np.array([model.scores(v)[0] for v, _ in held]), y)
    return model


def _vectors(text: str | None, source, lang, n_chars) -> tuple[Vector, Vector]:
    text = text or ""
    return content_vector(text), metadata_vector(source, lang, n_chars, text)


def _with_metadata(docs: DataFrame) -> DataFrame:
    """The columns that both views read; missing metadata is null."""
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    have = [F.col(f"`{c}`").cast(k).alias(c) if c in docs.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    return docs.select("doc_id", "text", *have)


def train(docs: DataFrame, labels: DataFrame) -> CoModel | None:
    """Fit on bounded hash samples of labelled and unlabelled documents, in one task."""
    prepare(docs.sparkSession)
    rows = _with_metadata(docs)
    known = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null")
    chosen = hash_sample(known, LABELLED_ROWS, known.count(), "doc_id").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    # At most twice LABELLED_ROWS rows of two numbers are broadcast.
    chosen = F.broadcast(chosen)
    labelled = rows.join(chosen, "doc_id").limit(2 * LABELLED_ROWS)
    pool = hash_sample(rows.join(chosen, "doc_id", "left_anti"), POOL_ROWS, docs.count(), "doc_id", "n_chars").withColumn("quality", F.lit(None).cast("long"))
    sample = labelled.unionByName(pool).select("text", *METADATA, "quality")

    def learn(batches):
        found = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("text", *METADATA, "quality")))]
        found.sort(key=lambda r: (zlib.crc32((r[0] or "").encode("utf-8", "surrogatepass")), repr(r[1:])))
        made = [(_vectors(*r[:4]), r[4]) for r in found]
        model = co_train([(v, y) for v, y in made if y is not None], [v for v, y in made if y is None])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    fitted = sample.coalesce(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(bytes(fitted[0][0])) if fitted else None


_SCORES = "score double, content_score double, metadata_score double, kept boolean"


def score(docs: DataFrame, model: CoModel | None) -> DataFrame:
    """``doc_id`` with the combined and both views' probabilities, and the verdict."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        columns = [batch.column(c).to_pylist() for c in ("text", *METADATA)]
        found = [known.scores(_vectors(*r)) if known else (1.0, 1.0, 1.0) for r in zip(*columns)]
        limit = known.threshold if known else 0.0
        arrays = [pa.array(c, pa.float64()) for c in zip(*found)]
        kept = pa.array([s[0] >= limit for s in found])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays, kept], names=["doc_id", "score", "content_score", "metadata_score", "kept"])

    return map_texts(_with_metadata(docs), run, f"doc_id long, {_SCORES}")


def keep_good(docs: DataFrame, model: CoModel | None) -> DataFrame:
    """The documents, whole rows, that the model doesn't reject."""
    if model is None:
        return docs
    missing = [c for c in METADATA if c not in docs.columns]
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> list[bool]:
        known = shared.value
        columns = [[None] * batch.num_rows if c in missing else batch.column(c).to_pylist() for c in ("text", *METADATA)]
        return [known.scores(_vectors(*r))[0] >= known.threshold for r in zip(*columns)]

    return filter_texts(docs, keep)


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    docs = documents(spark, sf_dir)
    return score(docs, train(docs, documents(spark, sf_dir, "labels")))
