"""Toxicity: a chain of linear classifiers over hashed words and word beginnings.

The categories come one after the other; each later model also gets the
probabilities of the earlier ones, which for its training are out-of-fold
predictions, so that it learns from them as they will be on new documents.
Every model is an L1-penalised logistic regression over whether a feature occurs
in the text, fitted by accelerated proximal gradients in numpy.

Training takes a bounded sample of the labelled rows (``sample``, chosen by the
hash of doc_id); every document is scored, whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

BITS = 20
PREFIXES = (4, 5, 6, 7)
_EDGE = re.compile(rb"^[^\w\x80-\xff]+|[^\w\x80-\xff]+$")
N_DENSE = 4


def word_features(word: bytes) -> list[int]:
    """Hashed features of one word: the whole without marks at its ends, and its beginnings."""
    text = _EDGE.sub(b"", word).decode("utf-8", "replace").lower()
    if not text:
        return []
    parts = [f"={text}", *(f"^{text[:n]}" for n in PREFIXES if len(text) >= n)]
    return [xxh64_intdigest(p.encode(), 7) & ((1 << BITS) - 1) for p in parts]


_CAPITALS, _DIGITS, _SIGNS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>!"


def dense(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Shares that don't depend on single words: marks, capitals, digits, repeats."""
    size, n = max(1, len(text)), max(1, len(words))
    share = lambda kind: (len(text) - len(text.translate(None, kind))) / size
    return [share(_SIGNS), share(_CAPITALS), share(_DIGITS), 1 - distinct / n if words else 0.0]


@dataclass
class Linear:
    """One link of the chain: kept features with their weights."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    extra: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -30.0

    def predict(self, rows: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
        if not len(self.extra):
            return np.full(len(rows), 1 / (1 + np.exp(-self.bias)))
        table = np.zeros(1 << BITS)
        table[self.keys] = self.weights
        z = np.array([table[r].sum() for r in rows]) + extra @ self.extra + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, keep: int = 1500, l1: float = 3e-5, rounds: int = 250) -> Linear:
    """Without examples of both classes the model says no to everything."""
    n, pos = len(y), int(y.sum())
    if pos == 0 or pos == n:
        return Linear(bias=-30.0 if pos == 0 else 30.0)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    with_ = np.bincount(flat, minlength=1 << BITS)
    of_pos = np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v]), minlength=1 << BITS)
    gain = (of_pos * n - with_ * pos) ** 2 / np.maximum(1.0, with_ * (n - with_)) * (with_ >= 3)  # the chi-square of feature and class
    keys = np.sort(np.argsort(-gain, kind="stable")[:keep])
    keys = keys[gain[keys] > 10.8]  # beyond chance at 0.001
    place = np.full(1 << BITS, -1, np.int32)
    place[keys] = np.arange(len(keys))
    col = place[flat]
    row, col = owner[col >= 0].astype(np.int64), col[col >= 0].astype(np.int64)
    del flat, owner
    center, scale = extra.mean(0), extra.std(0)
    scale[scale < 1e-9] = np.inf  # what never varied says nothing
    dense_part = (extra - center) / scale
    k, m = len(keys), dense_part.shape[1]

    def times(v):
        return np.bincount(row, v[col], n) + dense_part @ v[k : k + m] + v[-1]

    def back(r):
        return np.concatenate([np.bincount(col, r[row], k), r @ dense_part, [r.sum()]])

    wt = np.where(y > 0, 0.5 * n / pos, 0.5 * n / (n - pos)) ** 0.5
    v, norm = np.ones(k + m + 1), 1.0
    for _ in range(12):  # the largest eigenvalue bounds the curvature
        v = back(wt * times(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = n / (0.3 * norm)
    w = v = np.zeros(k + m + 1)
    w[-1] = v[-1] = np.log(pos / (n - pos))
    t = 1.0
    for _ in range(rounds):
        r = wt * (1 / (1 + np.exp(-np.clip(times(v), -30, 30))) - y) / n
        new = v - step * back(r)
        new[:k] = np.sign(new[:k]) * np.maximum(0, np.abs(new[:k]) - step * l1)
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        if (v - new) @ (new - w) > 0:
            t = 1.0
        v = new + (was - 1) / t * (new - w)
        w = new
    used = np.flatnonzero(w[:k])
    beta = w[k : k + m] / scale
    return Linear(keys[used], w[used], beta, float(w[-1] - beta @ center))


@dataclass
class Chain:
    names: list[str]
    links: list[Linear]
    threshold: float

    def predict(self, rows: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 0))
        for link in self.links:
            p = link.predict(rows, np.hstack([extra, out]))
            out = np.hstack([out, p[:, None]])
        return out


def fit_chain(names: list[str], rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, folds: int = 3) -> Chain:
    """y has a column for each name, in the chain's order; the threshold is that of the last one's best out-of-fold F1."""
    links, before, threshold = [], np.zeros((len(rows), 0)), 0.5
    fold = np.arange(len(rows)) % folds
    for k in range(len(names)):
        given = np.hstack([extra, before])
        links.append(fit(rows, given, y[:, k]))
        out = np.zeros(len(rows))
        for f in range(folds if len(rows) >= folds else 0):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            out[test] = fit([rows[i] for i in train], given[train], y[train, k]).predict([rows[i] for i in test], given[test])
        before = np.hstack([before, out[:, None]])
    if len(rows) and 0 < y[:, -1].sum() < len(rows):
        grid = np.linspace(0.1, 0.9, 33)
        said = before[:, -1][None, :] >= grid[:, None]
        hit = (said & (y[:, -1] > 0)).sum(1)
        f1 = 2 * hit / (said.sum(1) + y[:, -1].sum())
        best = np.flatnonzero(f1 >= f1.max() - 1e-12)
        threshold = float(grid[best[len(best) // 2]])
    return Chain(names, links, threshold)


def _features():
    def rows(given):
        memo: dict[bytes, list[int]] = {}
        for doc_id, text, *labels in given:
            words = text.lower().split()
            distinct = set(words)
            if len(memo) > 300_000:
                memo.clear()
            keys: set[int] = set()
            for w in distinct:
                got = memo.get(w)
                if got is None:
                    got = word_features(w)
                    if len(w) <= 64:
                        memo[w] = got
                keys.update(got)
            yield doc_id, np.sort(np.fromiter(keys, np.int32, len(keys))).tobytes(), np.array(dense(text, words, len(distinct))).tobytes(), *labels

    return rows


def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000) -> Chain:
    """The chain (low quality, then toxic) from at most sample labelled documents.

    Rows without a label, or with a label other than 0 and 1, don't count;
    repeated labels of one document count once.
    """
    spark = docs.sparkSession
    valid = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    valid = valid.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = spark.createDataFrame(valid.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect(), "doc_id long, quality int, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8().alias("text")).join(F.broadcast(chosen), "doc_id")
    made = common.arrow_pass(texts, _features(), "doc_id long, keys binary, dense binary, quality int, toxic int", 256)
    got = {i: (k, d, q, t) for i, k, d, q, t in sorted((tuple(r) for r in made.collect()), key=lambda r: (r[0], bytes(r[1])))}
    names = ["low_quality", "toxic"]
    if not got:
        return Chain(names, [Linear(), Linear()], 0.5)
    order = sorted(got)
    rows = [np.frombuffer(got[i][0], np.int32) for i in order]
    extra = np.array([np.frombuffer(got[i][1]) for i in order]).reshape(len(order), N_DENSE)
    y = np.array([(1 - got[i][2], got[i][3]) for i in order], float)
    return fit_chain(names, rows, extra, y)


class Scorer:
    """The chain on whole texts. It remembers the words it has met, and of those that matter their features."""

    def __init__(self, chain: Chain, limit: int = 400_000):
        self.chain, self.limit, self.met, self.matter, self.features = chain, limit, set(), set(), {}
        self.used = {int(k) for link in chain.links for k in link.keys}
        self.weight = [dict(zip(link.keys.tolist(), link.weights.tolist(), strict=True)) for link in chain.links]

    def keys(self, distinct: set[bytes]) -> set[int]:
        if len(self.met) > self.limit:
            self.met, self.matter, self.features = set(), set(), {}
        for w in distinct - self.met:
            got = [k for k in word_features(w) if k in self.used]
            if got:
                self.features[w] = got
                self.matter.add(w)
            self.met.add(w)
        return {k for w in distinct & self.matter for k in self.features[w]}

    def __call__(self, text: bytes) -> list[float]:
        words = text.lower().split()
        if not words:
            return [0.0] * len(self.chain.links)
        distinct = set(words)
        keys = sorted(self.keys(distinct))
        known, out = dense(text, words, len(distinct)), []
        for link, weight in zip(self.chain.links, self.weight, strict=True):
            z = link.bias
            if len(link.extra):
                z += sum([weight[k] for k in keys if k in weight]) + float(np.dot(known, link.extra))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            known = [*known, out[-1]]
        return out


def _score(chain):
    def rows(given):
        scorer = Scorer(chain.value)
        for doc_id, text in given:
            p = scorer(text)
            yield doc_id, p[0], p[1], p[1] >= chain.value.threshold

    return rows


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Returns doc_id, p_low_quality, p_toxic, toxic, a row for each row of docs.

    A null text is an empty one, and that has no words to be toxic by. Without
    labels of both kinds nothing is toxic. Rows that repeat get the same result
    each; null ids stay null; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # a few thousand weights
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8().alias("text"))
    return common.arrow_pass(texts, _score(sent), "doc_id long, p_low_quality double, p_toxic double, toxic boolean")


def clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of docs, with all their columns, that aren't toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def keeper():
        scorer = Scorer(sent.value)
        return lambda texts: [scorer(t)[1] < sent.value.threshold for t in texts]

    return common.arrow_filter(docs, keeper)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
