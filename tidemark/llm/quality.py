"""Quality by learning from trusted positives and unlabelled web text.

No text labelled as bad is learned from. With prior p, the share of good texts among the unlabelled ones, the risk of
calling good text bad is p R+(positives), and that of calling bad text good is R-(unlabelled) - p R-(positives). The
second part cannot be negative for the true risk, so it is held at zero (the non-negative risk): where it falls below, the
step goes the other way. The prior is estimated before: over the cuts of a first classifier, the least ratio of the share
of unlabelled texts above a cut to that of positives above it, with a bound on both shares' errors.

A text is read as shares of pairs of character classes (letters by case, digits, blanks, each kind of sign) and of
words that repeat; these are whatever the language. A small network in numpy makes the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import batch, keyed, tidied, utf8_groups
from tidemark.llm.hashing import word_hashes
from tidemark.llm.sample import first_by_hash, remainder

THRESHOLD = 0.3
#: Labelled positives and unlabelled texts that are learned from, at most.
POSITIVES, UNLABELLED = 6000, 12000
HIDDEN, EPOCHS, BATCH, RATE = 24, 60, 512, 0.004
TOGETHER = 2 << 20


def _classes() -> np.ndarray:
    """A class for each byte: letters of other alphabets are all of one class, as is any byte of a longer character."""
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c", "\n\r", ".", ",;:", "!?", "'\"`", "-_/\\", "()[]{}", "|<>=+~^", "#$%&*@"]
    table = np.full(256, len(kinds) + 1, np.int64)
    table[:128] = len(kinds)  # control bytes
    for i, k in enumerate(kinds):
        table[np.frombuffer(k.encode(), np.uint8)] = i
    return table


CLASS = _classes()
KINDS = int(CLASS.max()) + 1
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Shares of class pairs, shares of words equal to the one, two or three before and to any of the same text, long words, the length.
FEATURES = KINDS * KINDS + 7


def features(texts: list[bytes]) -> np.ndarray:
    """One row a text; an empty one has zeros only."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, t in enumerate(texts):
        if not t:
            continue
        data = np.frombuffer(t, np.uint8)
        kind = np.concatenate(([4], CLASS[data], [4]))
        pairs = np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS)
        out[i, : KINDS * KINDS] = np.sqrt(pairs / (len(data) + 1))
        blank = np.concatenate(([True], _BLANK[data], [True]))
        start, end = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
        if len(start):
            h, _ = word_hashes(data, start, end)
            n = len(h)
            again = [np.count_nonzero(h[k:] == h[:-k]) / n for k in (1, 2, 3)]
            # of a text's words, how many pairs of neighbours it has more than once
            two = np.sort(h[1:] ^ (h[:-1] << np.uint64(1)))
            out[i, KINDS * KINDS :] = [*again, np.count_nonzero(two[1:] == two[:-1]) / n, np.count_nonzero(end - start > 24) / n, min(4.0, np.log1p(np.mean(end - start))), np.log1p(n) / 12]
    return out


class Network:
    """One hidden layer over standardised features; the output is a log-odds."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), 1 / (x.std(axis=0) + 0.02)
        d = x.shape[1]
        self.p = [r.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0

    def scaled(self, x):
        return np.clip((x - self.mean) * self.scale, -6, 6)

    def forward(self, z):
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def decide(self, x: np.ndarray) -> np.ndarray:
        return self.forward(self.scaled(x))[1]

    def step(self, z, h, slope, decay: float = 1e-4):
        """One Adam step, where slope is the risk's derivative by each row's output."""
        back = slope[:, None] * self.p[2] * (1 - h * h)
        self.t += 1
        for i, g in enumerate((z.T @ back, back.sum(axis=0), h.T @ slope, slope.sum(keepdims=True))):
            g = g + decay * self.p[i]
            self.m[i] += 0.1 * (g - self.m[i])
            self.v[i] += 0.001 * (g * g - self.v[i])
            self.p[i] -= RATE * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nonnegative(net: Network, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 0) -> Network:
    """Minimises prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) under the logistic loss."""
    r = np.random.default_rng(seed)
    p, u = net.scaled(positive), net.scaled(unlabelled)
    for _ in range(epochs):
        order = r.permutation(len(u))
        for i in range(0, len(u), BATCH):
            some_u, some_p = u[order[i : i + BATCH]], p[r.integers(0, len(p), min(BATCH, len(p)))]
            z, k = np.concatenate([some_p, some_u]), len(some_p)
            h, f = net.forward(z)
            good = sigmoid(f)
            bad_u, bad_p = np.logaddexp(0, f[k:]).mean(), np.logaddexp(0, f[:k]).mean()  # loss of each as a bad text
            slope = np.zeros(len(f))
            if bad_u - prior * bad_p >= 0:
                slope[:k] = prior * (good[:k] - 1) / k - prior * good[:k] / k
                slope[k:] = good[k:] / len(some_u)
            else:  # the part that would be negative is taken back
                slope[:k] = prior * good[:k] / k
                slope[k:] = -good[k:] / len(some_u)
            net.step(z, h, slope)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from decisions on both that were not trained on: the least upper bound
    of the ratio of shares above a cut, over the cuts."""
    n, m = len(positive), len(unlabelled)
    if not n or not m:
        return 0.5
    cut = np.sort(positive)
    above_p = 1 - np.arange(n) / n
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cut, "left") / m
    slack = np.sqrt(np.log(4 / delta) / (2 * m)) + np.sqrt(np.log(4 / delta) / (2 * n))
    at = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[at] / above_p[at], 0.02, 0.98))


class Model:
    """score = logistic of the network's output, which estimates the log-odds of a good text."""

    def __init__(self, net: Network | None, prior: float = 0.5):
        self.net, self.prior = net, prior

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.prior)
        return sigmoid(self.net.decide(features(texts)))


def train(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> Model:
    """The prior by a first network on one half of both, then the network on all."""
    if not len(positive) or not len(unlabelled):
        return Model(None)
    everything = np.concatenate([positive, unlabelled])
    if len(positive) < 8 or len(unlabelled) < 8:
        prior = 0.5
    else:
        first = nonnegative(Network(everything, seed), positive[::2], unlabelled[::2], 0.5, EPOCHS // 3, seed)
        prior = estimate_prior(first.decide(positive[1::2]), first.decide(unlabelled[1::2]))
    return Model(nonnegative(Network(everything, seed + 1), positive, unlabelled, prior, seed=seed + 1), prior)


SAMPLE = pa.schema([("x", pa.list_(pa.float32()))])


@tidied
def _sampled(batches):
    for b in batches:
        for *_, texts in utf8_groups(b.column(0), TOGETHER):
            yield batch(SAMPLE, list(features(texts)))


def _matrix(texts: DataFrame) -> np.ndarray:
    """Features of a bounded sample, in the order of its texts."""
    found = texts.select("text").mapInArrow(_sampled, "x array<float>").toArrow().column("x").combine_chunks()
    x = found.flatten().to_numpy().reshape(len(found), FEATURES)
    return x[np.lexsort(x.T[::-1])].astype(float)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Learns from rows whose remainder is not 0: labelled positives, and texts of which no label is used."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(remainder("doc_id", 5) != 0)
    trusted = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("good")).where("good = 1 AND doc_id IS NOT NULL").where(remainder("doc_id", 5) != 0)
    picked = first_by_hash(trusted.select("doc_id").distinct(), POSITIVES, "doc_id")
    positive = first_by_hash(source.join(F.broadcast(picked), "doc_id", "left_semi"), POSITIVES, "doc_id", "text")
    return train(_matrix(positive), _matrix(first_by_hash(source, UNLABELLED, "doc_id", "text")))


OUT = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _scores(model):
    @tidied
    def run(batches):
        for b in batches:
            score = np.concatenate([model.value.score(texts) for *_, texts in utf8_groups(b.column(1), TOGETHER)] or [np.zeros(0)])
            yield batch(OUT, b.column(0), b.column(2), b.column(3), score, (score >= THRESHOLD).astype(np.int32))

    return run


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, row, held_out, score, predicted.

    Null and empty texts get the score of a text without any feature. Rows with a null doc_id or without a label are
    scored; they may be among the unlabelled texts, never among the positives. A document labelled both ways counts
    as a positive. Where there is no positive or no text to learn from, every score is 0.5. Texts of any length are read
    whole. Repeated rows get equal scores; an empty table gives an empty result; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, doc_id))
    source = keyed(docs, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", remainder("doc_id", 5) == 0)
    return source.mapInArrow(_scores(model), "doc_id long, row long, held_out boolean, score double, predicted int")


def op13_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("row")
