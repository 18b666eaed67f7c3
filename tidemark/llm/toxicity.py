"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel of two strings sums, over the four-letter subsequences that both have, the product of LAMBDA to the
power of the stretch that each takes up; gaps and inserted letters cost a factor, not the match. A string's ends
count as letters. Strings are normalised by the length of their explicit vectors, whose features are numbered by a
hash of 22 bits. Landmarks map a string to the Nyström space of its kernel values
with them, where a linear machine is trained on hinge loss. As kernel, map and machine are linear in the
subsequences, the trained machine is folded into one weight for each of them; scoring then sums the weights of a
string's subsequences and costs a few lookups a letter.

The strings are words, and runs of single letters joined ("i d i o t"); longer ones are cut into overlapping windows
of 20 and of 12 letters, all of which are scored, and the parts of a long joined word ("you-are-such-an-idiot") also by
themselves. Labels are of documents, so the training
words are chosen as multiple instances: words of labelled documents whose counts speak for the label count as
toxic, words of clean documents as clean; words of clean documents that still score high are added as negatives and
the machine is trained again. A word counts once for each pair of neighbours, so that copies of a document do not
make its words look common. A document is as toxic as its highest-scoring string, and a little more for a second
and third.
"""

from __future__ import annotations

from heapq import nlargest
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import batch, keyed, tidied, utf8_groups
from tidemark.llm.sample import first_by_hash, remainder

#: Bounds of the training sample: labelled documents of either label, and words taken from them.
SAMPLE_TOXIC, SAMPLE_CLEAN, TOXIC_WORDS, CLEAN_WORDS = 3000, 5000, 600, 20_000
LAMBDA, ORDER, STRETCH, LONGEST, LANDMARKS, FEATURES = 0.6, 4, 7, 22, 400, 1 << 22
THRESHOLD = 0.7
#: Lengths of the windows of a long string, and how many letters neighbouring ones share.
WINDOWS = ((20, 13), (12, 9))
#: Texts are taken together up to so many bytes; strings are remembered up to so many.
TOGETHER, _CACHE = 1 << 20, 150_000

#: Letters go to codes 3..63 by their place in Unicode; 1 and 2 are the ends, 0 is the padding.
_CODES = np.array([0] * 128 + [29 + i % 35 for i in range(128, 0x3000)], np.uint8)
_CODES[ord("a") : ord("z") + 1] = np.arange(3, 29)
#: Offsets of the later letters of a subsequence within the stretch.
PATTERNS = list(combinations(range(1, STRETCH), ORDER - 1))


def letters(word: str) -> str:
    return "".join(filter(str.isalpha, word))


def windows(string: str) -> list[str]:
    """A string of more than LONGEST - 2 letters as overlapping windows, so that every letter is in some.

    Whatever is no longer than a window's overlap lies whole in one; the smaller windows are for short insults, which
    a long one would drown.
    """
    if len(string) <= LONGEST - 2:
        return [string]
    return [string[i : i + size] for size, overlap in WINDOWS for i in (*range(0, len(string) - size, size - overlap), len(string) - size)]


def pieces_of(word: str) -> list[str]:
    """What of a word is scored: its letters, in windows where they are many, and where it is cut, also its parts between other characters."""
    if word.isalpha() and len(word) <= LONGEST - 2:
        return [word]
    whole = letters(word)
    if len(whole) <= LONGEST - 2:
        return [whole]
    parts = "".join(c if c.isalpha() else " " for c in word).split()
    return [*windows(whole), *(x for p in parts if len(p) < len(whole) for x in windows(p))]


def codes(strings: list[str]) -> np.ndarray:
    """(n, LONGEST) letter codes between the two ends; characters beyond the table count by their remainder."""
    points = np.frombuffer("".join(s.ljust(LONGEST, "\0") for s in strings).encode("utf-32-le"), np.uint32).reshape(-1, LONGEST)
    inner = _CODES[np.where(points < 0x3000, points, 0x3000 - 1 - points % 35)]
    out = np.zeros((len(strings), LONGEST), np.uint32)
    out[:, 0], out[:, 1:] = 1, inner[:, : LONGEST - 1]
    out[np.arange(len(out)), (inner > 0).sum(axis=1) + 1] = 2
    return out


def subsequences(c: np.ndarray):
    """For each pattern the feature number of every place (0 where the string is over) and the kernel weight."""
    for pattern in PATTERNS:
        w = LONGEST - pattern[-1]
        f = c[:, :w]
        for b in pattern:
            f = f * np.uint32(64) + c[:, b : b + w]
        f = (f * np.uint32(2654435761)) >> np.uint32(10)
        yield np.where(c[:, pattern[-1] : pattern[-1] + w] > 0, f, 0), LAMBDA ** (pattern[-1] + 1)


def norms(c: np.ndarray) -> np.ndarray:
    n = (c > 0).sum(axis=1)
    return np.sqrt(np.maximum(1e-9, sum(np.maximum(0, n - p[-1]) * LAMBDA ** (2 * p[-1] + 2) for p in PATTERNS)))


def explicit(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of the kernel's explicit vectors: row, feature, value."""
    c = codes(strings)
    scale, rows, feats, vals = 1 / norms(c), [], [], []
    for f, w in subsequences(c):
        r, p = np.nonzero(f)
        rows.append(r)
        feats.append(f[r, p])
        vals.append(w * scale[r])
    return np.concatenate(rows), np.concatenate(feats), np.concatenate(vals)


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values (n, m)."""
    r, f, v = explicit(landmarks)
    used = np.unique(f)
    a = np.zeros((len(used), len(landmarks)), np.float32)
    np.add.at(a, (np.searchsorted(used, f), r), v)
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    for i in range(0, len(strings), 500):
        r, f, v = explicit(strings[i : i + 500])
        at = np.minimum(np.searchsorted(used, f), len(used) - 1)
        hit = used[at] == f
        b = np.zeros((len(strings[i : i + 500]), len(used)), np.float32)
        np.add.at(b, (r[hit], at[hit]), v[hit])
        out[i : i + 500] = b @ a
    return out


def fold(landmarks: list[str], alpha: np.ndarray) -> np.ndarray:
    """One weight for each subsequence: sum over landmarks of alpha times the landmark's explicit vector."""
    out = np.zeros(FEATURES, np.float32)
    r, f, v = explicit(landmarks)
    np.add.at(out, f, alpha[r] * v)
    return out


def decide(strings: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    c = codes(strings)
    total = np.zeros(len(c))
    for f, w in subsequences(c):
        total += w * weights[f].sum(axis=1)
    return total / norms(c) + bias


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40, seed: int = 0) -> np.ndarray:
    """Dual coordinate descent for hinge loss; cost bounds each row's multiplier. The last column of x is the bias."""
    q, a, w = np.maximum((x * x).sum(axis=1), 1e-9), np.zeros(len(x)), np.zeros(x.shape[1])
    r, live = np.random.default_rng(seed), np.arange(len(x))
    for k in range(rounds):
        moved = np.zeros(len(live), bool)
        r.shuffle(live)
        for j, i in enumerate(live):
            new = min(cost[i], max(0.0, a[i] + (1 - y[i] * (x[i] @ w)) / q[i]))
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i], moved[j] = new, True
        live = np.arange(len(x)) if k % 10 == 9 else live[moved | (a[live] > 0)]
        if not len(live):
            live = np.arange(len(x))
    return w


def places_of(text: str) -> list[tuple[str, int]]:
    """The strings of a text that are scored, with a hash of the neighbours: the letters of its lower-case words of
    three letters or more, and runs of words of one letter, joined; long ones in windows."""
    words = text.lower().split()
    clean = {w: pieces_of(w) for w in set(words)}
    out = {(c, crc32((b + "\n" + d).encode())) for b, w, d in zip(["", *words], words, [*words[1:], ""]) for c in clean[w] if len(c) >= 3}
    return [*out, *((x, 0) for x in spelled(words))]


def spelled(words: list[str]) -> list[str]:
    out, run = [], []
    for w in [*words, ""] if any(len(w) == 1 for w in words) else []:
        x = w if len(w) == 1 else w.strip(".,;:!?-*_")
        if len(x) == 1 and x.isalpha():
            run.append(x)
        else:
            if len(run) >= 3:
                out += windows("".join(run))
            run = []
    return out


def strings_of(text: str) -> list[str]:
    """Distinct strings of a text that are scored."""
    words = text.lower().split()
    out = {x for w in set(words) for x in pieces_of(w)}
    return [w for w in out.union(spelled(words)) if len(w) >= 3]


class Scorer:
    """Decision values of strings, remembered."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def best(self, column: pa.Array) -> list[float]:
        """The highest decision value in each text, plus shares of a second and third above zero; -9 where it has no string."""
        out = []
        for *_, texts in utf8_groups(column, TOGETHER):
            some = [strings_of(t.decode()) for t in texts]
            if len(self.known) > _CACHE:
                self.known.clear()
            new = [w for w in set().union(*some) if w not in self.known]
            for i in range(0, len(new), 8192):
                part = new[i : i + 8192]
                self.known.update(zip(part, decide(part, self.weights, self.bias).tolist()))
            for w in some:
                top = nlargest(3, map(self.known.__getitem__, w))
                out.append(top[0] + sum(max(0.0, x) * c for x, c in zip(top[1:], (0.3, 0.2))) if top else -9.0)
        return out


class Model:
    """weights and bias of the machine; score = logistic(slope * (decision - cut) + logit(THRESHOLD))."""

    def __init__(self, weights, bias, cut=0.0, slope=4.0):
        self.weights, self.bias, self.cut, self.slope = weights, bias, cut, slope

    def score(self, decision):
        z = self.slope * (np.asarray(decision) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def choose_words(counts, n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """Toxic and clean training words of rows (w, toxic, clean): documents of either label that have the word."""
    t, c = np.array([r[1] for r in counts], float), np.array([r[2] for r in counts], float)
    p = n_toxic / max(1, n_toxic + n_clean)
    n = t + c
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(t > 0, t * np.log(t / (n * p)), 0) + np.where(c > 0, c * np.log(c / (n * (1 - p))), 0)
    speaks = (t / n > 0.8) & (gain > np.log(max(2, len(n))))  # as unlikely by chance as one word in all
    order = np.argsort(-gain, kind="stable")
    toxic = [counts[i][0] for i in order if speaks[i]][:TOXIC_WORDS]
    if not toxic:
        toxic = [counts[i][0] for i in order if t[i] >= 1 and t[i] / n[i] > p][:50]
    clean = [counts[i][0] for i in np.argsort(-c, kind="stable") if c[i] > 0 and not speaks[i] and t[i] <= max(1.0, 2 * p * n[i])][:CLEAN_WORDS]
    return toxic, clean


def train(toxic: list[str], clean: list[str], seed: int = 0) -> tuple[np.ndarray, float]:
    """Nyström landmarks from both sides, hinge machine, three rounds of hard negatives; folded weights and bias."""
    toxic, clean = sorted({w for x in toxic if len(w := letters(x)) >= 3}), sorted({w for x in clean if len(w := letters(x)) >= 3})
    clean = sorted(set(clean) - set(toxic))
    if not toxic or not clean:
        return np.zeros(FEATURES), -1.0
    r = np.random.default_rng(seed)
    some = lambda x, k: [x[i] for i in r.choice(len(x), min(k, len(x)), replace=False)]
    negatives, hard = set(some(clean, 1500)), []
    for k in range(4):
        landmarks = some(toxic, LANDMARKS // 2) + hard + some(clean, LANDMARKS // 2 - len(hard))
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(float) + 1e-4 * np.eye(len(landmarks)))
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        strings = toxic + sorted(negatives)
        x = kernel(strings, landmarks) @ root
        x = np.hstack([x, np.full((len(x), 1), 1.0)])
        y = np.r_[np.ones(len(toxic)), -np.ones(len(negatives))]
        w = svm(x, y, np.where(y > 0, 10.0 * max(1, len(negatives) / len(toxic)), 10.0))
        weights, bias = fold(landmarks, root @ w[:-1]), float(w[-1])
        if k < 3:
            value = decide(clean, weights, bias)
            worst = [clean[i] for i in np.argsort(-value)[:600] if value[i] > -1]
            negatives |= set(worst)
            hard = worst[: LANDMARKS * 3 // 8]
    return weights, bias


def calibrate(decision: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """The cut with the least sum of the share of toxic documents missed and three times that of clean ones taken, in the middle of its gap; and a slope."""
    if label.all() or not label.any():
        return 0.0, 4.0
    order = np.argsort(decision, kind="stable")
    d, y = decision[order], label[order].astype(float)
    missed = np.r_[0, np.cumsum(y)] / y.sum()
    false = np.r_[0, np.cumsum(1 - y)] / (1 - y).sum()
    cost = missed + 3 * (1 - false)
    edge = np.r_[d[0] - 1, (d[1:] + d[:-1]) / 2, d[-1] + 1]
    cost[1:-1][d[1:] == d[:-1]] = 9
    return float(edge[int(np.argmin(cost))]), 4.0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """Learns only from labelled rows whose remainder is not 1, and of these from a bounded sample."""
    spark = docs.sparkSession
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1))
    picked = [first_by_hash(known.where(f"toxic = {k}"), n, "doc_id") for k, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    rows = sorted({(r.doc_id, r.toxic) for p in picked for r in p.collect()})  # SAMPLE_TOXIC + SAMPLE_CLEAN at most
    small = F.broadcast(spark.createDataFrame(rows, "doc_id long, toxic int")) if rows else spark.createDataFrame([], "doc_id long, toxic int")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(small, "doc_id")

    @tidied
    def instances(batches):
        for b in batches:
            for i, j, texts in utf8_groups(b.column(0), TOGETHER):
                flat = {(w, c, y) for t, y in zip(texts, b.column(1).slice(i, j - i).to_pylist()) for w, c in places_of(t.decode())}
                w, c, y = zip(*flat) if flat else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(c, pa.int64()), pa.array(y, pa.int32())], names=["w", "c", "toxic"])

    seen = texts.select("text", "toxic").mapInArrow(instances, "w string, c long, toxic int").distinct().groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t + c >= 2")
    counts = [(r.w, r.t, r.c) for x in (seen.where("t > 0").orderBy(F.desc("t"), "w").limit(4 * CLEAN_WORDS), seen.where("t = 0").orderBy(F.desc("c"), "w").limit(CLEAN_WORDS)) for r in x.collect()]
    if not counts:
        return Model(np.zeros(FEATURES), -1.0)
    n_toxic = sum(y for _, y in rows)
    model = Model(*train(*choose_words(counts, n_toxic, len(rows) - n_toxic)))
    decided = texts.select("text", "toxic").mapInArrow(_decisions(spark.sparkContext.broadcast(model)), "decision double, toxic int").toArrow()
    model.cut, model.slope = calibrate(decided.column("decision").to_numpy(), decided.column("toxic").to_numpy() == 1)
    return model


def _decisions(model):
    @tidied
    def run(batches):
        s = Scorer(model.value.weights, model.value.bias)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(s.best(b.column(0)), pa.float64()), b.column(1)], names=["decision", "toxic"])

    return run


OUT = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _scores(model):
    @tidied
    def run(batches):
        s = Scorer(model.value.weights, model.value.bias)
        for b in batches:
            score = model.value.score(s.best(b.column(1)))
            yield batch(OUT, b.column(0), b.column(2), b.column(3), score, (score >= THRESHOLD).astype(np.int32))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, row, held_out, score, predicted.

    Null and empty texts, and texts without a string of three letters, get the lowest score. Rows with a null doc_id
    or without a label are scored and not learned from; a document labelled both ways counts for both. Where nothing
    can be learned, every score is below the threshold. Texts of any length are scored whole. Repeated rows get equal
    scores; words that speak alike are taken in the order of the alphabet, so that a run repeats; an empty table gives
    an empty result; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, doc_id))
    source = keyed(docs, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", remainder("doc_id", 3) == 1)
    return source.mapInArrow(_scores(model), "doc_id long, row long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents, with all their columns, that are not predicted to be toxic; scored and dropped in the scan."""
    model, at = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, doc_id)), docs.columns.index(text)

    @tidied
    def run(batches):
        s = Scorer(model.value.weights, model.value.bias)
        for b in batches:
            yield b.filter(pa.array(model.value.score(s.best(b.column(at))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("row")
