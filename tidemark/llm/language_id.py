"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text from left to right and from right to left and gives every byte position a distribution over
languages; a document's probability pools all its positions. Texts are read in windows of STRIDE positions, side by
side, each with CONTEXT further bytes on both sides, so that every position sees what stands around it, over word
ends and window ends alike. The network is trained in numpy by backpropagation through time on windows of a bounded
sample of documents.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import batch, keyed, tidied, utf8_groups
from tidemark.llm.sample import remainder

#: Bounds of the training sample: documents of a language (about this number), windows from each, and windows of a language.
SAMPLE_DOCS, EACH, SAMPLE_WINDOWS = 1000, 8, 8000
HIDDEN, EMBED, STEPS, BATCH, SPAN = 16, 12, 600, 128, 64
STRIDE, CONTEXT, LANES = 96, 16, 1024


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class BiGRU:
    """Parameters: E (256, e); for each direction W (e, 3h), U (h, 3h), b (3h); V (2h, k), c (k)."""

    def __init__(self, classes: int, seed: int = 0, hidden: int = HIDDEN, embed: int = EMBED):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.p = {"E": g(256, embed), "V": g(2 * hidden, classes), "c": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": g(embed, 3 * hidden), f"U{d}": g(hidden, 3 * hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}

    def _direction(self, x, mask, d, keep):
        """x (t, n, e) in reading order. States (t, n, h), and what the way back needs."""
        p, h = self.p, self.h
        s, states, saved = np.zeros((x.shape[1], h), np.float32), [], []
        for t in range(len(x)):
            a, u = x[t] @ p[f"W{d}"] + p[f"b{d}"], s @ p[f"U{d}"]
            z, r = _sigmoid(a[:, :h] + u[:, :h]), _sigmoid(a[:, h : 2 * h] + u[:, h : 2 * h])
            n = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
            m = mask[t][:, None]
            if keep:
                saved.append((s, u, z, r, n, m))
            s = s + m * (1 - z) * (n - s)
            states.append(s)
        return np.stack(states), saved

    def forward(self, codes, mask, keep=False):
        """codes, mask (t, n): log-probabilities (t, n, k)."""
        x = self.p["E"][codes]
        f, sf = self._direction(x, mask, "f", keep)
        b, sb = self._direction(x[::-1], mask[::-1], "b", keep)
        s = np.concatenate([f, b[::-1]], axis=2)
        y = s @ self.p["V"] + self.p["c"]
        y -= y.max(axis=2, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
        return y, (x, s, sf, sb)

    def _back(self, x, saved, ds, d, grad):
        """Gradients of one direction, in its reading order; returns that of x."""
        p, h = self.p, self.h
        W, U = p[f"W{d}"], p[f"U{d}"]
        dx, carry = np.zeros_like(x), np.zeros_like(ds[0])
        for t in range(len(x) - 1, -1, -1):
            s, u, z, r, n, m = saved[t]
            g = ds[t] + carry
            dn, dz = g * m * (1 - z), -g * m * (n - s)
            dan = dn * (1 - n * n)
            daz, dar = dz * z * (1 - z), dan * u[:, 2 * h :] * r * (1 - r)
            da, du = np.concatenate([daz, dar, dan], axis=1), np.concatenate([daz, dar, dan * r], axis=1)
            grad[f"W{d}"] += x[t].T @ da
            grad[f"b{d}"] += da.sum(axis=0)
            grad[f"U{d}"] += s.T @ du
            dx[t] = da @ W.T
            carry = g * (1 - m * (1 - z)) + du @ U.T
        return dx

    def gradients(self, codes, mask, target):
        """Mean loss over the positions, and its gradients."""
        y, (x, s, sf, sb) = self.forward(codes, mask, keep=True)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        total = mask.sum()
        loss = -(np.take_along_axis(y, np.broadcast_to(target[None, :, None], (*mask.shape, 1)), axis=2)[..., 0] * mask).sum() / total
        dy = np.exp(y)
        dy[:, np.arange(len(target)), target] -= 1
        dy *= mask[..., None] / total
        k = dy.shape[2]
        grad["V"] = s.reshape(-1, s.shape[2]).T @ dy.reshape(-1, k)
        grad["c"] = dy.sum(axis=(0, 1))
        ds = dy @ self.p["V"].T
        dx = self._back(x, sf, ds[..., : self.h], "f", grad)
        dx += self._back(x[::-1], sb, ds[::-1, :, self.h :], "b", grad)[::-1]
        np.add.at(grad["E"], codes.ravel(), dx.reshape(-1, dx.shape[2]))
        return loss, grad

    def tables(self) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
        """For each direction and part (two gates, candidate) what a byte and what a state brings into exp: the negative, of the candidate twice."""
        out = {}
        for d in "fb":
            x, u, h = self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"], self.p[f"U{d}"], self.h
            out[d] = [(np.ascontiguousarray(x[:, i * h : (i + 1) * h] * f), np.ascontiguousarray(u[:, i * h : (i + 1) * h] * f)) for i, f in enumerate(np.float32([-1, -1, -2]))]
        return out

    def pooled(self, codes: np.ndarray, tables) -> np.ndarray:
        """Log-probabilities (k, STRIDE, n) of the middle positions of windows, codes (CONTEXT + STRIDE + CONTEXT, n).

        As forward, without a mask, and without the steps after the last middle position of either direction. Gates and
        the candidate are quotients by 1 + exp, which costs half of tanh; an infinite one makes the quotient 0, as it should be.
        """
        h, n, k = self.h, codes.shape[1], len(self.p["c"])
        y, codes = np.empty((STRIDE, n, k), np.float32), codes.astype(np.intp)
        y[:] = self.p["c"]
        z, r, c, x, v = (np.empty((n, m), np.float32) for m in (h, h, h, h, k))
        take = lambda table, t: np.take(table, codes[t], axis=0, out=x, mode="clip")
        for d, order, weights in (("f", range(CONTEXT + STRIDE), self.p["V"][:h]), ("b", range(len(codes) - 1, CONTEXT - 1, -1), self.p["V"][h:])):
            s, ((xz, uz), (xr, ur), (xc, uc)) = np.zeros((n, h), np.float32), tables[d]
            weights = np.ascontiguousarray(weights)
            for t in order:
                for gate, own, u in ((z, xz, uz), (r, xr, ur)):
                    np.matmul(s, u, out=gate)
                    gate += take(own, t)
                    np.exp(gate, out=gate)
                    gate += 1
                np.matmul(s, uc, out=c)
                c /= r
                c += take(xc, t)
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                s -= c
                s /= z
                s += c
                if CONTEXT <= t < CONTEXT + STRIDE:
                    y[t - CONTEXT] += np.matmul(s, weights, out=v)  # small products, for which the library takes one thread and keeps no other one spinning
        y = np.ascontiguousarray(np.moveaxis(y, 2, 0))
        y -= y.max(axis=0)
        y -= np.log(np.exp(y).sum(axis=0))
        return y


def padded(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and mask, (t, n), of spans of bytes."""
    length = np.array([len(w) for w in spans])
    t = int(length.max())
    codes = np.frombuffer(b"".join(w.ljust(t, b"\0") for w in spans), np.uint8).reshape(len(spans), t).T
    return codes, (np.arange(t)[:, None] < length[None, :]).astype(np.float32)


def train(spans: list[bytes], target: np.ndarray, classes: int, steps: int = STEPS, seed: int = 0) -> BiGRU:
    """Adam on batches of spans, of each language as many."""
    net, r = BiGRU(classes, seed), np.random.default_rng(seed + 1)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    weight = 1 / np.bincount(target)[target]
    weight = weight / weight.sum()
    for i in range(1, steps + 1):
        pick = r.choice(len(spans), BATCH, p=weight)
        _, grad = net.gradients(*padded([spans[j] for j in pick]), target[pick])
        rate = 0.01 * min(1, 2 * (1 - i / (steps + 1)))
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.p[k] -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)
    return net


class Reader:
    """Sums of log-probabilities over all positions of texts."""

    def __init__(self, net: BiGRU):
        self.net, self.tables = net, net.tables()

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages); the network reads spaces before and after a text."""
        size = np.array(list(map(len, texts)))
        edge = b" " * (CONTEXT + STRIDE)
        data = np.frombuffer(edge + b"".join(t + edge for t in texts), np.uint8)
        first = np.cumsum(np.r_[len(edge), size[:-1] + len(edge)])
        n = -(-size // STRIDE)
        owner = np.repeat(np.arange(len(texts)), n)
        begin = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        out = np.zeros((len(texts), len(self.net.p["c"])))
        for i in range(0, len(owner), LANES):
            own, at = owner[i : i + LANES], begin[i : i + LANES]
            codes = data[(first[own] + at - CONTEXT)[None, :] + np.arange(STRIDE + 2 * CONTEXT)[:, None]]
            with np.errstate(over="ignore"):
                y = self.net.pooled(codes, self.tables)
            y *= np.arange(STRIDE)[:, None] < (size[own] - at)[None, :]
            np.add.at(out, own, y.sum(axis=1).T)
        return out


OUT = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(model):
    @tidied
    def run(batches):
        languages, net = model.value
        reader = Reader(net) if net else None
        for b in batches:
            for i, j, texts in utf8_groups(b.column(1), 1 << 20):
                read = [k for k, t in enumerate(texts) if reader and any(map(str.isalpha, t.decode()))]
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                if read:
                    total = reader.totals([texts[k] for k in read])
                    best = total.argmax(axis=1)
                    mean = np.exp((total - total.max(axis=1, keepdims=True)) / np.array([len(texts[k]) for k in read])[:, None])
                    scores[read] = mean[np.arange(len(read)), best] / mean.sum(axis=1)
                    for k, x in zip(read, best):
                        names[k] = languages[x]
                yield batch(OUT, b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), b.column(3).slice(i, j - i), names, scores)

    return run


@tidied
def _windows(batches):
    """Spans at places that the text itself draws, from anywhere in it and over its ends; EACH of a text at most."""
    edge = b" " * CONTEXT
    for b in batches:
        for i, j, texts in utf8_groups(b.column(0), 1 << 20):
            out = []
            for t, lang in zip(texts, b.column(1).slice(i, j - i).to_pylist()):
                n, t = min(EACH, -(-len(t) // SPAN)), edge + t + edge
                places = {crc32(t, k) % max(1, len(t) - SPAN + 1) for k in range(n)}
                out += [(lang, t[p : p + SPAN]) for p in sorted(places)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], names=["lang", "span"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> tuple[list[str], BiGRU | None]:
    """Languages and network, from the rows with a language whose remainder is not 2.

    Of each language, about SAMPLE_DOCS rows whose ids and texts hash lowest (all, if there are no more) give EACH windows,
    repeated ones once, of which the SAMPLE_WINDOWS with the lowest hash are taken. So a rare language is learned from
    all its rows, and null or repeated ids stand in nobody's way. Texts stay in the tasks that read them.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id")).where(F.col("lang").isNotNull() & (remainder("doc_id", 4) != 2))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SAMPLE_DOCS).collect()  # one row a language at most
    if sizes:
        shares = docs.sparkSession.createDataFrame([(r.lang, int(SAMPLE_DOCS / r.n * (1 << 40))) for r in sizes], "lang string, below long")
        low = F.shiftrightunsigned(F.xxhash64("doc_id", "lang", "text"), 24) < F.col("below")
        rows = rows.join(F.broadcast(shares), "lang", "left").where(F.col("below").isNull() | low)
    spans = rows.select("text", "lang").mapInArrow(_windows, "lang string, span binary").distinct()
    languages = sorted(r.lang for r in spans.select("lang").distinct().collect())  # one row a language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("span"), "span"))
    found = spans.withColumn("place", place).where(F.col("place") <= SAMPLE_WINDOWS).select("lang", "span").collect() if languages else []
    found = sorted((languages.index(r.lang), bytes(r.span)) for r in found)
    if not found:
        return [], None
    return languages, train([s for _, s in found], np.array([k for k, _ in found]), len(languages))


def identify_language(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, row, held_out, lang_pred, score.

    lang_pred is a language of the training rows, or ``und`` with score 0 where the text is null or has no letter, or
    where there is nothing to learn from; of tied languages the first in the alphabet. The score is the geometric
    mean over all positions of the predicted language's probability, normalised over the languages. Texts of any
    length count whole. Repeated rows get equal values, an empty table an empty result; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text, lang, doc_id))
    source = keyed(docs, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", remainder("doc_id", 4) == 2)
    return source.mapInArrow(_predict(model), "doc_id long, row long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_language(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
