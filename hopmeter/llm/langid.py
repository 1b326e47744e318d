"""Language identification by a convolutional network over bytes.

Filters of widths 2, 3 and 4 run over byte embeddings of fixed-length windows;
the greatest response of each filter feeds a softmax over the languages. The
network is trained in numpy on windows of a bounded sample of labelled texts
(``per_language`` documents for each language on average, ``windows`` windows of
each, spread over the whole text; both bound what the driver holds). A text is
cut into windows from end to end; its probabilities are the means over them,
weighted by the bytes each window really holds.

Prediction uses tables of filter responses for pairs of bytes, so a position
costs two look-ups. Defined cases: a null text, and one without a letter, is
``und`` with score 0, and so is everything if nothing could be learned; rows with
a null language or without a letter aren't learned from; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmeter.llm.common import by_task, fold_bucket

WINDOW = 256
WIDTHS = (2, 3, 4)
LETTER = r"\p{L}"
RESULT = "struct<lang:string,score:double>"


def cut_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes, bytes held, number of the text) of whole texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([-(-len(b) // WINDOW) for b in raw], np.int64)
    data = b"".join(b.ljust(n * WINDOW, b" ") for b, n in zip(raw, counts.tolist()))
    held = np.full(int(counts.sum()), WINDOW, np.int64)
    ends = np.cumsum(counts)
    for b, end in zip(raw, ends.tolist()):
        if b:
            held[end - 1] = len(b) - (len(b) - 1) // WINDOW * WINDOW
    owner = np.repeat(np.arange(len(raw)), counts)
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), held, owner


@dataclass
class ByteNet:
    langs: list[str]
    embed: np.ndarray  # 256 x d
    filters: list[np.ndarray]  # per width: (width * d) x f
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], rng: np.random.Generator, d: int = 8, f: int = 16) -> ByteNet:
        return cls(
            langs, rng.normal(0, 0.5, (256, d)).astype(np.float32),
            [rng.normal(0, (2 / (w * d)) ** 0.5, (w * d, f)).astype(np.float32) for w in WIDTHS],
            np.zeros(f * len(WIDTHS), np.float32),
            rng.normal(0, 0.1, (f * len(WIDTHS), len(langs))).astype(np.float32),
            np.zeros(len(langs), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.dense, self.offset]

    def step(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted cross entropy on a batch."""
        n, d = len(windows), self.embed.shape[1]
        e = self.embed[windows]
        pooled, best = [], []
        for w, k in zip(WIDTHS, self.filters):
            span = WINDOW - w + 1
            out = sum(e[:, j : j + span] @ k[j * d : (j + 1) * d] for j in range(w))
            best.append(out.argmax(axis=1))
            pooled.append(np.take_along_axis(out, best[-1][:, None], 1)[:, 0])
        z = np.concatenate(pooled, axis=1) + self.bias
        h = np.maximum(z, 0)
        logits = h @ self.dense + self.offset
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), target] -= 1
        p *= weight[:, None] / n
        gz = (p @ self.dense.T) * (z > 0)
        g_embed, g_filters = np.zeros_like(self.embed), []
        f = self.filters[0].shape[1]
        for i, (w, k) in enumerate(zip(WIDTHS, self.filters)):
            g = gz[:, i * f : (i + 1) * f]
            gk = np.zeros_like(k)
            for j in range(w):
                # Only the position of the greatest response passes anything back.
                byte = np.take_along_axis(windows, best[i] + j, 1)
                gk[j * d : (j + 1) * d] = np.einsum("nfd,nf->df", self.embed[byte], g)
                np.add.at(g_embed, byte, g[:, :, None] * k[j * d : (j + 1) * d].T[None])
            g_filters.append(gk)
        return [g_embed, *g_filters, gz.sum(axis=0), h.T @ p, p.sum(axis=0)]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses by pair of bytes: width 2; widths 3 and 4, first pair; the same, two bytes on."""
        d = self.embed.shape[1]
        (a0, a1), (b0, b1, b2), (c0, c1, c2, c3) = (
            [self.embed @ k[j * d : (j + 1) * d] for j in range(w)] for w, k in zip(WIDTHS, self.filters)
        )

        def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            return (left[:, None] + right[None]).reshape(65536, -1)

        first = np.concatenate([pair(b0, b1), pair(c0, c1)], axis=1)
        second = np.concatenate([pair(b2, np.zeros_like(b2)), pair(c2, c3)], axis=1)
        return tuple(t.astype(np.float32) for t in (pair(a0, a1), first, second))


class Predictor:
    STEP = 32

    def __init__(self, net: ByteNet):
        self.net, (self.two, self.first, self.second) = net, net.tables()
        f, n = self.two.shape[1], (WINDOW - 1) * self.STEP
        self.room = [np.empty((n, f), np.float32), np.empty((n, 2 * f), np.float32), np.empty((n, 2 * f), np.float32)]

    def windows(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        out, f = np.empty((len(windows), len(self.net.langs))), self.two.shape[1]
        for at in range(0, len(windows), self.STEP):
            part = windows[at : at + self.STEP].T.astype(np.intp)
            n = part.shape[1]
            pairs = (part[:-1] * 256 + part[1:]).ravel()
            a, b, c = (
                np.take(t, i, axis=0, out=r[: len(i)], mode="clip")
                for t, i, r in zip(
                    (self.two, self.first, self.second), (pairs, pairs[: -2 * n], pairs[2 * n :]), self.room
                )
            )
            b += c
            two = a.reshape(-1, n * f).max(axis=0).reshape(n, f)
            more = b.reshape(-1, n * 2 * f).max(axis=0).reshape(n, 2 * f)
            # Width 3 has one place more than the pairs two bytes apart give.
            last = self.first[pairs[-2 * n : -n], :f] + self.second[part[-1] * 256, :f]
            np.maximum(more[:, :f], last, out=more[:, :f])
            h = np.maximum(np.concatenate([two, more], axis=1) + self.net.bias, 0)
            logits = h @ self.net.dense + self.net.offset
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[at : at + n] = p / p.sum(axis=1, keepdims=True)
        return out

    def texts(self, texts: list[str]) -> list[tuple[str, float]]:
        total = np.zeros((len(texts), len(self.net.langs)))
        size = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            # About a megabyte of text at a time; a longer text alone.
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= 1_000_000):
                chars += len(texts[end])
                end += 1
            windows, held, owner = cut_windows(texts[at:end])
            np.add.at(total, at + owner, self.windows(windows) * held[:, None])
            np.add.at(size, at + owner, held)
            at = end
        mean = total / np.maximum(size, 1)[:, None]
        return [
            (self.net.langs[i], min(1.0, float(p[i]))) if n else ("und", 0.0)
            for p, i, n in zip(mean, mean.argmax(axis=1), size)
        ]


def fit(windows: np.ndarray, langs: list[str], epochs: int = 5, batch: int = 64, seed: int = 7) -> ByteNet | None:
    """A network for the given windows and their languages; rare languages weigh more."""
    if not langs:
        return None
    names = sorted(set(langs))
    target = np.searchsorted(names, langs)
    share = np.bincount(target) / len(langs)
    weight = np.minimum(1 / (len(names) * share), 10)[target].astype(np.float32)
    rng = np.random.default_rng(seed)
    net = ByteNet.fresh(names, rng)
    params = net.parameters()
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(langs))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            t += 1
            for p, g, m, s in zip(params, net.step(windows[some], target[some], weight[some]), mean, square):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return net


def labelled_windows(labelled: DataFrame, per_language: int, windows: int) -> tuple[np.ndarray, list[str]]:
    """Training windows of a bounded sample of ``labelled`` (doc_id, text, lang).

    The sample has about ``per_language`` documents of every language, never twice as many,
    so it grows with the number of languages only. It is drawn by a hash of id and text and
    doesn't depend on how the rows are laid out.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))

    def spread(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            all_windows, _, _ = cut_windows([t.as_py() or ""])
            some = np.unique(np.linspace(0, len(all_windows) - 1, windows).astype(int))
            out.append([all_windows[i].tobytes() for i in some])
        return pa.array(out, pa.list_(pa.binary()))

    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rows.withColumn("drawn", drawn).join(counts, "lang").filter(F.col("drawn") * F.col("n") < per_language)
    # About as many as asked for; twice as many at most, those of the least draw.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "doc_id"))
    sample = (
        some.select("drawn", "doc_id", "lang", by_task("array<binary>", lambda: spread)(F.col("text")).alias("w"))
        .withColumn("place", place).filter(F.col("place") <= 2 * per_language).orderBy("lang", "place")
    )
    found = [(w, r["lang"]) for r in sample.collect() for w in r["w"]]
    data = np.frombuffer(b"".join(bytes(w) for w, _ in found), np.uint8).reshape(-1, WINDOW)
    return data, [lang for _, lang in found]


def train(labelled: DataFrame, per_language: int = 500, windows: int = 4) -> ByteNet | None:
    return fit(*labelled_windows(labelled, per_language, windows))


def language(text: Column, net: ByteNet | None) -> Column:
    """Struct (lang, score) of a whole text."""
    und = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    if net is None:
        return und

    def build() -> Callable:
        predictor = Predictor(net)

        def predict(texts: pa.Array) -> pa.Array:
            found = predictor.texts([t.as_py() or "" for t in texts])
            return pa.StructArray.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["lang", "score"],
            )

        return predict

    return F.when(F.coalesce(text, F.lit("")).rlike(LETTER), by_task(RESULT, build)(text)).otherwise(und)


def identify(docs: DataFrame, held_out: int = 2, folds: int = 4, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learned from the other folds of ``docs``."""
    out = fold_bucket(F.col("doc_id"), folds) == held_out
    net = train(docs.filter(~out), **options)
    return docs.select("doc_id", out.alias("held_out"), language(F.col("text"), net).alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score"
    )
