"""Language-model scores by a gated recurrent network.

Counts of all training tokens come first: they give the base score, the most
frequent words, and for all other words the share within their group. The network
predicts *units*: each of the ``UNITS - GROUPS`` most frequent words (the end of a
text among them) is one, all other words fall into ``GROUPS`` units by the hash of
their last letters. Its softmax is factored: a class of units, then the unit
within its class, classes being bins of equal size by frequency. A word's
probability is that of its unit, times its smoothed share of the unit's training
tokens if the unit is a group; so every text, known words or not, gets a
probability, and they add up to at most one.

The gates are trained in numpy by truncated backpropagation on whole documents, however
long: of all training documents, dealt by a hash into shards of about ``fit_tokens`` tokens
(``fit_share`` below 1 takes fewer, to try things out). One shard
trains a network from its random start, then every shard trains that network on in a task
of its own, and the mean of what they come to is the model. The driver holds weights only,
summed up in tasks. Scoring runs over lanes: documents follow each
other in a lane, windows of ``WINDOW`` steps are computed together, and the state
goes on from window to window until the document ends, however long it is.

The counts of the ``head`` most frequent words go to the tasks; the other words of
a document are joined with the count table, by word. Defined cases: a null or empty
text is one end token; a word never seen in training counts as c = 0; without
training documents both scores are those of an empty count table; repeated
documents and null ids are scored row by row.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmeter.llm.common import by_task, fold_bucket
from hopmeter.session import cut

END = b""
CLASSES, PER_CLASS = 16, 16
UNITS, GROUPS = CLASSES * PER_CLASS, 64
HIDDEN, WINDOW, LANES = 16, 64, 384
#: Step size at the begin of training, and of training on.
RATE, RATE_ON = 0.01, 0.003
#: Documents a task holds at once, and tokens it scores together.
BATCH, TOGETHER = 2_000, 2_000_000
ADD = 0.1
#: Different words a task counts before it hands them on, and words it keeps at hand.
FLUSH, KEEP = 300_000, 50_000
PART = "struct<n_tokens:bigint,n_head:bigint,head_log:double,group_log:double,network:double,rare:array<struct<word:string,n:bigint>>>"
_PART = pa.struct([
    ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("head_log", pa.float64()), ("group_log", pa.float64()),
    ("network", pa.float64()), ("rare", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))),
])


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def group_of(word: bytes) -> int:
    """Unit of a word that is no unit itself, by its last two bytes without punctuation."""
    return UNITS - GROUPS + crc32(word.rstrip(b".,;:!?\"')")[-2:]) % GROUPS


# -- counts ----------------------------------------------------------------------


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all tokens; each task adds up before anything is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(seen.items())
            seen.clear()
            for at in range(0, len(items), 50_000):
                some = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w.decode("utf-8", "replace") for w, _ in some], pa.string()),
                     pa.array([n for _, n in some], pa.int64())],
                    ["word", "c"],
                )

        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens_of(text.as_py()))
                if len(seen) > FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """The most frequent words with their counts, and the totals of groups and corpus."""

    counts: dict[bytes, int]
    group_tokens: np.ndarray
    group_words: np.ndarray
    tokens: int
    words: int

    def unit_words(self) -> list[bytes]:
        """Words that are units, most frequent first; the end is always one."""
        ranked = [w for w in self.counts if w != END][: UNITS - GROUPS - 1]
        return sorted([*ranked, END], key=lambda w: -self.counts.get(w, 0))


def head_of(counts: DataFrame, size: int) -> Head:
    """Head of a count table: at most ``size`` words and a row per group are fetched."""
    # Eighths of powers of two that hold no more than ``size`` words together with
    # all above: the driver gets no more rows than that, however many tasks there are.
    step = F.floor(8 * F.log2("c")).cast("int")
    held, least = 0, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > size:
            break
        least = r["step"]
    top = counts.filter(step >= least).orderBy(F.desc("c"), "word").collect() if least is not None else []
    head = {r["word"].encode(): r["c"] for r in top}
    # The end is a unit of its own, also where no word is frequent enough for the head.
    if END not in head and (ends := counts.filter(F.col("word") == END.decode()).first()):
        head[END] = ends["c"]
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    out = Head(head, np.zeros(GROUPS), np.zeros(GROUPS), int(total[0]), int(total[1]))
    units = [w.decode("utf-8", "replace") for w in out.unit_words()]

    def groups(words: pa.Array) -> pa.Array:
        return pa.array([group_of(w.as_py().encode()) - (UNITS - GROUPS) for w in words], pa.int32())

    rest = counts.filter(~F.col("word").isin(units)).select("c", by_task("int", lambda: groups)(F.col("word")).alias("g"))
    for r in rest.groupBy("g").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        out.group_tokens[r["g"]], out.group_words[r["g"]] = r["c"], r["n"]
    return out


class Units:
    """Tokens to units."""

    def __init__(self, head: Head):
        self.of = {w: i for i, w in enumerate(head.unit_words())}
        self.end = self.of[END]
        self.groups: dict[bytes, int] = {}

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        out = list(map(self.of.get, tokens))
        groups = self.groups
        if len(groups) > KEEP:
            groups.clear()
        for i, u in enumerate(out):
            if u is None:
                w = tokens[i]
                if (g := groups.get(w)) is None:
                    g = groups[w] = group_of(w)
                out[i] = g
        return np.array(out, np.uint8)


# -- network ---------------------------------------------------------------------


class Network:
    """Gated recurrent units under a softmax over classes and units within a class."""

    def __init__(self, start: np.ndarray, rng: np.random.Generator):
        """``start``: expected share of each unit, for the biases."""
        h, f = HIDDEN, np.float32
        order = np.argsort(-start, kind="stable")
        self.klass, self.place = np.empty(UNITS, np.int64), np.empty(UNITS, np.int64)
        self.klass[order], self.place[order] = np.divmod(np.arange(UNITS), PER_CLASS)
        share = np.empty((CLASSES, PER_CLASS))
        share[self.klass, self.place] = start
        self.p = {
            "input": rng.normal(0, 0.3, (UNITS, 3 * h)).astype(f),
            "state": rng.normal(0, 1 / math.sqrt(h), (h, 3 * h)).astype(f),
            "class": rng.normal(0, 0.05, (h, CLASSES)).astype(f),
            "class_bias": np.log(share.sum(axis=1)).astype(f),
            "unit": rng.normal(0, 0.05, (CLASSES, h, PER_CLASS)).astype(f),
            "unit_bias": np.log(share / share.sum(axis=1, keepdims=True)).astype(f),
        }

    def weights(self) -> bytes:
        return b"".join(x.tobytes() for x in self.p.values())

    def load(self, weights: bytes) -> None:
        flat, at = np.frombuffer(weights, np.float32), 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).copy()
            at += x.size

    def run(self, given: np.ndarray, keep: np.ndarray, h: np.ndarray, saved: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each step, and the last; ``keep`` is 0 where a document starts."""
        n = HIDDEN
        x = self.p["input"][given]
        states = np.empty((*given.shape, n), np.float32)
        goes_on = keep.all(axis=1)
        for t in range(len(given)):
            before = h if goes_on[t] else h * keep[t][:, None]
            s = before @ self.p["state"]
            gates = x[t, :, : 2 * n]
            gates += s[:, : 2 * n]
            # The logistic function, by way of the faster tanh.
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(x[t, :, 2 * n :] + r * s[:, 2 * n :])
            h = new + z * (before - new)
            states[t] = h
            if saved is not None:
                saved.append((before, s, z, r, new))
        return states, h

    def log_probability(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target unit, from rows of states."""
        klass = self.klass[target]
        order = np.argsort(klass, kind="stable")
        klass, place = klass[order], self.place[target[order]]
        # One column for each row of states: sums over classes then run along memory.
        columns = np.ascontiguousarray(states[order].T)

        def chosen(weights: np.ndarray, bias: np.ndarray, part: slice, want: np.ndarray) -> np.ndarray:
            logits = weights.T @ columns[:, part] + bias[:, None]
            top = logits.max(axis=0)
            picked = logits[want, np.arange(len(want))] - top
            logits -= top
            return picked - np.log(np.exp(logits, out=logits).sum(axis=0))

        found = chosen(self.p["class"], self.p["class_bias"], slice(None), klass)
        ends = np.searchsorted(klass, np.arange(CLASSES + 1))
        for k in range(CLASSES):
            part = slice(ends[k], ends[k + 1])
            if ends[k] < ends[k + 1]:
                found[part] += chosen(self.p["unit"][k], self.p["unit_bias"][k], part, place[part])
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradients(self, given: np.ndarray, target: np.ndarray, keep: np.ndarray, real: np.ndarray, h: np.ndarray):
        """(gradients, last state) of the mean loss over a window; the state before it counts as fixed."""
        p, n, saved = self.p, HIDDEN, []
        states, last = self.run(given, keep, h, saved)
        flat, want = states.reshape(-1, n), target.reshape(-1)
        weight = (real / max(1.0, real.sum())).reshape(-1, 1).astype(np.float32)
        klass, place = self.klass[want], self.place[want]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        rows = np.arange(len(want))
        logits = flat @ p["class"] + p["class_bias"]
        d = np.exp(logits - _log_sum(logits)[:, None])
        d[rows, klass] -= 1
        d *= weight
        g["class"], g["class_bias"] = flat.T @ d, d.sum(axis=0)
        d_states = d @ p["class"].T
        for k in range(CLASSES):
            own = np.flatnonzero(klass == k)
            if len(own):
                inner = flat[own] @ p["unit"][k] + p["unit_bias"][k]
                d = np.exp(inner - _log_sum(inner)[:, None])
                d[np.arange(len(own)), place[own]] -= 1
                d *= weight[own]
                g["unit"][k], g["unit_bias"][k] = flat[own].T @ d, d.sum(axis=0)
                d_states[own] += d @ p["unit"][k].T
        d_states = d_states.reshape(states.shape)
        back = np.zeros_like(h)
        d_input = np.empty((*given.shape, 3 * n), np.float32)
        for t in reversed(range(len(given))):
            before, s, z, r, new = saved[t]
            dh = d_states[t] + back
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (before - new) * z * (1 - z)
            d_r = d_new * s[:, 2 * n :] * r * (1 - r)
            d_s = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_input[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            g["state"] += before.T @ d_s
            back = (dh * z + d_s @ p["state"].T) * keep[t][:, None]
        order = np.argsort(given, axis=None, kind="stable")
        units, firsts = np.unique(given.reshape(-1)[order], return_index=True)
        g["input"][units] = np.add.reduceat(d_input.reshape(-1, 3 * n)[order], firsts, axis=0)
        return g, last


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def lanes(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, the longest first."""
    out: list[list[int]] = [[] for _ in range(max(1, min(width, len(lengths))))]
    heap = [(0, i) for i in range(len(out))]
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (size + int(lengths[d]), i))
    return out


def _laid(docs: list[np.ndarray], end: int, width: int) -> tuple[np.ndarray, ...]:
    """(given, target, keep, number of the document or -1), steps x lanes."""
    dealt = lanes(np.array([len(d) for d in docs]), width)
    steps = max(sum(len(docs[d]) for d in lane) for lane in dealt)
    target = np.full((steps, len(dealt)), end, np.int32)
    keep = np.ones((steps, len(dealt)), np.float32)
    number = np.full((steps, len(dealt)), -1, np.int32)
    for i, lane in enumerate(dealt):
        at = 0
        for d in lane:
            size = len(docs[d])
            target[at : at + size, i], number[at : at + size, i], keep[at, i] = docs[d], d, 0
            at += size
    given = np.full_like(target, end)
    given[1:] = target[:-1]
    given[keep == 0] = end
    return given, target, keep, number


def train(docs: list[np.ndarray], end: int, start: np.ndarray, updates: int = 600_000,
          width: int = 32, window: int = 32, seed: int = 5, weights: bytes | None = None) -> Network:
    """Network fitted to unit sequences, in about ``updates`` token steps but all of ``docs``; trained on from ``weights``."""
    rng = np.random.default_rng(seed)
    net = Network(start, rng)
    if weights is not None:
        net.load(weights)
    most = RATE if weights is None else RATE_ON
    total = sum(map(len, docs))
    if not total:
        return net
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    t, epochs = 0, max(1, min(20, round(updates / total)))
    for epoch in range(epochs):
        given, target, keep, number = _laid([docs[i] for i in rng.permutation(len(docs))], end, width)
        h = np.zeros((given.shape[1], HIDDEN), np.float32)
        for at in range(0, len(given), window):
            part = slice(at, at + window)
            g, h = net.gradients(given[part], target[part], keep[part], number[part] >= 0, h)
            t += 1
            norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
            done = (epoch + at / len(given)) / epochs
            rate = (most * (1 - done) + most / 20) * min(1.0, 1.0 / max(norm, 1e-9))
            for k, p in net.p.items():
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.005 * (g[k] * g[k] - square[k])
                p -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.995**t)) + 1e-8)
    return net


def _windows(docs: list[np.ndarray], end: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(given, target, keep, number) of one window after the other, over the lanes still going on.

    Lanes come longest first, so those that go on are the first ones. Only one
    window is laid out at a time, however long a document is.
    """
    dealt = lanes(np.array([len(d) for d in docs]), width)
    dealt.sort(key=lambda lane: -sum(len(docs[d]) for d in lane))
    tokens = [np.concatenate([docs[d] for d in lane]) for lane in dealt]
    owner = [np.repeat(np.array(lane, np.int32), [len(docs[d]) for d in lane]) for lane in dealt]
    for at in range(0, len(tokens[0]), WINDOW):
        live = sum(len(t) > at for t in tokens)
        shape = (min(WINDOW, len(tokens[0]) - at), live)
        target, given = np.full(shape, end, np.int32), np.full(shape, end, np.int32)
        number, keep = np.full(shape, -1, np.int32), np.ones(shape, np.float32)
        for i in range(live):
            t, o = tokens[i], owner[i]
            n = min(WINDOW, len(t) - at)
            first = max(at - 1, 0)
            target[:n, i], number[:n, i] = t[at : at + n], o[at : at + n]
            given[n - (at + n - 1 - first) : n, i] = t[first : at + n - 1]
            fresh = np.flatnonzero(o[at - 1 : at + n - 1] != o[at : at + n]) if at else np.append(
                0, np.flatnonzero(o[: n - 1] != o[1:n]) + 1
            )
            keep[fresh, i], given[fresh, i] = 0, end
        yield given, target, keep, number


def score_units(net: Network, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log probability of each unit sequence, whole."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    h = np.zeros((LANES, HIDDEN), np.float32)
    for given, target, keep, number in _windows(docs, end, LANES):
        states, h = net.run(given, keep, h[: given.shape[1]])
        who = number.reshape(-1)
        real = who >= 0
        logp = net.log_probability(states.reshape(-1, HIDDEN)[real], target.reshape(-1)[real])
        out += np.bincount(who[real], weights=logp, minlength=len(docs))
    return out


# -- scores -----------------------------------------------------------------------


def _sample(training: DataFrame, head: Head, fit_tokens: int, fit_share: float) -> tuple[DataFrame, int]:
    """(shard, drawn, doc_id, u) of the training documents, or a share of them, with their unit sequences, and the number of shards."""
    wanted = min(head.tokens, max(fit_tokens, round(fit_share * head.tokens)))
    shards = max(1, round(wanted / fit_tokens))

    def build() -> Callable:
        units = Units(head)
        return lambda texts: pa.array([units(tokens_of(t.as_py())).tobytes() for t in texts], pa.binary())

    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shard = F.pmod(F.xxhash64("text", "doc_id", F.lit("shard")), F.lit(shards)).cast("int")
    rows = training.select("doc_id", "text", drawn.alias("drawn")).filter(F.col("drawn") < wanted / max(1, head.tokens))
    return cut(
        rows.select(shard.alias("shard"), "drawn", "doc_id", by_task("binary", build)(F.col("text")).alias("u")), "lm-sample",
    ), shards


WEIGHTS = "tokens bigint, weights binary"


def _fitted(rows: DataFrame, end: int, start: np.ndarray, weights: bytes | None, updates: int) -> DataFrame:
    """(tokens, weights) of a network trained on each shard of ``rows``."""
    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("drawn", "ascending"), ("doc_id", "ascending")])
        docs = [np.frombuffer(u, np.uint8).astype(np.int64) for u in table["u"].to_pylist()]
        net = train(docs, end, start, updates, width=32 if weights is None else 64, weights=weights)
        return pa.table({"tokens": [sum(map(len, docs))], "weights": pa.array([net.weights()], pa.binary())})

    return rows.groupBy("shard").applyInArrow(fit, WEIGHTS)


def _mean(fitted: DataFrame) -> bytes | None:
    """Mean of the weights by tokens, summed up in eight tasks."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = 0, 0.0
        for batch in batches:
            for n, w in zip(batch["tokens"].to_pylist(), batch["weights"]):
                tokens += n
                total = total + n * np.frombuffer(w.as_buffer(), np.float32).astype(np.float64)
        if tokens:
            yield pa.RecordBatch.from_pydict({"tokens": [tokens], "weights": pa.array([total.tobytes()], pa.binary())})

    sums = [(r["tokens"], np.frombuffer(bytes(r["weights"]))) for r in fitted.repartition(8).mapInArrow(add, WEIGHTS).collect()]
    if not sums:
        return None
    return (sum(x for _, x in sums) / sum(n for n, _ in sums)).astype(np.float32).tobytes()


def fit_network(
    training: DataFrame, head: Head, end: int, start: np.ndarray, fit_tokens: int, fit_share: float
) -> Network:
    rows, shards = _sample(training, head, fit_tokens, fit_share)
    weights = _mean(_fitted(rows.filter("shard = 0"), end, start, None, 600_000))
    if shards > 1:
        weights = _mean(_fitted(rows, end, start, weights, 0)) or weights
    net = train([], end, start)
    if weights is not None:
        net.load(weights)
    return net


def describe(text: Column, head: Head, net: Network) -> Column:
    """Struct of what a text's score needs: counts of the head, group shares, network, other words."""
    def build() -> Callable:
        units = Units(head)
        grouped = {w for w in head.counts if w not in units.of}
        log_count = {w: math.log10(c + ADD) for w, c in head.counts.items()}
        norm = np.zeros(UNITS)
        norm[UNITS - GROUPS :] = np.log10(head.group_tokens + ADD * (head.group_words + 1))

        def of(texts: pa.Array) -> pa.Array:
            numbers: list[tuple] = []
            network: list[np.ndarray] = []
            held: list[np.ndarray] = []
            words: list[bytes] = []
            counts: list[int] = []
            parts: list[tuple[pa.Array, pa.Array]] = []
            ends, size = [0], 0

            def score_held() -> None:
                network.append(score_units(net, held, units.end) / math.log(10))
                held.clear()

            def pack_rare() -> None:
                parts.append((pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())))
                words.clear()
                counts.clear()

            for t in texts:
                tokens = tokens_of(t.as_py())
                seen = Counter(tokens)
                known = seen.keys() & log_count.keys()
                of_units = units(tokens)
                # The share of a word in its group: count over total; counts of rare words come later.
                in_group = [w for w in known if w in grouped]
                numbers.append((
                    len(tokens),
                    sum(seen[w] for w in known),
                    math.fsum(seen[w] * log_count[w] for w in known),
                    math.fsum(seen[w] * log_count[w] for w in in_group)
                    - float(np.bincount(of_units, minlength=UNITS) @ norm),
                ))
                rare = [w for w in seen if w not in known]
                words.extend(rare)
                counts.extend(map(seen.__getitem__, rare))
                ends.append(ends[-1] + len(rare))
                if len(words) > KEEP:
                    pack_rare()
                held.append(of_units)
                size += len(tokens)
                if size > TOGETHER:
                    score_held()
                    size = 0
            score_held()
            pack_rare()
            columns = list(zip(*numbers)) or [()] * 4
            rare_words = pa.StructArray.from_arrays(
                [pa.concat_arrays([w for w, _ in parts]), pa.concat_arrays([n for _, n in parts])], ["word", "n"]
            )
            return pa.StructArray.from_arrays(
                [
                    *[pa.array(c, f.type) for c, f in zip(columns, _PART)],
                    pa.array(np.concatenate(network)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare_words),
                ],
                [f.name for f in _PART],
            )

        return of

    return by_task(PART, build)(text)


def score(
    docs: DataFrame, held_out: int = 0, folds: int = 10, head_words: int = 50_000, fit_tokens: int = 1_000_000,
    fit_share: float = 1.0,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    with _small_batches(docs.sparkSession):
        return _score(docs, held_out, folds, head_words, fit_tokens, fit_share)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer documents at once in a Python task, for the jobs run here; the session gets its setting back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    saved = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(key) if saved is None else spark.conf.set(key, saved)


def _score(
    docs: DataFrame, held_out: int, folds: int, head_words: int, fit_tokens: int, fit_share: float
) -> DataFrame:
    out = fold_bucket(F.col("doc_id"), folds) == held_out
    training = docs.filter(~out)
    counts = cut(token_counts(training), "token-counts")
    head = head_of(counts, head_words)
    units = head.unit_words()
    start = np.full(UNITS, 0.5)
    start[: len(units)] += [head.counts.get(w, 0) for w in units]
    start[UNITS - GROUPS :] += head.group_tokens
    net = fit_network(training, head, units.index(END), start / start.sum(), fit_tokens, fit_share)
    parts = cut(
        docs.select(
            "doc_id", out.alias("held_out"), F.monotonically_increasing_id().alias("row"),
            describe(F.col("text"), head, net).alias("d"),
        ),
        "lm-parts",
    )
    rare = parts.select("row", F.explode("d.rare").alias("r")).select("row", "r.word", "r.n")
    seen = F.coalesce("c", F.lit(0))
    sums = (
        rare.join(counts, "word", "left").groupBy("row")
        .agg(F.sum(F.col("n") * F.log10(seen + ADD)).alias("rare_log"), F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("n_rare"))
    )
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    total = F.lit(math.log10(head.tokens + ADD * (head.words + 1)))
    return parts.join(sums, "row", "left").select(
        "doc_id", "held_out", F.col("d.n_tokens").alias("n_tokens"),
        (F.col("d.n_head") + F.coalesce("n_rare", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(head.tokens).cast("bigint").alias("train_tokens"),
        (F.col("d.head_log") + rare_log - F.col("d.n_tokens") * total).alias("base_score"),
        (F.col("d.network") + F.col("d.group_log") + rare_log).alias("score"),
    )
