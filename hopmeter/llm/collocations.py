"""Phrases whose words stand together more often than their parts would let expect.

Every pair of words opens a window of up to five words of its piece, and a window is
a path in a HAT-trie: under a language's shallow trie over word ids lie hash
containers of the windows' further words with their counts; a container that grows
too large bursts into one per second word. Beyond ``ENTRIES`` entries a task spills its
largest subtrees. A spilled run is sorted and goes out in one binary per prefix
partition, words of its own dictionary instead of texts: words and pairs to the
partition of the pair, longer windows to that of their first three words, so that
neither a frequent word nor a frequent pair makes a partition large. Each partition
merges its runs; a phrase's count is the sum over the windows it begins. Only
phrases of ``least`` occurrences leave a partition, and since the parts of such a
phrase are as frequent, scores need nothing else.

Most pairs are rare, and no candidate holds a rare pair. A pass before counts pairs in
``BUCKETS`` buckets of their hashes; a window ends before a pair whose bucket has fewer
than ``least``. Two pairs in one bucket only let more through, so counts are exact at any
size, while the bits that tasks get are 2^26 at most. Where the corpus has more than
some hundred times as many pairs as buckets, nearly all pass and the tries do all the work.

What one task holds are the distinct windows of a partition; partitions are as many
as the bytes of text ask for (``PART_BYTES``). A run holds each distinct window once, so a
passage that many documents repeat costs one entry per run.

Defined cases: a null or empty text has no words, a null language is ``und``;
repeated rows count as often as they occur; ties in the ranking are broken by
count and then by the phrase's bytes; texts of any length are read whole. Only the
columns ``text`` and ``lang`` are read. An empty table has no phrases.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmeter.session import cut

LONGEST = 5
#: Windows in a task's tries before subtrees are spilled, and in one hash container before it bursts.
ENTRIES, BURST = 1_000_000, 16_384
#: Words a task knows before it spills all and starts its word ids anew.
WORDS = 1_000_000
#: Bytes of text handled at once, and per prefix partition.
PORTION, PART_BYTES = 4 << 20, 8 << 20
#: Buckets of pairs, and in how many pieces their counts go out.
BUCKETS, PIECES = 1 << 26, 64
#: Rows ranked in one group of the first of two rankings; the second has ``top`` rows of each.
SALTS = 64

_STOPS = bytes.maketrans(b".,;:!?\n\v\f\r", b"." * 10)
_RUN = pa.schema([("part", pa.int32()), ("run", pa.binary())])
_FOUND = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


# -- tries ----------------------------------------------------------------------------


class WordIds(dict):
    """word -> id from 1, given on first sight; 0 ends a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def windows(ids: np.ndarray, often: np.ndarray) -> np.ndarray:
    """(n, 5) windows of two words of ``ids`` and more, zero behind their end; ``often[i]``: words i and i + 1 may go together."""
    padded = np.concatenate([ids, np.zeros(LONGEST, ids.dtype)])
    joined = np.concatenate([often, np.zeros(LONGEST, bool)])
    at = np.flatnonzero(often)
    columns, goes_on = [ids[at]], np.ones(len(at), bool)
    for k in range(1, LONGEST):
        goes_on = goes_on & joined[at + k - 1]
        columns.append(np.where(goes_on, padded[at + k], 0))
    return np.stack(columns, axis=1)


class HatTrie:
    """Counts of windows: first word -> container, or second word -> container once it has burst.

    A container's keys are the last four word ids as bytes, without the zeros at the end.
    """

    def __init__(self):
        self.below: dict[int, Counter | dict[int, Counter]] = {}
        self.entries = 0

    def add(self, found: np.ndarray) -> None:
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        keys = np.ascontiguousarray(found[:, 1:]).view("S16").ravel().tolist()
        for first, a, b in self._groups(found[:, 0], 0, len(found)):
            node = self.below.get(first)
            if node is None:
                node = self.below[first] = Counter()
            if isinstance(node, Counter):
                self._count(node, keys[a:b])
                if len(node) > BURST:
                    self.below[first] = self._burst(node)
            else:
                for second, c, d in self._groups(found[:, 1], a, b):
                    self._count(node.setdefault(second, Counter()), keys[c:d])

    @staticmethod
    def _groups(column: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(value, start, end) of the runs of equal values in ``column[a:b]``."""
        part = column[a:b]
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if b > a else np.zeros(0, np.int64)
        return zip(part[starts].tolist(), (starts + a).tolist(), [*(starts[1:] + a).tolist(), b])

    def _count(self, container: Counter, keys: list[bytes]) -> None:
        before = len(container)
        container.update(keys)
        self.entries += len(container) - before

    @staticmethod
    def _burst(container: Counter) -> dict[int, Counter]:
        node: dict[int, Counter] = {}
        for key, n in container.items():
            node.setdefault(int.from_bytes(key[:4], "little"), Counter())[key] = n
        return node

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """(windows, counts) of the largest subtrees, taken out until at most ``keep`` entries are left."""
        size = lambda node: len(node) if isinstance(node, Counter) else sum(map(len, node.values()))
        sizes = sorted(((size(node), first) for first, node in self.below.items()), reverse=True)
        firsts, lengths, keys, counts = [], [], [], []
        for n, first in sizes:
            if self.entries <= keep:
                break
            node = self.below.pop(first)
            for container in [node] if isinstance(node, Counter) else node.values():
                keys.extend(container)
                counts.extend(container.values())
            firsts.append(first)
            lengths.append(n)
            self.entries -= n
        rest = np.array(keys, "S16").view("<u4").reshape(-1, LONGEST - 1)
        return np.column_stack([np.repeat(np.array(firsts, "<u4"), lengths), rest]), np.array(counts, np.int64)


# -- runs -----------------------------------------------------------------------------


def _summed(rows: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal first ``width`` columns (others dropped to zero) with the sum of their counts, sorted."""
    order = np.lexsort(tuple(rows[:, k] for k in range(width - 1, -1, -1)))
    rows, counts = rows[order], counts[order]
    fresh = np.concatenate(([True], (rows[1:, :width] != rows[:-1, :width]).any(axis=1))) if len(rows) else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    out = np.zeros((len(starts), LONGEST), rows.dtype)
    out[:, :width] = rows[starts, :width]
    return out, np.add.reduceat(counts, starts) if len(starts) else counts


def run_entries(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spilled windows: pairs with their sums, and the windows of three words and more."""
    pairs, pair_counts = _summed(rows, counts, 2)
    longer = rows[:, 2] > 0
    return np.concatenate([pairs, rows[longer]]), np.concatenate([pair_counts, counts[longer]])


def pack_run(sections: list[tuple[str, list[bytes], np.ndarray, np.ndarray]]) -> bytes:
    """A run of (language, words, rows of ids from 1 into the words, counts) as one binary."""
    head, parts = [], []
    for lang, words, rows, counts in sections:
        text = b" ".join(words)
        kind = "<u2" if len(words) < 1 << 16 else "<u4"
        head.append([lang, len(words), len(text), len(rows), kind])
        parts += [text, np.ascontiguousarray(rows.T.astype(kind)).tobytes(), counts.astype("<i8").tobytes()]
    raw = json.dumps(head).encode() + b"\n" + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack_run(run: bytes) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    raw = pa.decompress(run[8:], int.from_bytes(run[:8], "little"), "zstd", asbytes=True)
    at = raw.index(b"\n") + 1
    for lang, n_words, n_text, n_rows, kind in json.loads(raw[: at - 1]):
        words = raw[at : at + n_text].split(b" ") if n_words else []
        at += n_text
        size = np.dtype(kind).itemsize * n_rows * LONGEST
        rows = np.frombuffer(raw[at : at + size], kind).reshape(LONGEST, n_rows).T
        at += size
        yield lang, words, rows, np.frombuffer(raw[at : at + 8 * n_rows], "<i8")
        at += 8 * n_rows


class Words:
    """Word ids of a task and their hashes."""

    def __init__(self):
        self.ids, self.names, self.hashes = WordIds(), [], np.zeros(0, np.uint64)

    def read(self, texts: list[bytes]) -> np.ndarray:
        """Ids of the texts' words, zero between pieces."""
        tokens = b" . ".join(texts).lower().translate(_STOPS).replace(b".", b" . ").split()
        found = np.fromiter(map(self.ids.__getitem__, tokens), "<u4", len(tokens))
        if len(self.names) < len(self.ids):
            fresh = list(islice(self.ids, len(self.names), None))
            self.names += fresh
            made = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))
            self.hashes = np.concatenate([self.hashes, made])
        return found

    def mixed(self, lang: str, *columns: np.ndarray) -> np.ndarray:
        """A hash of the words of each row; zero ids count as no word."""
        mixed = np.full(len(columns[0]), xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")), np.uint64)
        for column in columns:
            mixed = (mixed ^ np.where(column > 0, self.hashes[column], np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return mixed

    def pairs(self, lang: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of words with a next one in their piece, bucket of the pair)."""
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        return at, (self.mixed(lang, ids[at], ids[at + 1]) % np.uint64(BUCKETS)).astype(np.int64)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The texts in portions of one language each."""
    waiting: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            waiting.setdefault(lang.as_py(), []).append(raw)
            size += len(raw)
            if size >= PORTION:
                yield from waiting.items()
                waiting, size = {}, 0
    yield from waiting.items()


def _bucket_counter(least: int):
    """Rows (piece, counts) of the pairs of a task, counts cut off at ``least``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros(BUCKETS, np.uint8)
        for lang, texts in _by_lang(batches):
            _, bucket = words.pairs(lang, words.read(texts))
            bucket, n = np.unique(bucket, return_counts=True)
            counts[bucket] = np.minimum(counts[bucket] + n, min(least, 255))
            if len(words.ids) > WORDS:
                words = Words()
        for i, piece in enumerate(counts.reshape(PIECES, -1)):
            yield pa.RecordBatch.from_pydict({"part": [i], "run": [pa.compress(piece.tobytes(), "zstd", asbytes=True)]}, _RUN)

    return count


def _bucket_bits(least: int):
    """Which buckets of a piece have ``least`` pairs."""
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS // PIECES, np.int64)
        for run in table["run"]:
            raw = pa.decompress(run.as_buffer(), len(total), "zstd", asbytes=True)
            total = np.minimum(total + np.frombuffer(raw, np.uint8), least)
        return pa.table({"part": table["part"].slice(0, 1), "run": [np.packbits(total >= min(least, 255)).tobytes()]}, _RUN)

    return add


def pair_bits(own: DataFrame, least: int) -> bytes:
    """One bit per bucket of pairs: whether they occur ``least`` times together."""
    pieces = own.mapInArrow(_bucket_counter(least), "part int, run binary").groupBy("part").applyInArrow(
        _bucket_bits(least), "part int, run binary"
    )
    found = {r["part"]: bytes(r["run"]) for r in pieces.collect()}
    return b"".join(found.get(i, bytes(BUCKETS // PIECES // 8)) for i in range(PIECES))


class Counting:
    """The tries of a task, one per language, over one set of word ids."""

    def __init__(self, parts: int, bits: bytes):
        self.parts, self.bits = parts, np.frombuffer(bits, np.uint8)
        self.begin()

    def begin(self) -> None:
        self.words, self.tries, self.single = Words(), {}, {}

    def add(self, lang: str, texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """Count the texts; gives the runs that this makes too many."""
        ids = self.words.read(texts)
        at, bucket = self.words.pairs(lang, ids)
        often = np.zeros(len(ids), bool)
        often[at] = self.bits[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8) & 1
        self.tries.setdefault(lang, HatTrie()).add(windows(ids, often))
        single = np.bincount(ids, minlength=len(self.words.ids))
        single[: len(self.single.get(lang, ()))] += self.single.get(lang, single[:0])
        self.single[lang] = single
        if len(self.words.ids) > WORDS:
            yield from self.end()
            self.begin()
        elif sum(t.entries for t in self.tries.values()) > ENTRIES:
            yield from self.spill(ENTRIES // 2)

    def end(self) -> Iterator[tuple[int, bytes]]:
        """All that is left, and the single words."""
        yield from self.spill(0)
        by_lang = {}
        for lang, counts in self.single.items():
            own = np.flatnonzero(counts[1:]) + 1
            rows = np.zeros((len(own), LONGEST), "<u4")
            rows[:, 0] = own
            by_lang[lang] = rows, counts[own].astype(np.int64)
        yield from self.runs(by_lang)

    def spill(self, keep: int) -> Iterator[tuple[int, bytes]]:
        """Runs of the largest subtrees; each language gives in proportion."""
        total = max(1, sum(t.entries for t in self.tries.values()))
        yield from self.runs({
            lang: run_entries(*trie.spill(trie.entries * keep // total)) for lang, trie in self.tries.items()
        })

    def runs(self, by_lang: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
        """(partition, run), words and rows in the order of their bytes."""
        by_part: dict[int, list] = {}
        for lang, (rows, counts) in by_lang.items():
            part = (self.words.mixed(lang, *rows[:, :3].T) % np.uint64(self.parts)).astype(np.int64)
            known = np.unique(rows)
            known = known[known > 0]
            names = [self.words.names[i] for i in known.tolist()]
            order = sorted(range(len(names)), key=names.__getitem__)
            names = [names[i] for i in order]
            rank = np.zeros(len(self.words.names), "<u4")
            rank[known[np.array(order, np.int64)]] = np.arange(1, len(names) + 1)
            rows = rank[rows]
            order = np.lexsort((*(rows[:, k] for k in range(LONGEST - 1, -1, -1)), part))
            rows, counts = rows[order], counts[order]
            ends = np.searchsorted(part[order], np.arange(self.parts + 1))
            for p in np.flatnonzero(np.diff(ends)).tolist():
                own = rows[ends[p] : ends[p + 1]]
                used = np.unique(own)
                used = used[used > 0]
                local = np.searchsorted(used, own, side="left") + 1
                local[own == 0] = 0
                by_part.setdefault(p, []).append(
                    (lang, [names[i - 1] for i in used.tolist()], local, counts[ends[p] : ends[p + 1]])
                )
        for p, sections in by_part.items():
            yield p, pack_run(sections)


def _counter(parts: int, bits: Broadcast):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = Counting(parts, bits.value)

        def out(runs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            for part, run in runs:
                yield pa.RecordBatch.from_pydict({"part": [part], "run": [run]}, _RUN)

        for lang, texts in _by_lang(batches):
            yield from out(tries.add(lang, texts))
        yield from out(tries.end())

    return count


# -- merging ----------------------------------------------------------------------------


def merged(runs: list[bytes], least: int) -> Iterator[tuple[str, int, str, int]]:
    """(lang, size, phrase, count) of phrases of ``least`` occurrences; size 0: how many words a language has here."""
    by_lang: dict[str, list] = {}
    for run in runs:
        for lang, *section in unpack_run(run):
            by_lang.setdefault(lang, []).append(section)
    for lang, sections in by_lang.items():
        words = [b"", *sorted(set().union(*[s[0] for s in sections]))]
        rank = {w: i for i, w in enumerate(words)}
        rows = np.concatenate([
            np.array([0, *map(rank.__getitem__, names)], "<u4")[at] for names, at, _ in sections
        ])
        counts = np.concatenate([c for *_, c in sections])
        short = rows[:, 2] == 0
        yield lang, 0, "", int(counts[rows[:, 1] == 0].sum())
        found = [_summed(rows[short], counts[short], 2)]
        at, n = _summed(rows[~short], counts[~short], LONGEST)
        for width in range(LONGEST, 2, -1):
            at, n = _summed(at, n, width)
            whole = at[:, width - 1] > 0
            found.append((at[whole], n[whole]))
        for at_, n_ in found:
            often = n_ >= least
            for row, f in zip(at_[often].tolist(), n_[often].tolist()):
                phrase = [words[i] for i in row if i]
                yield lang, len(phrase), b" ".join(phrase).decode("utf-8", "surrogatepass"), f


def _merger(least: int):
    def merge(table: pa.Table) -> pa.Table:
        rows = list(merged(table["run"].to_pylist(), least))
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows), _FOUND)], schema=_FOUND)

    return merge


def frequent(docs: DataFrame, least: int) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of up to five words that occur ``least`` times; size 0: all words of a partition."""
    own = docs.filter("text IS NOT NULL").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(64, -(-size // PART_BYTES))
    bits = docs.sparkSession.sparkContext.broadcast(pair_bits(own, least))
    runs = own.mapInArrow(_counter(parts, bits), "part int, run binary")
    return runs.groupBy("part").applyInArrow(_merger(least), "lang string, size int, phrase string, f bigint")


# -- scores -----------------------------------------------------------------------------


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) in whole numbers of up to 38 digits."""
    long = lambda x: x.cast("decimal(16,0)")
    over = F.lit(1000).cast("decimal(4,0)") * long(a) * long(n)
    return F.call_function("div", over, long(l) * long(r))


def mine(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to five words.

    Of a phrase's cuts in two the one of the lowest score counts, the first one among
    equal ones. Phrases inside a longer one that is as frequent go; it is enough to look
    at phrases one word longer, as counts only fall when a phrase grows.
    """
    found = cut(frequent(docs, least), "phrases")
    total = found.filter("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = found.filter("size > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    piece = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    candidates = found.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("first"),
        piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    c = F.col
    scored = cuts.join(total, "lang").select("lang", "phrase", "a", "n", F.struct(
        score(c("a"), c("n"), c("l"), c("r")).alias("score"), "k", "l", "r"
    ).alias("cut"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))

    longer = candidates.filter("size > 2")
    inside = longer.select("lang", c("a").alias("outer"), F.explode(F.array(
        piece(F.lit(1), c("size") - 1), piece(F.lit(2), c("size") - 1),
    )).alias("phrase")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter("outer IS NULL OR outer < a")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")
    for by in (["lang", "salt"], ["lang"]):
        kept = kept.select("lang", "phrase", "a", "l", "r", "n", "score", salt).withColumn(
            "rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")
        ).filter(c("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
