"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints (64 bits, over hashes of word shingles) link at few differing bits.
For a limit of 3, one of four 16-bit blocks is equal in both. The other 48 bits
form two halves of 24; at most 3 errors leave one half with at most one. 23 bits
of a half are decoded by the binary Golay code: a word's own index, and the
indices of all words one bit away (at most 6 different ones). If two words differ
in at most one bit, the index of the one is among the indices of the other. So
each fingerprint has 8 plain keys (block, half) and at most 48 fuzzy ones of 28
bits, and every linked pair meets in a join of fuzzy with plain keys, where it
is verified at once.

Work is on distinct fingerprints, so groups of copies cost one row each.

``keep_one``, made for choosing one document of a group, also links documents whose
five-word shingles have a Jaccard similarity of 0.8 or more; those differ in too
many bits for the limit above. Their distinct words hardly differ, though, so the
same keys are taken from ``WORD_PRINTS`` fingerprints over single words, where documents
with changes here and there meet nearly always; those that differ in a long run of
words meet in one of five bands of least shingle hashes (recall: README). To keep large groups of
near copies from making all their pairs, a key's fingerprints are first compared
with one of them, in rounds; what these connect needs no more comparison, and all
other pairs that share a key are then compared: pair by pair where a key brings few
of them together, and else in blocks. A family, that is all that hangs together by such
crowded keys, is dealt into blocks, and two blocks are compared in one task by a
product of their tables of shingles, which gives only links between classes. The ``SKETCH``
smallest shingle hashes of both tell which pairs are far from similar (five standard
errors below the limit); the others are judged by all shingles of their texts.

Components come from contraction to the smallest neighbour, in tables of links.
Defined cases: a null or empty text has fingerprint zero and links like any
other; fewer words than a shingle: the whole sequence is one shingle; repeated
documents share a component; a null id is ignored as a component's name unless
no other is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmeter.llm.common import by_task
from hopmeter.llm.components import components
from hopmeter.session import cut, settle

LIMIT = 3
SEED = 42
WORD_PRINTS, SKETCH, SIMILAR, SIMILAR_WORDS = 3, 128, 0.8, 5
#: Pairs whose sketches are less similar aren't looked at: five standard errors of a sketch below ``SIMILAR``.
ROUGH = SIMILAR - 5 * (SIMILAR * (1 - SIMILAR) / SKETCH) ** 0.5
#: A round of comparisons with one of each key is many links if it adds a link for every so many fingerprints.
MANY = 100
#: Keys of more labels than this, or more pairs of different labels than that, are compared in blocks of so many
#: members, so many shingles at a time.
CROWD, CROWD_PAIRS, BLOCK, COLUMNS = 32, 256, 256, 4096
#: Odd factors, which are orders of 64-bit hashes; two of them make a band. Texts of the
#: similarity 0.8 share the least hashes of a band in 64 of 100 cases, and of one of five in 99.
ORDERS = [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 11)]
BLOCKS, BLOCK_BITS, WORD_BITS = 4, 16, 23
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


# -- fingerprints -------------------------------------------------------------


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingle_hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, repeats included, in portions."""
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    first, last = starts[:n].tolist(), ends[k - 1 :].tolist()
    for at in range(0, n, 65536):
        yield np.array([
            digest(line[a:b], SEED) for a, b in zip(first[at : at + 65536], last[at : at + 65536])
        ], dtype="<u8")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (rows of bytes) have each bit."""
    return np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a whole text."""
    words = _words(text)
    ones, n = np.zeros(64, np.int64), 0
    for h in _shingle_hashes(words, shingle) if words else ():
        ones += _ones(h.view(np.uint8).reshape(-1, 8))
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


class WordHashes(dict):
    """word -> 8 * WORD_PRINTS bytes, filled on demand."""

    def __missing__(self, word: bytes) -> bytes:
        found = b"".join(
            xxhash.xxh64_digest(word, SEED + 1 + i) for i in range(WORD_PRINTS)
        )
        if len(self) < 200_000:
            self[word] = found
        return found


def word_prints(words: list[bytes], hashes: WordHashes) -> list[int]:
    """Signed fingerprints over the distinct words."""
    own = list(set(words))
    ones = np.zeros(64 * WORD_PRINTS, np.int64)
    for at in range(0, len(own), 65536):
        raw = b"".join(map(hashes.__getitem__, own[at : at + 65536]))
        ones += _ones(np.frombuffer(raw, np.uint8).reshape(-1, 8 * WORD_PRINTS))
    return np.packbits(2 * ones > len(own), bitorder="little").view("<i8").tolist()


def shingle_set(words: list[bytes], shingle: int = SIMILAR_WORDS) -> np.ndarray:
    """The distinct hashes of all shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *(_shingle_hashes(words, shingle) if words else ())]))


def sketch_of(hashes: np.ndarray) -> list[int]:
    """The smallest of the upper halves of a ``shingle_set``, as distinct ints in order."""
    least = np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:SKETCH]
    return (least.astype(np.int64) - 2**31).tolist()


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Fingerprint as a (signed) long column."""

    def of(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint_of(t.as_py(), shingle) for t in texts], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    return by_task("bigint", lambda: of)(text)


def bands_of(hashes: np.ndarray) -> list[int]:
    """Keys of a ``shingle_set``: per band the least hashes under two orders of their own."""
    if not len(hashes):
        return []
    least = [int((hashes * np.uint64(odd)).min()) for odd in ORDERS]
    pairs = (b"%d %d" % pair for pair in zip(least[::2], least[1::2]))
    return [1 << 45 | band << 41 | xxhash.xxh64_intdigest(pair, SEED) >> 23 for band, pair in enumerate(pairs)]


PRINTS = "struct<fp:bigint,words:array<bigint>,bands:array<bigint>,sketch:array<int>,n:bigint>"
_PRINTS = pa.struct([
    ("fp", pa.int64()), ("words", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())),
    ("sketch", pa.list_(pa.int32())), ("n", pa.int64()),
])


def prints(text: Column, shingle: int = 3) -> Column:
    """Struct of the fingerprint, those over words, and the sketch of a whole text."""
    def build() -> Callable:
        hashes = WordHashes()

        def one(text: str | None) -> dict:
            words = _words(text)
            fp = fingerprint_of(text, shingle)
            own = shingle_set(words)
            return {
                "fp": fp - (fp >> 63 << 64), "words": word_prints(words, hashes), "bands": bands_of(own),
                "sketch": sketch_of(own), "n": len(own),
            }

        return lambda texts: pa.array([one(t.as_py()) for t in texts], _PRINTS)

    return by_task(PRINTS, build)(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# -- Golay keys -----------------------------------------------------------------


def _remainder(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(WORD_BITS - 1, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << bit - 11, 0)
    return words


def _errors() -> np.ndarray:
    """Error pattern of every remainder; the code is perfect, so each has one."""
    bits = [1 << i for i in range(WORD_BITS)]
    patterns = [0, *bits]
    patterns += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    patterns += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    patterns = np.array(patterns, np.int64)
    table = np.zeros(2048, np.int64)
    table[_remainder(patterns)] = patterns
    return table


class Golay:
    def __init__(self):
        self.errors = _errors()
        self.bits = np.array([0, *(1 << i for i in range(WORD_BITS))], np.int64)
        self.shift = _remainder(self.bits)
        self.low = _remainder(np.arange(4096, dtype=np.int64))
        self.high = _remainder(np.arange(2048, dtype=np.int64) << 12)

    def index(self, words: np.ndarray) -> np.ndarray:
        """12-bit index of the codeword within three bits."""
        rest = self.low[words & 4095] ^ self.high[words >> 12]
        return (words ^ self.errors[rest]) >> 11

    def near(self, words: np.ndarray) -> np.ndarray:
        """(n, 24) indices of the words at most one bit away."""
        rest = (self.low[words & 4095] ^ self.high[words >> 12])[:, None] ^ self.shift
        return (words[:, None] ^ self.bits ^ self.errors[rest]) >> 11


def segments(fps: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, equal block, 23-bit word) for each block and half of the rest."""
    out = []
    for b in range(BLOCKS):
        block = (fps >> np.uint64(BLOCK_BITS * b) & np.uint64(0xFFFF)).astype(np.int64)
        low = fps & np.uint64((1 << BLOCK_BITS * b) - 1)
        high = fps >> np.uint64(BLOCK_BITS * b) >> np.uint64(BLOCK_BITS)
        rest = low | high << np.uint64(BLOCK_BITS * b)
        for half in range(2):
            word = (rest >> np.uint64(24 * half) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
            out.append((2 * b + half, block, word))
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    """(n, m) keys as lists without repeats."""
    rows = np.sort(rows, axis=1)
    fresh = np.ones(rows.shape, bool)
    fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
    offsets = np.concatenate(([0], np.cumsum(fresh.sum(axis=1)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[fresh]))


def golay_keys(fp: Column, fuzzy: bool) -> Column:
    """Array of keys of a fingerprint: own indices, or those of near words too."""
    def build() -> Callable:
        code = Golay()

        def keys(fps: pa.Array) -> pa.Array:
            values = fps.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            parts = []
            for kind, block, word in segments(values):
                index = code.near(word) if fuzzy else code.index(word)[:, None]
                parts.append((kind << 28 | block << 12)[:, None] | index)
            return _lists(np.concatenate(parts, axis=1))

        return keys

    return by_task("array<bigint>", build)(fp)


# -- links and components ---------------------------------------------------------


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b, of the distinct values of ``fp`` that differ in at most 3 bits."""
    fuzzy = fps.select(F.col("fp").alias("a"), F.explode(golay_keys(F.col("fp"), True)).alias("key"))
    plain = fps.select(F.col("fp").alias("b"), F.explode(golay_keys(F.col("fp"), False)).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LIMIT
    return fuzzy.join(plain, "key").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sketches: the share of both in the smallest of their union."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(a, b), least)) / F.greatest(F.size(least), F.lit(1))


def _of_similar_size(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can have a Jaccard similarity of ``SIMILAR``."""
    return (a >= b * SIMILAR - 1e-6) & (b >= a * SIMILAR - 1e-6)


def _word_keys(at: DataFrame, fuzzy: bool) -> DataFrame:
    """(fp, key) of ``at`` (fp, words, bands)."""
    def of_print(i: int) -> Column:
        return F.transform(golay_keys(F.col("words")[i], fuzzy), lambda key: key + F.lit(i << 40))

    keys = F.concat(*map(of_print, range(WORD_PRINTS)), "bands")
    return at.select("fp", F.explode(keys).alias("key"))


def shared_keys(at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fuzzy and plain keys of ``at`` (fp, words, bands), each (fp, key), without those that bring nobody together.

    A fuzzy key goes if no other fingerprint has it as a plain one, which holds for nearly all of them; a plain
    key, if no fuzzy one of another fingerprint is left. They depend on no label, so all rounds go on from these tables.
    """
    plain = _word_keys(at, False)
    ends = plain.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most"))
    asks = cut(
        _word_keys(at, True).join(ends, "key").filter((F.col("least") != F.col("fp")) | (F.col("most") != F.col("fp"))).select("fp", "key"),
        "fp-asks",
    )
    return asks, cut(plain.join(asks.select("key").distinct(), "key", "left_semi"), "fp-members")


Sides = tuple[DataFrame, DataFrame]


def _sides(at: DataFrame, keys: Sides | None = None) -> Sides:
    """Fuzzy and plain ``keys`` with what ``at`` has of their fingerprints: (fp, label, n, key) each."""
    labels = at.select("fp", "label", "n")
    asks, members = (side.join(labels, "fp").select("fp", "label", "n", "key") for side in keys or shared_keys(at))
    return asks, members


def _renamed(frame: DataFrame, end: str) -> DataFrame:
    return frame.select(*[F.col(c).alias(c if c == "key" else f"{c}_{end}") for c in frame.columns])


def _met_once(sides: Sides, turn: int) -> DataFrame:
    """Pairs of each fingerprint with one of another label for each of its keys; another one every ``turn``."""
    asks, members = sides
    drawn = F.struct(F.xxhash64("fp", F.lit(turn)).alias("draw"), "fp", "label", "n")
    one = members.groupBy("key").agg(F.min(drawn).alias("one")).select("key", "one.fp", "one.label", "one.n")
    return _pairs(_renamed(asks, "a").join(_renamed(one, "b"), "key"))


def _met_all(at: DataFrame, crowded: DataFrame, sides: Sides | None = None) -> DataFrame:
    """All pairs of fingerprints that share a key which is not ``crowded`` (key) and have different labels.

    A key's labels are joined first and their members then, so that fingerprints of
    one label never meet, however many there are.
    """
    asks, members = sides or _sides(at)
    plain = _renamed(members, "b").join(crowded, "key", "left_anti")
    labels = plain.groupBy("key", "label_b").agg(F.min("n_b").alias("least"), F.max("n_b").alias("most"))
    fuzzy = _renamed(asks, "a").join(labels, "key").filter(
        (F.col("label_a") != F.col("label_b"))
        & (F.col("most") >= F.col("n_a") * SIMILAR - 1e-6) & (F.col("n_a") >= F.col("least") * SIMILAR - 1e-6)
    )
    return _pairs(fuzzy.join(plain, ["key", "label_b"]))


def _crowded(at: DataFrame, sides: Sides | None = None) -> DataFrame:
    """Keys with more than ``CROWD`` labels, or that bring together more than ``CROWD_PAIRS`` pairs of different labels.

    The second are keys of large classes: each of their members would meet all fingerprints that share the key.
    """
    asks, members = (
        side.select("key", "label", F.lit(fuzzy).alias("fuzzy")) for side, fuzzy in zip(sides or _sides(at), (True, False))
    )
    labels = asks.union(members).groupBy("key", "label").agg(
        F.count_if("fuzzy").cast("double").alias("asks"), F.count_if(~F.col("fuzzy")).cast("double").alias("members")
    )
    keys = labels.groupBy("key").agg(
        F.count_if(F.col("members") > 0).alias("n"),
        (F.sum("asks") * F.sum("members") - F.sum(F.col("asks") * F.col("members"))).alias("pairs"),
    )
    return keys.filter((F.col("n") > CROWD) | (F.col("pairs") > CROWD_PAIRS)).select("key")


def _families(sides: Sides, crowded: DataFrame) -> DataFrame:
    """(fp, family) of the fingerprints that share a crowded key, directly or over others.

    Each member is linked with one of its key, so the links are as many as the members.
    """
    asks, members = sides
    plain = members.join(crowded, "key", "left_semi")
    one = plain.groupBy("key").agg(F.min("fp").alias("one"))
    stars = asks.join(one, "key").select(F.col("fp").alias("a"), F.col("one").alias("b"))
    return components(cut(stars.distinct(), "fp-stars")).select(F.col("node").alias("fp"), F.col("label").alias("family"))


def shingle_binary(text: Column) -> Column:
    """The distinct shingle hashes of a whole text as a binary."""
    def build() -> Callable:
        return lambda texts: pa.array([shingle_set(_words(t.as_py())).tobytes() for t in texts], pa.binary())

    return by_task("binary", build)(text)


def _common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of ``sets`` shares with each of ``others``; counted in portions of columns."""
    def entries(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(of)), [len(x) for x in of]), np.concatenate([np.zeros(0, "<u8"), *of])

    (row_a, a), (row_b, b) = entries(sets), entries(others)
    shared = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    total = np.zeros((len(sets), len(others)), np.float32)
    for at in range(0, len(shared), COLUMNS):
        some = shared[at : at + COLUMNS]
        tables = []
        for row, of, n in ((row_a, a, len(sets)), (row_b, b, len(others))):
            column = np.searchsorted(some, of)
            here = column < len(some)
            here[here] = some[column[here]] == of[here]
            table = np.zeros((n, len(some)), np.float32)
            table[row[here], column[here]] = 1
            tables.append(table)
        total += tables[0] @ tables[1].T
    return total


def block_links(table: pa.Table) -> pa.Table:
    """Links between the labels of two blocks of a family (or inside one), as few as connect them."""
    rows = table.sort_by("fp").to_pydict()
    left = [i for i, (own, low) in enumerate(zip(rows["block"], rows["low"])) if own == low]
    right = [i for i, (own, high) in enumerate(zip(rows["block"], rows["high"])) if own == high]
    sets = [np.frombuffer(x, "<u8") for x in rows["shingles"]]
    sizes = np.array([len(x) for x in sets], np.float64)
    both = _common([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    near = both / np.maximum(union, 1) >= SIMILAR
    root = {label: label for label in rows["label"]}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        a, b = left[i], right[j]
        x, y = find(rows["label"][a]), find(rows["label"][b])
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((rows["fp"][a], rows["fp"][b]))
    ends = list(zip(*links)) or [(), ()]
    return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})


def family_links(at: DataFrame, crowded: DataFrame, sides: Sides, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect all similar texts which share a crowded key.

    A family goes through tasks in pairs of blocks of ``BLOCK`` members with all their
    shingles; a pair of blocks is compared as a whole and gives only links that connect labels.
    """
    member = _families(sides, crowded)
    size = member.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    sets = cut(
        member.join(size, "family").select("fp", "family", "blocks", own.alias("block")).join(at.select("fp", "label"), "fp")
        .join(rows, "fp").join(texts, "row").select("fp", "label", "family", "blocks", "block", shingle_binary(F.col("text")).alias("shingles")),
        "fp-families",
    )
    placed = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select(
        "fp", "label", "family", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "shingles"
    )
    return placed.groupBy("family", "low", "high").applyInArrow(block_links, "a bigint, b bigint")


def _pairs(met: DataFrame) -> DataFrame:
    return (
        met.filter((F.col("label_a") != F.col("label_b")) & _of_similar_size(F.col("n_a"), F.col("n_b")))
        .select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).distinct()
    )


def similar_links(
    nodes: DataFrame, known: DataFrame, accept: Callable[[DataFrame, bool], DataFrame],
    crowd: Callable[[DataFrame, DataFrame, Sides], DataFrame],
) -> DataFrame:
    """Links that with ``known`` connect all similar texts of ``nodes`` (fp, words, sketch, n) that share a key.

    ``accept`` takes (a, b, s), pairs with the similarity of their sketches, and gives the (a, b) that are similar;
    all of them if its second argument says that it is asked for the last time.
    First each fingerprint is compared with one of each key, in rounds while they bring many links; then
    every pair that shares a key and is not yet connected. So a pair left out is a connected one. Keys that
    still have many labels then are left to ``crowd``, which takes the labels, these keys and who has which, and gives links.
    """
    spark = nodes.sparkSession
    sketch = lambda name: nodes.select(F.col("fp").alias(name), F.col("sketch").alias(f"sketch_{name}"))

    def labelled(found: DataFrame) -> DataFrame:
        label = components(found)
        return nodes.select("fp", "n").join(label, F.col("fp") == F.col("node"), "left").select("fp", "n", F.coalesce("label", "fp").alias("label"))

    def judged(met: DataFrame, last: bool) -> DataFrame:
        both = cut(met, "fp-met").join(sketch("a"), "a").join(sketch("b"), "b")
        return accept(both.select("a", "b", similarity(F.col("sketch_a"), F.col("sketch_b")).alias("s")), last)

    keys = shared_keys(nodes)
    size, found, turn, last = nodes.count(), known, 0, False
    while True:
        at = settle(spark, lambda: labelled(found), "fp-labels")
        found = at.filter("fp <> label").select(F.col("fp").alias("a"), F.col("label").alias("b"))
        sides = _sides(at, keys)
        if last:
            break
        fresh = settle(spark, lambda: judged(_met_once(sides, turn), False), "fp-similar")
        found = found.union(fresh)
        turn, last = turn + 1, fresh.count() * MANY <= size
    sides = cut(sides[0], "fp-asked"), cut(sides[1], "fp-held")
    crowded = settle(spark, lambda: _crowded(at, sides), "fp-crowded")
    found = found.union(settle(spark, lambda: judged(_met_all(at, crowded, sides), True), "fp-similar"))
    if not crowded.isEmpty():
        found = found.union(settle(spark, lambda: crowd(at, crowded, sides), "fp-crowd-links"))
    return found


def exact_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of all shingles of two texts."""
    def build() -> Callable:
        hashes = lru_cache(maxsize=8)(lambda text: shingle_set(_words(text)))

        def one(a: str, b: str) -> float:
            x, y = hashes(a), hashes(b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both / max(1, len(x) + len(y) - both)

        return lambda xs, ys: pa.array([one(x.as_py(), y.as_py()) for x, y in zip(xs, ys)], pa.float64())

    return by_task("double", build)(a, b)


def by_texts(rows: DataFrame, texts: DataFrame) -> Callable[[DataFrame, bool], DataFrame]:
    """What ``similar_links`` accepts, from the texts of ``rows`` (fp, row) in ``texts`` (row, text)."""
    def accept(pairs: DataFrame, last: bool) -> DataFrame:
        near = pairs.filter(F.col("s") >= ROUGH)
        ends = near.select("a", "b", "s", F.explode(F.array("a", "b")).alias("fp"))
        if not last:
            # What is connected by its best pairs needs no other; all others come back.
            ends = ends.groupBy("fp").agg(F.max(F.struct("s", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
            ends = ends.select("a", "b", F.explode(F.array("a", "b")).alias("fp"))
        found = ends.select("a", "b", "fp").join(rows, "fp").join(texts, "row")
        text = lambda end: F.first(F.when(F.col("fp") == F.col(end), F.coalesce("text", F.lit(""))), True)
        both = found.groupBy("a", "b").agg(text("a").alias("x"), text("b").alias("y"))
        judged = both.select("a", "b", exact_similarity(F.col("x"), F.col("y")).alias("j"))
        return judged.filter(F.col("j") >= SIMILAR).select("a", "b")

    return accept


def classes(slim: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(fp, component_id, first_row, n_links) of every fingerprint of ``slim`` (fp, doc_id, row).

    With ``texts`` (row, text) also over ``similar_links``, from the columns words, bands, sketch and n.

    ``component_id`` is the smallest doc_id of the component, ``first_row`` the
    row with it (the smallest if it repeats), ``n_links`` the linked other
    fingerprints.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    more = [F.min_by(F.struct("words", "bands", "sketch", "n"), order).alias("print")] if texts is not None else []
    by_fp = cut(slim.groupBy("fp").agg(F.min(order).alias("first"), *more), "fingerprints")
    pairs = links(by_fp.select("fp"))
    if texts is None:
        pairs = cut(pairs, "fp-links")
    else:
        rows, known = by_fp.select("fp", "first.row"), pairs
        pairs = settle(
            slim.sparkSession,
            lambda: similar_links(
                by_fp.select("fp", "print.*"), known, by_texts(rows, texts),
                lambda at, crowded, sides: family_links(at, crowded, sides, rows, texts),
            ),
            "fp-links",
        )
    label = components(pairs)
    count = (
        pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    )
    by_fp = by_fp.select("fp", "first")
    linked = by_fp.join(label, by_fp["fp"] == label["node"]).select("fp", "first", "label")
    best = linked.groupBy("label").agg(F.min("first").alias("best"))
    linked = linked.join(best, "label").join(count, "fp").select("fp", "best", "n_links")
    return by_fp.join(linked, "fp", "left").select(
        "fp",
        F.coalesce("best", "first").alias("first"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    ).select(
        "fp",
        F.col("first.doc_id").alias("component_id"),
        F.col("first.row").alias("first_row"),
        "n_links",
    )


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links), one row per row of ``docs``."""
    slim = cut(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")), "doc-fingerprints")
    # Written, so that the join below has nothing but its own two exchanges and a
    # fingerprint with very many documents can be split.
    found = cut(classes(slim.withColumn("row", F.lit(0).cast("bigint"))), "fp-classes")
    return slim.join(found, "fp").select(
        "doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id", "n_links"
    )


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The documents with one row of each component left, that of the smallest id.

    Linked are fingerprints within the limit, and similar texts. Rows get their numbers in a written table, so that equal rows stay apart and a
    lost executor can't renumber them.
    """
    wide = cut(
        docs.select(F.struct(*docs.columns).alias("doc"))
        .select("doc", F.monotonically_increasing_id().alias("row"), prints(F.col("doc.text"), shingle).alias("print")),
        "docs-numbered",
    )
    slim = wide.select("print.*", F.col("doc.doc_id").alias("doc_id"), "row")
    texts = wide.select("row", F.col("doc.text").alias("text"))
    kept = settle(
        docs.sparkSession, lambda: classes(slim, texts).select(F.col("first_row").alias("row")).distinct(), "rows-kept"
    )
    return wide.join(kept, "row", "left_semi").select("doc.*")
