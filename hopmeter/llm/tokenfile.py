"""Token ids in binary shards, each with a minimal perfect hash index.

A shard is two files of the shared folder. ``.ids`` holds the raw ids of its
documents one after the other, two bytes each where the vocabulary allows it, else
four, little-endian. ``.idx`` holds the index: levels of bits (a key takes the first
level where it has a place for itself; its rank among the set bits is its slot, so
n keys fill n slots), and per slot a fingerprint of the key, its first document and
how many documents have it; then where each document starts. A lookup is a few
hashes and two array reads, whatever the size of the shard, and a key that was
never written is told by its fingerprint (save one in 2^32).

Documents are range sorted by key, and each task encodes its range, every distinct
word once by the library, and writes it as one or more shards. A shard's name
is drawn anew in each attempt and only finished tasks get into the manifest table,
so that lost executors and repeated tasks leave no trace in it.

Defined cases: a null or empty text has no ids but the end id; a null key is a key;
documents of equal key follow each other (one of them a shard's last, the next one
the first of another, if need be) and a lookup gives all of them. Texts of any length
are encoded whole; only the named columns are read, so others change nothing. An
empty table has no shards.
"""

from __future__ import annotations

import io
import json
import struct
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmeter.llm.common import by_task
from hopmeter.session import cut, fresh_path

END_ID = 2
#: A shard ends after so many documents or ids, whichever comes first.
SHARD_DOCS, SHARD_IDS = 1 << 18, 1 << 27
#: Words whose ids a task keeps; beyond it starts anew, which costs time only.
KEPT_WORDS = 600_000
#: Texts encoded at once.
TEXTS = 2000
#: Letters before this one are letters in every version of the character tables.
LATER_SCRIPTS = "\u0530"
MARKS = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
#: Bits per key on the first level.
GAMMA = 2.0
#: Bytes of ids sent back at once.
PORTION = 8 << 20
MANIFEST = (
    "task int, number int, path string, n_docs bigint, n_ids bigint, width int, first_key string, last_key string"
)


# -- encoding -------------------------------------------------------------------------


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts, each distinct word encoded once by the library.

    The vocabulary's words never span ASCII white space and its normal form doesn't
    look across it either, so a text's ids are those of its pieces. A mark at the
    end of a word is a piece of its own behind a letter: it neither joins the
    letter's word nor forms a character with it. Words of ASCII letters alone, of which the
    normal form is the lower case, go straight to the library's merges.
    """

    def __init__(self, vocabulary: str, end_id: int, type: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.code = "H" if type == "<u2" else "I"
        self.end = self._raw([end_id])
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _raw(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _learn(self, pieces: set[str]) -> None:
        rest, merge = [], self.model.tokenize
        for p in pieces:
            if p.isascii() and p.isalpha():
                self.pieces[p] = self._raw([t.id for t in merge(p.lower())])
            else:
                rest.append(p)
        for at in range(0, len(rest), 10_000):
            some = rest[at : at + 10_000]
            for p, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.pieces[p] = self._raw(found.ids)

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        # Names of special tokens are told apart by case.
        split = [(t if b"<|" in t else t.lower()).split() for t in raw]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
            self.pieces.clear()
        cut = {w: _pieces(w) for w in set().union(*split) if w not in self.words}
        self._learn({p for some in cut.values() for p in some if p not in self.pieces})
        for w, some in cut.items():
            self.words[w] = b"".join(map(self.pieces.__getitem__, some))
        return [b"".join([*map(self.words.__getitem__, words), self.end]) for words in split]


def _pieces(word: bytes) -> tuple[str, ...]:
    """A word without the marks at its end, and these; whole where the last letter's normal form may not end in a
    letter, or where the name of a special token may stand."""
    text = word.decode("utf-8", "surrogatepass")
    if word.isalpha() or "<|" in text:
        return (text,)
    core = text.rstrip(MARKS)
    last = core[-1:]
    if not last.isascii():
        last = unicodedata.normalize("NFC", last).lower()[-1] if last < LATER_SCRIPTS else ""
    return (core, text[len(core) :]) if core != text and last.isalpha() else (text,)


# -- minimal perfect hash -------------------------------------------------------------


def _spots(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Place of each hash on a level: a 64-bit mix, modulo the level's bits."""
    x = hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return (x ^ x >> np.uint64(33)) % np.uint64(bits)


def make_hash(hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Levels of bits over distinct 64-bit ``hashes``."""
    sizes, parts, rest = [], [], hashes
    while len(rest):
        size = max(1, -(-int(GAMMA * len(rest)) // 64)) * 64
        spots = _spots(rest, len(sizes), size)
        alone = np.bincount(spots.astype(np.int64), minlength=size) == 1
        sizes.append(size)
        parts.append(np.packbits(alone, bitorder="little").view("<u8"))
        rest = rest[~alone[spots.astype(np.int64)]]
    words = np.concatenate([np.zeros(0, "<u8"), *parts])
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
    return {"sizes": np.array(sizes, np.int64), "words": words, "before": before.astype("<u4")}


def slots(index: dict[str, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Slot of each hash; -1 where no level has a place for it."""
    found, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
    base = 0
    for level, size in enumerate(index["sizes"].tolist()):
        if not len(left):
            break
        bit = base + _spots(hashes[left], level, size).astype(np.int64)
        word, low = index["words"][bit >> 6], (bit & 63).astype(np.uint64)
        here = (word >> low & np.uint64(1)).astype(bool)
        below = np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
        found[left[here]] = (index["before"][bit >> 6].astype(np.int64) + below)[here]
        left, base = left[~here], base + size
    return found


def key_bytes(key: str | None) -> bytes:
    return b"" if key is None else b"=" + key.encode("utf-8", "surrogatepass")


def key_hashes(keys: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits that place a key, 32 other bits that tell it from others)."""
    raw = b"".join(xxhash.xxh3_128_digest(k, seed) for k in keys)
    both = np.frombuffer(raw, ">u8").reshape(-1, 2)
    return both[:, 1].astype(np.uint64), (both[:, 0] >> np.uint64(32)).astype("<u4")


def make_index(keys: list[bytes], lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Index of a shard's documents, in the order of their keys (equal ones together)."""
    fresh = np.array([i == 0 or keys[i - 1] != k for i, k in enumerate(keys)], bool)
    first = np.flatnonzero(fresh)
    own, seed = [keys[i] for i in first], 0
    place, mark = key_hashes(own, seed)
    while len(np.unique(place)) < len(place):  # two keys with one hash: draw others
        seed += 1
        place, mark = key_hashes(own, seed)
    index = make_hash(place)
    at = slots(index, place)
    out = {name: np.zeros(len(own), "<u4") for name in ("marks", "first", "runs")}
    out["marks"][at], out["first"][at] = mark, first
    out["runs"][at] = np.diff(np.append(first, len(keys)))
    ends = np.concatenate(([0], np.cumsum([len(k) for k in own])))
    return index | out | {
        "seed": np.array([seed]), "starts": np.concatenate(([0], np.cumsum(lengths))).astype("<i8"),
        "key_ends": ends.astype("<i8"), "keys": np.frombuffer(b"".join(own), np.uint8),
    }


def look_up(index: dict[str, np.ndarray], keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(first document, number of documents) of each key; 0 documents for an unknown one."""
    place, mark = key_hashes(keys, int(index["seed"][0])) if keys else (np.zeros(0, np.uint64), np.zeros(0, "<u4"))
    at = slots(index, place)
    if not len(index["marks"]):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    known = (at >= 0) & (index["marks"][at] == mark)
    return np.where(known, index["first"][at], 0).astype(np.int64), np.where(known, index["runs"][at], 0).astype(np.int64)


# -- files ------------------------------------------------------------------------------


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after the other behind a line that describes them."""
    system, at = _place(path)
    head = json.dumps([(k, v.dtype.str, len(v)) for k, v in arrays.items()]).encode() + b"\n"
    with system.open_output_stream(at) as out:
        out.write(head)
        for v in arrays.values():
            out.write(v.tobytes())


def load_index(path: str) -> dict[str, np.ndarray]:
    system, at = _place(path)
    with system.open_input_stream(at) as source:
        raw = io.BytesIO(source.read())
    head = json.loads(raw.readline())
    return {k: np.frombuffer(raw.read(np.dtype(t).itemsize * n), t) for k, t, n in head}


class _Shard:
    """A shard being written."""

    def __init__(self, folder: str, width: int):
        self.path, self.width = f"{folder}/{uuid.uuid4().hex}", width
        system, at = _place(f"{self.path}.ids")
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(at, buffer_size=1 << 20)
        self.keys: list[bytes] = []
        self.lengths: list[int] = []
        self.n_ids, self.ends = 0, [None, None]

    def add(self, key: str | None, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(key_bytes(key))
        self.lengths.append(len(ids) // self.width)
        self.n_ids += self.lengths[-1]
        self.ends = [key if len(self.keys) == 1 else self.ends[0], key]

    def full(self) -> bool:
        return len(self.keys) >= SHARD_DOCS or self.n_ids >= SHARD_IDS

    def close(self, task: int, number: int) -> dict:
        self.out.close()
        _save(f"{self.path}.idx", make_index(self.keys, np.array(self.lengths, np.int64)))
        return {
            "task": task, "number": number, "path": self.path, "n_docs": len(self.keys), "n_ids": self.n_ids,
            "width": self.width, "first_key": self.ends[0], "last_key": self.ends[1],
        }


_MANIFEST = pa.schema([
    ("task", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
    ("width", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()),
])


def _writer(folder: str, vocabulary: str, end_id: int, width: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard, done = TaskContext.get().partitionId(), None, []
        encoder = Encoder(vocabulary, end_id, f"<u{width}")
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                for key, ids in zip(some["key"].to_pylist(), encoder.texts(some["text"].to_pylist())):
                    shard = shard or _Shard(folder, width)
                    shard.add(key, ids)
                    if shard.full():
                        done.append(shard.close(task, len(done)))
                        shard = None
        if shard:
            done.append(shard.close(task, len(done)))
        yield pa.RecordBatch.from_pylist(done, _MANIFEST)

    return write


@dataclass
class Store:
    """A written store. ``shards``: MANIFEST without task, with ``shard`` from 0 and ``base``, the ids before it."""

    shards: DataFrame
    key_type: str


def write(docs: DataFrame, key: str, text: Column, vocabulary: str | None = None, end_id: int = END_ID) -> Store:
    """Encode ``text`` of every row and write the ids in ascending order of the column ``key``."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_file()
    with open(vocabulary) as source:
        model = json.load(source)
    top = max(end_id, *model["model"]["vocab"].values(), *[t["id"] for t in model["added_tokens"]])
    laid = docs.select(
        F.col(key).alias("order"), F.monotonically_increasing_id().alias("row"), text.alias("text")
    ).repartitionByRange("order", "row").sortWithinPartitions("order", "row")
    writer = _writer(fresh_path(spark, "token-ids"), vocabulary, end_id, 2 if top < 1 << 16 else 4)
    shards = cut(
        laid.select(F.col("order").cast("string").alias("key"), "text").mapInArrow(writer, MANIFEST), "token-shards",
    )
    # One row per shard: tasks, and documents by the quarter million.
    along = Window.orderBy("task", "number")
    before = F.sum("n_ids").over(along.rowsBetween(Window.unboundedPreceding, -1))
    named = shards.withColumns({
        "shard": F.row_number().over(along).cast("bigint") - 1, "base": F.coalesce(before, F.lit(0)),
    }).drop("task", "number")
    return Store(cut(named, "token-manifest"), docs.schema[key].dataType.simpleString())


FOUND = "key string, shard bigint, start bigint, ids binary"
_FOUND = pa.schema([("key", pa.string()), ("shard", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


class _Open:
    """An open shard."""

    def __init__(self, shard: dict):
        self.shard, self.index = shard, load_index(f"{shard['path']}.idx")
        system, at = _place(f"{shard['path']}.ids")
        self.ids = system.open_input_file(at)

    def keys(self) -> list[bytes]:
        ends, raw = self.index["key_ends"].tolist(), self.index["keys"].tobytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def documents(self, keys: list[bytes]) -> Iterator[dict]:
        """Documents of the keys, by way of the index."""
        starts, width = self.index["starts"], self.shard["width"]
        for key, first, run in zip(keys, *[x.tolist() for x in look_up(self.index, keys)]):
            for doc in range(first, first + run):
                a, b = int(starts[doc]), int(starts[doc + 1])
                raw = self.ids.read_at((b - a) * width, a * width)
                yield {
                    "key": key[1:].decode("utf-8", "surrogatepass") if key else None, "shard": self.shard["shard"],
                    "start": self.shard["base"] + a, "ids": np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes(),
                }


def _portions(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in found:
        rows.append(row)
        size += len(row["ids"]) + 64
        if size >= PORTION:
            yield pa.RecordBatch.from_pylist(rows, _FOUND)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, _FOUND)


def read(store: Store) -> DataFrame:
    """(key, shard, start, ids) of every document, each found by its key; ids are little-endian 32-bit integers."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Open(row)
                yield from _portions(shard.documents(shard.keys()))

    shards = store.shards.select("shard", "path", "base", "width")
    return shards.repartition(max(1, min(shards.count(), 10_000))).mapInArrow(scan, FOUND)


def fetch(store: Store, keys: DataFrame) -> DataFrame:
    """(key, shard, start, ids) of the documents whose keys are asked for in column ``key``; unknown keys give nothing.

    Shards follow each other in key order. Where they begin and end (two keys per
    shard, so at most two per task and quarter million documents) goes to the tasks,
    each asked key goes to the shards that may hold it, and is looked up there.
    """
    own = F.col("first_key").cast(store.key_type), F.col("last_key").cast(store.key_type)
    ends = [(r[0], r[1], r[2]) for r in store.shards.orderBy("shard").select("shard", *own).collect()]

    def route(asked: pa.Array) -> pa.Array:
        from bisect import bisect_left, bisect_right

        order = lambda k: (k is not None, k if k is not None else 0)
        firsts, lasts = [order(e[1]) for e in ends], [order(e[2]) for e in ends]
        found = [order(k.as_py()) for k in asked]
        return pa.array([list(range(bisect_left(lasts, k), bisect_right(firsts, k))) for k in found], pa.list_(pa.int64()))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            shard = None
            for batch in batches:
                for row in batch.to_pylist():
                    if shard is None or shard.shard["shard"] != row["shard"]:
                        shard = _Open(row)
                    yield from shard.documents([key_bytes(row["key"])])

        return _portions(found())

    asked = keys.select(F.col("key").cast(store.key_type).alias("key")).distinct()
    routed = asked.select(F.col("key").cast("string").alias("key"), F.explode(by_task("array<bigint>", lambda: route)(F.col("key"))).alias("shard"))
    placed = routed.join(store.shards.select("shard", "path", "base", "width"), "shard")
    return placed.repartition("shard", "key").sortWithinPartitions("shard").mapInArrow(get, FOUND)
