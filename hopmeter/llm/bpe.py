"""Byte-level BPE encoding and decoding with a public rank file.

A text is split by the tokenizer's pattern; each distinct word is folded once:
the adjacent pair of pieces with the lowest rank is merged until no pair has a
rank (of equal ranks the leftmost). Ids of words are kept in a table of bounded
size per task, as most words of a text have been seen before. Decoding joins the
byte pieces of the ids.

``encode_words`` folds with Spark's higher-order functions over byte arrays and a
literal rank map, ``Codec`` in the tasks' Python; both give the same ids. Texts go
through ``Codec``, the README says why. Defined cases: a null or empty text has no
ids and decodes to no bytes; white space and bytes of any kind round-trip; a very
long text is taken in portions of words, a very long word is merged with a heap;
repeated documents get equal results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from hopmeter.llm.common import by_task, let

RANK_FILE = "byte_bpe_50k.tiktoken"
PORTION = 65_536
LONG_WORD = 64
WORDS_KEPT = 200_000
DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def rank_file(path: str | None = None) -> bytes:
    """The rank file's bytes, read once on the driver and sent to the tasks."""
    with open(path or public_tokenizers.path(RANK_FILE), "rb") as f:
        return f.read()


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Pieces of a word after all ranked merges, with a heap of pairs."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        if i >= 0 and (j := after[i]) < n:
            pair = parts[i] + parts[j]
            if (r := ranks.get(pair)) is not None:
                heapq.heappush(heap, (r, i, len(pair)))

    while heap:
        _, i, size = heapq.heappop(heap)
        if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != size:
            continue  # one of the two has been merged since
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        push(before[i])
    return [p for p in parts if p is not None]


class Fold:
    """Ranked merges of many words at once, as arrays of ids.

    Every round merges the lowest pair of every word that still has one; words
    without one leave the arrays.
    """

    NONE = np.int64(2**62)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = sorted(
            (ranks[p[:k]] << 32 | ranks[p[k:]], rank)
            for p, rank in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks
        )
        self.keys, self.merged = np.array(pairs, np.int64).reshape(-1, 2).T.copy()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], self.NONE)

    def __call__(self, words: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...] | None] = [None] * len(words)
        short = []
        for i, w in enumerate(words):
            if w in self.ranks:
                out[i] = (self.ranks[w],)
            elif len(w) > LONG_WORD:
                out[i] = tuple(self.ranks[p] for p in fold_long(w, self.ranks))
            else:
                short.append(i)
        sizes = np.array([len(words[i]) for i in short], np.int64)
        ids = self.byte[np.frombuffer(b"".join([words[i] for i in short]), np.uint8)]
        number = np.repeat(np.array(short, np.int64), sizes)
        # The pair of a place is the one with the next place of the same word.
        rank = np.full(len(ids), self.NONE)
        inner = np.flatnonzero(number[:-1] == number[1:])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        while len(ids):
            start = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            length = np.diff(np.append(start, len(ids)))
            low = np.minimum.reduceat(rank, start)
            done = low == self.NONE
            if done.any():
                for a, n in zip(start[done].tolist(), length[done].tolist()):
                    out[number[a]] = tuple(ids[a : a + n].tolist())
                left = ~np.repeat(done, length)
                ids, number, rank = ids[left], number[left], rank[left]
                length, low = length[~done], low[~done]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            hit = hit[np.concatenate(([True], number[hit[1:]] != number[hit[:-1]]))]  # leftmost of a word
            ids[hit] = rank[hit]
            stays = np.ones(len(ids), bool)
            stays[hit + 1] = False
            ids, number, rank = ids[stays], number[stays], rank[stays]
            at = hit - np.arange(len(hit))
            near = np.concatenate((at, at[at > 0] - 1))
            same = (near + 1 < len(ids)) & (number[near] == number[np.minimum(near + 1, len(ids) - 1)])
            rank[near[~same]] = self.NONE
            near = near[same]
            rank[near] = self._rank(ids[near], ids[near + 1])
        return out


class Codec:
    def __init__(self, data: bytes, pattern: str):
        ranks = read_ranks(data)
        self.fold = Fold(ranks)
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces = {i: p for p, i in ranks.items()}
        self.decimal = {i: str(i) for i in ranks.values()}
        self.split = regex.compile(pattern)

    def _portions(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
        """(number of the text, words), of about PORTION words together."""
        held, size = [], 0
        for i, text in enumerate(texts):
            if len(text or "") <= PORTION:
                parts = iter([self.split.findall(text or "")])
            else:
                words = (m.group() for m in self.split.finditer(text))
                parts = iter(lambda words=words: list(islice(words, PORTION)), [])
            for words in parts:
                held.append((i, words))
                size += len(words)
                if size >= PORTION:
                    yield held
                    held, size = [], 0
        yield held

    def portions(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, ids) in order, at least one portion for each text."""
        for held in self._portions(texts):
            if len(self.words) > WORDS_KEPT:
                self.words.clear()
            new = list(set(chain.from_iterable(words for _, words in held)).difference(self.words))
            self.words.update(zip(new, self.fold([w.encode("utf-8", "surrogatepass") for w in new])))
            for i, words in held:
                yield i, list(chain.from_iterable(map(self.words.__getitem__, words)))

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for i, ids in self.portions(texts):
            out[i] += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        n = [0] * len(texts)
        written, decoded_ = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for i, ids in self.portions(texts):
            if ids:
                written[i].update(((" " if n[i] else "") + " ".join(map(self.decimal.__getitem__, ids))).encode())
                decoded_[i].update(self.decode(ids))
                n[i] += len(ids)
        return [(k, w.hexdigest(), d.hexdigest()) for k, w, d in zip(n, written, decoded_)]


def _with_codec(result: str, use: Callable[[Codec], Callable], path: str | None, pattern: str | None) -> Callable:
    data, pattern = rank_file(path), pattern or public_tokenizers.PATTERN
    return by_task(result, lambda: use(Codec(data, pattern)))


def token_ids(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Array of ids of a whole text."""
    def use(codec: Codec) -> Callable:
        return lambda texts: pa.array(codec.encode_all([t.as_py() for t in texts]), pa.list_(pa.int32()))

    return _with_codec("array<int>", use, path, pattern)(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """Bytes of an array of ids."""
    def use(codec: Codec) -> Callable:
        return lambda rows: pa.array([codec.decode(r.as_py() or []) for r in rows], pa.binary())

    return _with_codec("binary", use, path, None)(ids)


def digests(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of a whole text."""
    def use(codec: Codec) -> Callable:
        def run(texts: pa.Array) -> pa.Array:
            found = list(zip(*codec.digests([t.as_py() for t in texts]))) or [(), (), ()]
            return pa.StructArray.from_arrays(
                [pa.array(found[0], pa.int64()), pa.array(found[1], pa.string()), pa.array(found[2], pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return run

    return _with_codec(DIGEST, use, path, pattern)(text)


def encoded(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Struct (ids, decoded_sha256) of a whole text; the checksum is that of the ids decoded again."""
    def use(codec: Codec) -> Callable:
        def run(texts: pa.Array) -> pa.Array:
            ids = codec.encode_all([t.as_py() for t in texts])
            sums = [hashlib.sha256(codec.decode(i)).hexdigest() for i in ids]
            return pa.StructArray.from_arrays(
                [pa.array(ids, pa.list_(pa.int32())), pa.array(sums, pa.string())], ["ids", "decoded_sha256"]
            )

        return run

    return _with_codec("struct<ids:array<int>,decoded_sha256:string>", use, path, pattern)(text)


# -- the same fold in higher-order functions ------------------------------------------


def rank_map(data: bytes, buckets: int = 16_384) -> Column:
    """Literal array of small maps from hex pieces to ranks, by hash of the piece.

    One map would be searched from end to end for every pair.
    """
    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in read_ranks(data).items():
        h = piece.hex().upper()
        maps[crc32(h.encode()) % buckets][h] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_words(word: Column, ranks: Column, buckets: int = 16_384) -> Column:
    """Ids of a word (binary), by folding merges over its bytes as hex pieces."""
    none = F.lit(2**31 - 1)

    def rank(maps: Column, piece: Column) -> Column:
        return F.coalesce(F.get(maps, (F.crc32(piece.cast("binary")) % buckets).cast("int"))[piece], none)

    def merge(maps: Column, parts: Column) -> Column:
        pairs = F.transform(
            F.slice(parts, 1, F.size(parts) - 1), lambda p, i: rank(maps, F.concat(p, F.get(parts, i + 1)))
        )

        def at_lowest(ranked: Column) -> Column:
            low = F.array_min(ranked)
            i = F.array_position(ranked, low).cast("int")
            merged = F.concat(
                F.slice(parts, 1, i - 1),
                F.array(F.concat(F.get(parts, i - 1), F.get(parts, i))),
                F.slice(parts, i + 2, F.size(parts)),
            )
            return F.when(low == none, parts).otherwise(merged)

        return F.when(F.size(parts) < 2, parts).otherwise(let(pairs, at_lowest))

    hexed = F.hex(word)
    start = F.transform(
        F.sequence(F.lit(0), F.octet_length(word) - 1), lambda i: F.substring(hexed, 2 * i + 1, F.lit(2))
    )
    return let(
        ranks,
        lambda maps: F.when(rank(maps, hexed) != none, F.array(rank(maps, hexed))).otherwise(
            F.transform(
                F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), start, lambda parts, _: merge(maps, parts)),
                lambda p: rank(maps, p),
            )
        ),
    )
