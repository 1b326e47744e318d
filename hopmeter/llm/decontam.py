"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by k = floor(rate * m)
edits. Cut into k + 1 pieces, at least one piece survives unchanged in any such
passage. All pieces are searched at once in every text; only around a piece hit
is the edit distance computed, by Myers' bit-parallel recurrence over a window.

Texts and items are compared lower-cased with white space collapsed. The items
are the stated query set: they go to the tasks in blocks of bounded size, a pass over the
documents each, and documents are never shuffled. Items may have ids of any type. Defined cases: a null or empty text, and a null or
empty item, match nothing; repeated items all report; an item too short for one
edit must occur exactly; repeated documents each report; a null id is reported
as null. Columns other than ``text`` (and the id) are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmeter.llm.common import by_task
from hopmeter.session import cut

#: Edits allowed per character of an item. At 0.1 the pieces get so short that chance
#: hits cost sixteen times the search itself.
RATE = 0.08
BLOCK_CHARS = 4_000_000
HITS = "array<struct<item_id:string,distance:int>>"
_HITS = pa.list_(pa.struct([("item_id", pa.string()), ("distance", pa.int32())]))


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def edit_budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    n = budget + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers_least(pattern: str, text: str) -> int:
    """Least edit distance between ``pattern`` and any substring of ``text``."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        eq[ch] = eq.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, least = full, 0, m, m
    for ch in text:
        e = eq.get(ch, 0)
        xv = e | mv
        xh = ((e & pv) + pv ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < least:
                least = score
        ph = ph << 1 & full
        pv = mh << 1 & full | ~(xv | ph) & full
        mv = ph & xv
    return least


class Matcher:
    """One block of items, compiled once per Python worker."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.budgets = [], []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if item := normal(text):
                n = len(self.items)
                self.items.append((item_id, item))
                self.budgets.append(edit_budget(len(item), rate))
                for offset, piece in pieces(item, self.budgets[-1]):
                    places.setdefault(piece, []).append((n, offset))
        self.search = ahocorasick.Automaton()
        for piece, where in places.items():
            self.search.add_word(piece, (len(piece), where))
        if places:
            self.search.make_automaton()

    def hits(self, text: str | None) -> list[dict]:
        if not text or not self.items:
            return []
        text = normal(text)
        starts: dict[int, set[int]] = {}
        for end, (length, where) in self.search.iter(text):
            for n, offset in where:
                starts.setdefault(n, set()).add(end - length + 1 - offset)
        out = []
        for n, at in starts.items():
            item_id, item = self.items[n]
            budget, size = self.budgets[n], len(item)
            if item in text:
                out.append({"item_id": item_id, "distance": 0})
                continue
            least, low, high = size, None, None
            # Overlapping windows are verified as one.
            for s in [*sorted(at), None]:
                if s is not None and high is not None and s - budget <= high:
                    high = s + size + budget
                    continue
                if high is not None:
                    least = min(least, myers_least(item, text[max(low, 0) : max(high, 0)]))
                if s is not None:
                    low, high = s - budget, s + size + budget
            if least <= budget:
                out.append({"item_id": item_id, "distance": least})
        return sorted(out, key=lambda h: (h["item_id"] is None, h["item_id"], h["distance"]))


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of about ``block_chars`` characters, fetched one after the other."""
    slim = items.select(F.col("item_id").cast("string"), "text").filter("text is not null")
    total = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    block = F.pmod(F.xxhash64("text"), F.lit(n))
    for b in range(n):
        yield [tuple(r) for r in slim.filter(block == b).collect()]


def _search(block: list[tuple[str | None, str]], rate: float, text: Column) -> Column:
    """Array of (item_id, distance) of the items of a block found in ``text``."""
    def build() -> Callable:
        matcher = Matcher(block, rate)
        return lambda texts: pa.array([matcher.hits(t.as_py()) for t in texts], _HITS)

    return by_task(HITS, build)(text)


def benchmark_hits(
    docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(row, hit) of the items that the rows of ``docs`` (row, text) hold; a hit is (item_id, distance), the id as text.

    Each block of items has a pass of its own and writes what it finds, so that neither the
    driver nor a task ever has more than one block.
    """
    found = []
    for block in item_blocks(items, block_chars):
        hits = docs.select("row", F.explode(_search(block, rate, F.col("text"))).alias("hit"))
        found.append(cut(hits, "benchmark-hits"))
    return reduce(DataFrame.union, found)


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, distance) of every item found in every document."""
    slim = docs.select(F.struct(F.col("doc_id")).alias("row"), "text")
    found = benchmark_hits(slim, items, **options)
    return found.select("row.doc_id", F.col("hit.item_id").cast(items.schema["item_id"].dataType).alias("item_id"), "hit.distance")


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item is found, with all their columns.

    Documents that a block rejects are not looked at for the next one.
    """
    for i, block in enumerate(item_blocks(items, block_chars)):
        docs = cut(docs, "benchmark-clean") if i else docs
        docs = docs.filter(F.size(_search(block, rate, docs["text"])) <= 0)
    return docs
