"""Quality rules: a decision list learned from labelled statistics.

``statistics`` describes each text by counts, in DataFrame expressions. Labelled
documents are reduced to counts per cell of a grid over six shares (at most seven
thresholds each, so at most 8^6 cells for each half of the data, however many
labels there are). Sequential covering works on the cells: it grows a conjunction
of thresholds on one half (FOIL gain), prunes it on the other, keeps it if the
documents it rejects are bad often enough there, removes what it covers, and goes
on. The result is an ordered list, applied as one conditional expression.

Two fixed rules stand before the list: fewer than 10 words, and more than a fifth
of the words in repeated 5-word windows. Defined cases: a null or empty text has
zero counts and fails the first rule; without labels the fixed rules decide alone;
labels that are null or belong to no document are ignored, repeated labels count
each; repeated documents get equal results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmeter.llm.common import let
from hopmeter.session import cut

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper"]
FEATURES = ["words", "word_length", "symbols", "repeats", "distinct", "upper"]


# -- statistics -----------------------------------------------------------------


def _matches(text: Column, pattern: str) -> Column:
    """Code points of ``text`` that match the pattern of one character."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _windows(words: Column, make) -> Column:
    """``make(five words, position)`` for each 5-word window."""
    last = F.size(words) - WINDOW
    return F.when(last < 0, F.array()).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: make([words[i + k] for k in range(WINDOW)], i))
    )


def _covered(windows: Column) -> Column:
    """Words in windows that occur again; ``windows``: sorted (text, position)."""
    again = F.transform(
        windows,
        lambda w, i: F.when(
            (w["text"] == F.get(windows, i - 1)["text"]) | (w["text"] == F.get(windows, i + 1)["text"]), w["at"]
        ),
    )
    places = F.sort_array(F.filter(again, lambda p: p.isNotNull()))
    lengths = let(
        places,
        lambda ps: F.transform(ps, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(ps, i + 1) - p, F.lit(WINDOW)))),
    )
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda n, x: n + x)


def repeat_words(words: Column) -> Column:
    """Words in 5-word windows found twice or more.

    Most texts repeat no window, which distinct hashes prove; only where two
    hashes are equal are the windows themselves sorted and compared.
    """
    def exact(w: Column) -> Column:
        pairs = _windows(w, lambda five, i: F.struct(F.concat_ws(" ", *five).alias("text"), i.alias("at")))
        return let(F.sort_array(pairs), _covered)

    return let(
        words,
        lambda w: let(
            _windows(w, lambda five, i: F.xxhash64(*five)),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(exact(w)),
        ),
    )


def statistics(text: Column) -> Column:
    """Struct of the counts of a whole text."""
    text = F.coalesce(text, F.lit(""))
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
        lambda x: F.size(x) - F.size(F.array_distinct(x)),
    )
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _matches(text, SYMBOLS).cast("bigint").alias("n_symbols"),
            lines.cast("bigint").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
            _matches(text, r"\p{Lu}").cast("bigint").alias("n_upper"),
        ),
    )


def shares(s: Column) -> dict[str, Column]:
    """What the rules test, from a struct of counts."""
    n = F.greatest(s["n_words"], F.lit(1))
    return {
        "words": s["n_words"].cast("double"),
        "word_length": s["word_chars"] / n,
        "symbols": s["n_symbols"] / n,
        "repeats": s["n_repeat_words"] / n,
        "distinct": s["n_distinct"] / F.sqrt(n),
        "upper": s["n_upper"] / F.greatest(s["word_chars"], F.lit(1)),
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


# -- learning --------------------------------------------------------------------


@dataclass(frozen=True)
class Test:
    """``feature > threshold`` or its opposite."""

    feature: str
    above: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        x = values[self.feature]
        return x > self.threshold if self.above else x <= self.threshold


def thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds: outer quantiles of good documents, inner ones of bad."""
    found = labelled.groupBy("bad").agg(
        *[F.percentile_approx(f, [0.005, 0.05, 0.25, 0.5, 0.75, 0.95, 0.995], 1000).alias(f) for f in FEATURES]
    ).collect()
    by = {r["bad"]: r for r in found}
    out = {}
    for f in FEATURES:
        good = [by[0][f][i] for i in (0, 1, 5, 6)] if 0 in by else []
        bad = [by[1][f][i] for i in (2, 3, 4)] if 1 in by else []
        out[f] = sorted({float(x) for x in [*good, *bad] if x is not None})
    return out


def cells(labelled: DataFrame, cuts: dict[str, list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Bins (cells x features) and counts (cells x [grow good, grow bad, prune good, prune bad])."""
    bins = [
        sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias(f) for f in FEATURES
    ]
    count = [
        F.count_if((F.col("half") == half) & (F.col("bad") == bad)).alias(f"c{half}{bad}")
        for half in (0, 1) for bad in (0, 1)
    ]
    rows = labelled.select("half", "bad", *bins).groupBy(*FEATURES).agg(*count).orderBy(*FEATURES).collect()
    data = np.array([tuple(r) for r in rows], np.int64).reshape(-1, len(FEATURES) + 4)
    return data[:, : len(FEATURES)], data[:, len(FEATURES) :]


def cover(bins: np.ndarray, counts: np.ndarray, cuts: dict[str, list[float]],
          precision: float = 0.9, least: int = 3, most_rules: int = 20) -> list[list[Test]]:
    """Ordered conjunctions that pick bad documents, by sequential covering."""
    tests = [
        (Test(f, above, c), bins[:, i] > j if above else bins[:, i] <= j)
        for i, f in enumerate(FEATURES) for j, c in enumerate(cuts[f]) for above in (True, False)
    ]
    left, open_, rules = np.ones(len(bins), bool), np.ones(len(bins), bool), []

    def tally(mask: np.ndarray, half: int) -> tuple[int, int]:
        good, bad = counts[mask][:, 2 * half : 2 * half + 2].sum(axis=0) if mask.any() else (0, 0)
        return int(good), int(bad)

    for _ in range(2 * most_rules):
        mask, chosen = left & open_, []
        good, bad = tally(mask, 0)
        while good and bad:
            best = None
            for test, holds in tests:
                g, b = tally(mask & holds, 0)
                if b:
                    gain = b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good)))
                    if best is None or gain > best[0]:
                        best = (gain, test, holds)
            if best is None or best[0] <= 1e-9:
                break
            chosen.append(best[1:])
            mask &= best[2]
            good, bad = tally(mask, 0)

        def worth(k: int) -> float:
            mask = left.copy()
            for _, holds in chosen[:k]:
                mask &= holds
            g, b = tally(mask, 1)
            return (b - g) / (b + g) if b + g else -1.0

        if not chosen or len(rules) == most_rules:
            break
        # The shortest of the best prefixes.
        k = max(range(1, len(chosen) + 1), key=lambda k: (worth(k), -k))
        mask = left.copy()
        for _, holds in chosen[:k]:
            mask &= holds
        g, b = tally(mask, 1)
        if b < least or b < precision * (b + g):
            open_ &= ~mask  # no rule here; what other rules cover is still looked at
            continue
        rules.append([t for t, _ in chosen[:k]])
        left &= ~mask
    return rules


def learn(stats: DataFrame, labels: DataFrame) -> list[list[Test]]:
    """Rules from ``stats`` (doc_id, s) and ``labels`` (doc_id, quality)."""
    values = shares(F.col("s"))
    labelled = cut(
        stats.select("doc_id", *[v.alias(k) for k, v in values.items()])
        .join(labels.filter("quality is not null").select("doc_id", (1 - F.col("quality").cast("int")).alias("bad")), "doc_id")
        .filter("bad in (0, 1)")
        .withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")),
        "labelled-statistics",
    )
    cuts = thresholds(labelled)
    bins, counts = cells(labelled, cuts)
    return cover(bins, counts, cuts) if len(bins) else []


def rule_number(rules: list[list[Test]], s: Column) -> Column:
    """Number from 1 of the first rule that holds; null if none does."""
    values, out = shares(s), F.lit(None).cast("int")
    for n in range(len(rules), 0, -1):
        holds = F.lit(True)
        for test in rules[n - 1]:
            holds = holds & test.column(values)
        out = F.when(holds, F.lit(n)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, rule, kept) of every document."""
    stats = cut(docs.select("doc_id", statistics(F.col("text")).alias("s")), "text-statistics")
    rules = learn(stats, labels)
    return stats.select(
        "doc_id", *[F.col("s")[c].alias(c) for c in COUNTS], base_failed(F.col("s")).alias("base_failed"),
        rule_number(rules, F.col("s")).alias("rule"),
    ).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    Texts are described once to learn and once to decide: only the counts are
    written in between, no second copy of the texts.
    """
    rules = learn(cut(docs.select("doc_id", statistics(F.col("text")).alias("s")), "text-statistics"), labels)
    good = let(statistics(docs["text"]), lambda s: ~base_failed(s) & rule_number(rules, s).isNull())
    return docs.filter(good)
