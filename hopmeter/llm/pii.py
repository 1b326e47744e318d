"""Personal data by boosted trees over candidate spans.

Generators with high recall propose spans of six kinds, which may overlap. Each
candidate gets format features (length, share of digits, kinds of characters, how
varied they are) and context features (letters or digits touching it, a cue word
before it), all of a few values each. Gradient boosting works on the counts per
combination of values (at most 6,912, however large the corpus), so training is one
aggregation; the trees become conditional expressions. The labels are weak and never
among a kind's own features: for email, ip, card and phone the rule's verdict, which format
and context must foretell; for secrets and numbers a cue word before them, which the
format must foretell. What a cue names is taken as it is; a token without one is taken where
nearly all that look like it have one, so hashes that look like keys stay. One half of the documents grows the trees, the other sets the threshold
of each kind, where the precision among candidates above it reaches ``precision``.

Spans that pass their kind's fixed rule (email, ip, card, phone) always stay. The
others are added where their score reaches the threshold and no such span is
touched. Positions count code points, ends are exclusive.

Each pattern here is written so that it never goes back over what it has read:
characters that can't belong to a match are first replaced one for one. Results
equal the plain patterns. Defined cases: a null or empty text has no spans; text
without candidates costs the prefilters only; repeated documents get equal
results, and a candidate counts in training once for each document it stands in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmeter.llm.common import let
from hopmeter.session import cut

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret", "number"]
#: Feature -> number of values.
FEATURES = {"kind": len(KINDS), "length": 4, "digits": 4, "mix": 4, "variety": 3, "hint": 2, "glued": 2}
_SECRET = r"""(?i)(token|secret|passwor[dt]|passwd|pwd|api.?key|key|bearer)["']?\s{0,3}[=:]?\s{0,3}["']?$"""
_NUMBER = r"(?i)(tel|phone|fax|mobile|call|account|iban|ssn|card|passport)[a-z]{0,10}[.:# ]{0,3}$"
_PLACE = r"(?i)(mail|contact|write|address|host|server|from|ip)[a-z]{0,10}[.:# ]{0,3}$"
CUES = {"email": _PLACE, "ip": _PLACE, "card": _NUMBER, "phone": _NUMBER, "secret": _SECRET, "number": _NUMBER}
SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


# -- candidates -------------------------------------------------------------------


def _spans(text: Column, pattern: str) -> Column:
    """All matches with their places, from the pieces between them."""
    def fold(pieces: Column, matches: Column) -> Column:
        def add(acc: Column, m: Column) -> Column:
            i = F.size(acc["spans"])
            start = acc["at"] + F.length(pieces[i])
            end = start + F.length(m)
            span = F.struct(
                start.alias("start"), end.alias("end"), m.alias("match"),
                F.substring(pieces[i], -24, 24).alias("before"), F.substring(pieces[i + 1], 1, 1).alias("after"),
            )
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(matches, start, add, lambda acc: acc["spans"])

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda ms: F.when(F.size(ms) == 0, F.array().cast(SPAN)).otherwise(
            let(F.split(text, pattern, -1), lambda ps: fold(ps, ms))
        ),
    )


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _byte_parts(ip: Column) -> Column:
    return F.forall(
        F.split(ip, r"\."),
        lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))),
    )


def _valid(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        return _byte_parts
    if kind == "card":
        return lambda m: let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return lambda m: F.length(_digits(m)).between(9, 15)
    return lambda m: F.lit(kind == "email")


def _mix(x: Column) -> Column:
    """How many of small letters, capitals and digits there are."""
    return sum((x.rlike(f"[{some}]").cast("int") for some in ("a-z", "A-Z", "0-9")), F.lit(0))


def _variety(x: Column, size: Column) -> Column:
    """Distinct characters against the length, as far as 32 characters can differ."""
    share = F.size(F.array_distinct(F.split(x, ""))) / F.least(size, F.lit(32))
    return F.when(share < 0.3, 0).when(share < 0.6, 1).otherwise(2)


def _generators(text: Column) -> dict[str, tuple[Column, Column, str]]:
    """kind -> (prefilter, text with hopeless characters replaced, pattern)."""
    local, label = "A-Za-z0-9._%+-", "A-Za-z0-9-"
    # A dot that no label follows can't be in a domain; in a local part "_" does as well.
    dotted = F.regexp_replace(text, rf"\.(?![{label}])", "_")
    # A separator counts only between two digits.
    joined = F.regexp_replace(F.regexp_replace(text, "[ -](?![0-9])", "x"), "(?<![0-9])[ -]", "x")
    return {
        "email": (
            text.contains("@"), dotted,
            rf"(?:\G|(?<![{local}]))[{local}]++@[{label}]++\.[A-Za-z0-9.-]++",
        ),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), text, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
        "card": (text.rlike("[0-9][0-9 -]{11}"), joined, "[0-9][0-9 -]{11,}+"),
        "phone": (text.contains("+"), text, r"\+[0-9][ ().0-9-]+[0-9]"),
        "secret": (text.rlike("[A-Za-z0-9_-]{20}"), text, "[A-Za-z0-9_-]{20,}+"),
        "number": (text.rlike("[0-9][0-9 ().-]{5}"), text, "[0-9][0-9 ().-]{5,}[0-9]"),
    }


def candidates(text: Column) -> Column:
    """Array of (start, end, features), by start, end and kind."""
    def describe(kind: str) -> Callable[[Column], Column]:
        def one(s: Column) -> Column:
            size = F.length(s["match"])
            share = F.length(_digits(s["match"])) / size
            touches = F.substring(s["before"], -1, 1).rlike("[A-Za-z0-9_]") | s["after"].rlike("[A-Za-z0-9_]")
            return F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
                _valid(kind)(s["match"]).cast("int").alias("valid"),
                F.when(size < 12, 0).when(size < 20, 1).when(size < 36, 2).otherwise(3).alias("length"),
                F.when(share == 0, 0).when(share < 0.3, 1).when(share < 0.9, 2).otherwise(3).alias("digits"),
                _mix(s["match"]).alias("mix"), _variety(s["match"], size).alias("variety"),
                s["before"].rlike(CUES[kind]).cast("int").alias("cue"),
                touches.cast("int").alias("glued"),
                # The cue where it isn't the label.
                (s["before"].rlike(CUES[kind]) if kind in BASE else F.lit(False)).cast("int").alias("hint"),
            )

        return one

    parts = [
        F.when(may, F.transform(_spans(t, pattern), describe(kind))).otherwise(F.array())
        for kind, (may, t, pattern) in _generators(text).items()
    ]
    return F.coalesce(F.sort_array(F.concat(*parts)), F.array())


def is_base(c: Column) -> Column:
    return (c["kind"] < len(BASE)) & (c["valid"] == 1)


# -- boosting ---------------------------------------------------------------------


@dataclass(frozen=True)
class Split:
    """``feature <= value``, or ``kind == value``."""

    feature: str
    value: int

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, list(FEATURES).index(self.feature)]
        return column == self.value if self.feature == "kind" else column <= self.value

    def column(self, c: Column) -> Column:
        return c[self.feature] == self.value if self.feature == "kind" else c[self.feature] <= self.value


@dataclass
class Trees:
    trees: list
    thresholds: dict[int, float]

    def score(self, c: Column) -> Column:
        """Log odds of a candidate."""
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            split, yes, no = node
            return F.when(split.column(c), walk(yes)).otherwise(walk(no))

        return sum((walk(t) for t in self.trees), F.lit(0.0))

    def adds(self, c: Column) -> Column:
        """Whether a cue word names it, or its score reaches its kind's threshold."""
        least = F.lit(float("inf"))
        for kind, threshold in self.thresholds.items():
            least = F.when(c["kind"] == kind, F.lit(threshold)).otherwise(least)
        return ((c["cue"] == 1) & (c["kind"] >= len(BASE))) | (self.score(c) >= least)


def _predict(node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(x), node)
    split, yes, no = node
    return np.where(split.holds(x), _predict(yes, x), _predict(no, x))


def boost(x: np.ndarray, neg: np.ndarray, pos: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.4) -> list:
    """Trees for cells ``x`` with the given counts; Newton steps on the log loss."""
    splits = [Split(f, v) for f, n in FEATURES.items() for v in range(n if f == "kind" else n - 1)]
    total, f, trees = neg + pos, np.zeros(len(x)), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        value = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
        best = (1e-6, None, None)
        for s in splits if left else []:
            yes, no = rows & s.holds(x), rows & ~s.holds(x)
            if yes.any() and no.any() and (gain := value(yes) + value(no) - value(rows)) > best[0]:
                best = (gain, s, yes)
        if best[1] is None:
            return float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        _, s, yes = best
        return s, grow(yes, g, h, left - 1), grow(rows & ~yes, g, h, left - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = grow(np.ones(len(x), bool), pos - total * p, total * p * (1 - p), depth)
        trees.append(tree)
        f += _predict(tree, x)
    return trees


def calibrate(x: np.ndarray, trees: list, neg: np.ndarray, pos: np.ndarray, precision: float) -> dict[int, float]:
    """Kind -> least score above which ``precision`` of the candidates are positive."""
    scores = sum((_predict(t, x) for t in trees), np.zeros(len(x)))
    out = {}
    for kind in range(len(KINDS)):
        own = x[:, 0] == kind
        for s in sorted(set(np.round(scores[own], 6))):
            above = own & (scores >= s - 1e-6)
            good, all_ = pos[above].sum(), (pos + neg)[above].sum()
            if good and good >= precision * all_:
                out[kind] = float(s - 1e-6)
                break
    return out


def learn(found: DataFrame, precision: float = 0.95) -> Trees:
    """Trees and thresholds from ``found`` (doc_id, candidates)."""
    c = F.col("c")
    label = F.when(c["kind"] < len(BASE), c["valid"]).otherwise(c["cue"])
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    cells = (
        found.select(half.alias("half"), F.explode("candidates").alias("c"))
        .select("half", label.alias("label"), *[c[f].alias(f) for f in FEATURES])
        .groupBy(*FEATURES)
        .agg(*[
            F.count_if((F.col("half") == h) & (F.col("label") == y)).alias(f"n{h}{y}")
            for h in (0, 1) for y in (0, 1)
        ])
        .orderBy(*FEATURES)
    )
    data = np.array([tuple(r) for r in cells.collect()], np.int64).reshape(-1, len(FEATURES) + 4)
    x, n = data[:, : len(FEATURES)], data[:, len(FEATURES) :].astype(float)
    if not len(x):
        return Trees([], {})
    trees = boost(x, n[:, 0], n[:, 1])
    return Trees(trees, calibrate(x, trees, n[:, 2], n[:, 3], precision))


# -- results ------------------------------------------------------------------------


def selected(found: Column, trees: Trees) -> Column:
    """The candidates to redact, by start, kind and end."""
    def choose(all_: Column) -> Column:
        def keep(base: Column) -> Column:
            free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
            added = F.filter(all_, lambda c: ~is_base(c) & trees.adds(c) & free(c))
            ordered = F.transform(
                F.concat(base, added),
                lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")),
            )
            return F.sort_array(ordered)

        return let(F.filter(all_, is_base), keep)

    return let(found, choose)


def _names(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, counts by base kind, base_sha256, spans) of every document."""
    found = cut(docs.select("doc_id", candidates(F.coalesce(F.col("text"), F.lit(""))).alias("candidates")), "pii-candidates")
    trees = learn(found)
    base = F.transform(
        F.filter("candidates", is_base),
        lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")),
    )

    def of_kind(k: int) -> Callable[[Column], Column]:
        # A second parameter of its own would get the place in the array.
        return lambda s: s["kind"] == k

    counts = [F.size(F.filter("base", of_kind(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return (
        found.select("doc_id", F.sort_array(base).alias("base"), selected(F.col("candidates"), trees).alias("all"))
        .select("doc_id", *counts, F.sha2(_names(F.col("base")), 256).alias("base_sha256"), _names(F.col("all")).alias("spans"))
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans go whole, under the kind of the first."""
    def apart(acc: Column, s: Column) -> Column:
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))
        return F.when(s["start"] < acc["at"], longer).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["parts"],
                    F.array(
                        text.substr(acc["at"] + 1, s["start"] - acc["at"]),
                        F.concat(F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(">")),
                    ),
                ).alias("parts"),
            )
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    joined = F.aggregate(
        spans, start, apart,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), text.substr(acc["at"] + 1, F.length(text))),
    )
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(joined)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data in ``text`` replaced; all columns stay."""
    wide = cut(
        docs.select(
            F.struct(*docs.columns).alias("doc"),
            candidates(F.coalesce(F.col("text"), F.lit(""))).alias("candidates"),
        ),
        "docs-with-candidates",
    )
    trees = learn(wide.select(F.col("doc.doc_id").alias("doc_id"), "candidates"))
    text = redacted(F.col("doc.text"), selected(F.col("candidates"), trees))
    return wide.select(*[(text if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])
