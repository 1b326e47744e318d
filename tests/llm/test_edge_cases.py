"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import os
import random
import re
import sys
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

import corpus_pipeline  # noqa: E402
from hopmeter import session  # noqa: E402
from hopmeter.llm import (  # noqa: E402
    bpe, components, decontam, langid, licenses, lm, pii, quality, shards, simhash, urlrules,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use in tables of their own.
CLASH = ["row", "fp", "s", "doc", "candidates", "drawn", "first", "component_id", "word", "task"]
LONG = "the quick brown fox jumps over the lazy dog " * 4000


def _docs(spark, texts, start=0):
    rows = [(None if t == "no id" else start + i, t, "en", "x", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, short, long, repeated and id-less rows."""
    docs = _docs(spark, [None, "", " \n\t ", "one", LONG, "ünï ÇÖDÉ 中文 \U0001f600", "no id", "one", "x" * 3000])
    return docs.unionByName(docs.filter("doc_id in (3, 0)"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1), (4, None), (99, 0), (3, 0)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "lazy dog the quick brown"), (3, "one")], "item_id long, text string")


OPERATORS = {
    "quality": lambda d, labels, items: quality.judge(d, labels),
    "keep_good": lambda d, labels, items: quality.keep_good(d, labels),
    "shards": lambda d, labels, items: shards.assign(d, 4),
    "decontam": lambda d, labels, items: decontam.contaminated(d, items),
    "clean": lambda d, labels, items: decontam.clean(d, items),
    "simhash": lambda d, labels, items: simhash.near_duplicates(d),
    "keep_one": lambda d, labels, items: simhash.keep_one(d),
    "lm": lambda d, labels, items: lm.score(d, fit_tokens=500),
    "bpe": lambda d, labels, items: d.select("doc_id", bpe.digests(F.col("text")).alias("d")),
    "pii": lambda d, labels, items: pii.find(d),
    "redact": lambda d, labels, items: pii.redact(d),
    "langid": lambda d, labels, items: langid.identify(d),
    "licenses": lambda d, labels, items: d.select("doc_id", licenses.license_scan(F.col("text")).alias("l")),
}
ALL_ROWS = ["quality", "shards", "simhash", "lm", "bpe", "pii", "redact", "langid", "licenses"]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_table(spark, odd, labels, items, name):
    rows = OPERATORS[name](odd, labels, items).collect()
    if name in ALL_ROWS:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    nothing = OPERATORS[name](odd.limit(0), labels.limit(0), items.limit(0))
    assert nothing.count() == 0


def test_stages_keep_columns_and_rows_of_their_input(spark, tmp_path, odd, labels, items):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, str(tmp_path))
            assert got.columns == docs.columns and got.count() <= docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).collect()
    assert len(last) == odd.count() and all(r["round_trip"] for r in last)


# -- 1 ----------------------------------------------------------------------------


def _fits(host, path, rule_host, rule_path):
    return (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path)


def test_url_rules_against_brute_force(spark):
    rng = random.Random(2)
    part = lambda: rng.choice(["a", "b", "ab", "www"])
    host = lambda n: ".".join(part() for _ in range(rng.randrange(1, n)))
    path = lambda: "".join(rng.choice(["/", "/a", "x", ""]) for _ in range(rng.randrange(4)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(4), path()) for _ in range(40))}.values())
    urls = [f"http://{'a.b' if rng.random() < 0.4 else host(5)}{path()}{rng.choice(['', '?q=1', '#f'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "HTTP://A.B/x", "x://", "x://?q", "http://b.ab./x", "x://" + "a." * 300 + "b/" + "y" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: r for r in urlrules.judge(pages, frame, "none").collect()}
    assert len(got) == len(urls)
    for n, url in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        h, p = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(rh + rp), len(rh), rh + rp, v) for rh, rp, v in rules if _fits(h, p, rh, rp)]
        want = max(fits)[2:] if fits else (None, "none")
        assert (got[n]["host"], got[n]["path"], got[n]["rule"], got[n]["verdict"]) == (h, p, *want)
    empty = urlrules.judge(pages, frame.limit(0)).collect()
    assert len(empty) == len(urls) and {r["verdict"] for r in empty} == {"allow"}
    assert urlrules.judge(pages.limit(0), frame).count() == 0
    twice = urlrules.judge(pages, frame.union(frame).withColumn("verdict", F.lit("allow")).union(
        frame.withColumn("verdict", F.lit("block")))).filter("rule is not null")
    assert {r["verdict"] for r in twice.collect()} == {"block"}


# -- 2 ----------------------------------------------------------------------------


def test_decision_list_finds_planted_rules(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(f"word{rng.integers(1000)}" for _ in range(40)) for _ in range(150)]
    bad = ["## $$ " + g + " ###" for g in good[:60]] + [g.upper() for g in good[60:120]]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < len(good)).cast("int").alias("quality"))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert all(got[i] for i in range(len(good))) and not any(got[i] for i in range(len(good), len(got)))


# -- 3 ----------------------------------------------------------------------------


def test_tree_moves_documents_only_into_what_grew(spark):
    leaf = lambda n, w, s: shards.Node(n, w, shard=s)

    def tree(weight):
        a = shards.Node("ra", 3.0, (leaf("s0", 1.0, 0), leaf("s1", 2.0, 1)))
        b = shards.Node("rb", 1.0 + weight, (leaf("s2", 1.0, 2), leaf("s3", weight, 3)))
        return shards.Node("root", 4.0 + weight, (a, b))

    ids = spark.range(20_000)
    rows = ids.select(*[shards.shard_of(F.col("id"), tree(w)).alias(n) for w, n in ((1.0, "before"), (3.0, "after"))])
    share = Counter(r["before"] for r in rows.collect())
    assert all(abs(share[s] / 20_000 - w / 5) < 0.02 for s, w in enumerate([1, 2, 1, 1]))
    moved = {(r["before"], r["after"]) for r in rows.filter("before <> after").collect()}
    # Nothing moves within the region that stayed, nor back into it.
    assert all(after in (2, 3) and (before, after) != (3, 2) for before, after in moved)


# -- 4 ----------------------------------------------------------------------------


def _distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_edit_matching_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 8)))
    items = [" ".join(word() for _ in range(rng.randrange(2, 25))) for _ in range(25)]

    def spoiled(text, edits):
        chars = list(text)
        for _ in range(edits):
            k = rng.randrange(len(chars))
            rng.choice([lambda: chars.pop(k), lambda: chars.insert(k, "z"), lambda: chars.__setitem__(k, "y")])()
        return "".join(chars)

    docs = [
        " ".join([word(), spoiled(rng.choice(items), rng.randrange(0, 12)).upper(), word()] + [word() for _ in range(30)])
        for _ in range(80)
    ]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, doc in enumerate(docs):
        for n, item in enumerate(items):
            d = _distance(decontam.normal(item), decontam.normal(doc))
            if d <= decontam.edit_budget(len(decontam.normal(item)), decontam.RATE):
                want.add((i, n, d))
    assert any(d for _, _, d in want)
    for block in (4_000_000, 300):
        assert {tuple(r) for r in decontam.contaminated(frame, tests, block_chars=block).collect()} == want
    kept = {r["doc_id"] for r in decontam.clean(frame, tests).collect()}
    assert kept == set(range(len(docs))) - {i for i, _, _ in want}


# -- 5 ----------------------------------------------------------------------------


def test_links_against_brute_force_and_components(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(60)]
    values = {0, 7, 2**64 - 1}
    for c in centres:
        for _ in range(12):
            v = c
            for _ in range(rng.randrange(6)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert {tuple(r) for r in simhash.links(frame).collect()} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201)], "a long, b long")
    label = {r["node"]: r["label"] for r in components.components(chain).collect()}
    assert label == {i: 0 for i in range(61)} | {200: 200, 201: 200}


def test_golay_indices_meet_within_one_bit():
    code, rng = simhash.Golay(), np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 300)
    near = code.near(words)
    assert max(len(set(r)) for r in near.tolist()) <= 6
    for bit in range(23):
        assert all(i in r for i, r in zip(code.index(words ^ 1 << bit).tolist(), near.tolist()))


def test_one_row_of_a_group_stays(spark):
    docs = _docs(spark, [LONG, LONG, "a b c d", "a b c d", "a b c e f g h"])
    docs = docs.union(docs.filter("doc_id = 2"))
    got = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    assert got == [0, 2, 4]


def test_similar_texts_are_one_group_and_others_stay(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    texts, group = [], []
    for g in range(30):
        base = [word() for _ in range(rng.choice([60, 300, 900]))]
        for edits in (0, 0, 1, 1, 2):
            copy = list(base)
            for _ in range(edits * len(base) // 300 + (edits > 0)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            group.append(g)
        # A text that shares half its words is no near copy.
        half = base[: len(base) // 2] + [word() for _ in range(len(base) // 2)]
        texts.append(" ".join(half))
        group.append(1000 + g)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(_docs(spark, texts)).collect())
    assert kept == [group.index(g) for g in sorted(set(group), key=group.index)]


def _shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _similarity(a, b):
    return len(a & b) / len(a | b)


def _kept_by_brute_force(texts):
    """Smallest index of each component of texts with a similarity of 0.8, or a fingerprint within 3 bits."""
    sets, fps = [_shingles(t) for t in texts], [simhash.fingerprint_of(t) for t in texts]
    of = list(range(len(texts)))

    def root(i):
        while of[i] != i:
            of[i] = i = of[of[i]]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and ((fps[i] ^ fps[j]).bit_count() <= 3 or _similarity(sets[i], sets[j]) >= 0.8):
                of[max(root(i), root(j))] = min(root(i), root(j))
    return sorted({root(i) for i in range(len(texts))})


def _grown(rng, size, words, share):
    """Texts that are each a copy of a random earlier one with a share of its words changed."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    texts = [[word() for _ in range(words)]]
    for _ in range(size - 1):
        copy = list(rng.choice(texts))
        for at in rng.sample(range(words), round(share * words)):
            copy[at] = word()
        texts.append(copy)
    return [" ".join(t) for t in texts]


def test_groups_grown_copy_from_copy_are_one_class(spark):
    rng = random.Random(21)
    # With at most 128 shingles in a union the sketch is exact, so any link lost is a comparison not made.
    texts = [t for share in (0.01, 0.01, 0.02) for t in _grown(rng, 200, 110, share)]
    want = _kept_by_brute_force(texts)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(_docs(spark, texts)).collect())
    assert kept == want


@pytest.mark.parametrize("block", [512, 16])
def test_crowded_keys_are_compared_in_blocks(spark, monkeypatch, block):
    """A large group that hangs together by its keys, of which few pairs are similar, beside one that grew."""
    monkeypatch.setattr(simhash, "CROWD", 4)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "COLUMNS", 100)
    rng = random.Random(25)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    base, texts = [word() for _ in range(150)], []
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            copy[at] = word()
        texts.append(" ".join(copy))
    texts += _grown(rng, 60, 120, 0.02) + ["", "a b"]
    want = _kept_by_brute_force(texts)
    assert 10 < len(want) < 180
    assert sorted(r["doc_id"] for r in simhash.keep_one(_docs(spark, texts)).collect()) == want


def test_texts_that_differ_in_a_run_of_words_meet(spark):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    texts = []
    for _ in range(80):
        base = [word() for _ in range(899)]
        at, n = rng.randrange(800), rng.randrange(60, 96)
        texts += [" ".join(base), " ".join([*base[:at], *(word() for _ in range(n)), *base[at + n :]])]
    similar = [_similarity(_shingles(a), _shingles(b)) >= 0.8 for a, b in zip(texts[::2], texts[1::2])]
    kept = {r["doc_id"] for r in simhash.keep_one(_docs(spark, texts)).collect()}
    gone = [2 * i + 1 not in kept for i in range(80)]
    assert not any(g and not s for g, s in zip(gone, similar))
    assert sum(similar) > 60 and sum(gone) >= 0.95 * sum(similar)


def test_similarity_is_judged_by_all_shingles(spark):
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    texts = []
    # Pairs around the limit: 19 words changed here and there leave a similarity of 0.81, 20 one of 0.799.
    for changed in [18, 19, 20, 21] * 20:
        base = [word() for _ in range(899)]
        copy = list(base)
        for at in rng.sample(range(10, 890, 10), changed):
            copy[at] = word()
        texts += [" ".join(base), " ".join(copy)]
    sets = [_shingles(t) for t in texts]
    bits = lambda i: (simhash.fingerprint_of(texts[i]) ^ simhash.fingerprint_of(texts[i + 1])).bit_count()
    exact = [_similarity(sets[i], sets[i + 1]) >= 0.8 or bits(i) <= 3 for i in range(0, len(texts), 2)]
    assert 20 < sum(exact) < 60
    kept = {r["doc_id"] for r in simhash.keep_one(_docs(spark, texts)).collect()}
    gone = [2 * i + 1 not in kept for i in range(len(exact))]
    assert not any(g and not e for g, e in zip(gone, exact))
    # A pair that meets on no key stays.
    assert sum(e and not g for g, e in zip(gone, exact)) <= 3


def test_sketches_give_the_jaccard_similarity(spark):
    rng = random.Random(3)
    sets = []
    for _ in range(60):
        universe = [f"w{i}" for i in range(rng.choice([30, 400, 3000]))]
        a = universe[: rng.randrange(6, len(universe))]
        b = universe[rng.randrange(len(a) // 2) :]
        sets.append((" ".join(a), " ".join(b)))
    frame = spark.createDataFrame(sets, "a string, b string").select("a", "b", *[
        simhash.prints(F.col(c))["sketch"].alias(f"s{c}") for c in "ab"])
    for r in frame.select("a", "b", simhash.similarity(F.col("sa"), F.col("sb")).alias("j")).collect():
        a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r["a"].split(), r["b"].split()))
        exact = len(a & b) / len(a | b)
        assert abs(r["j"] - exact) <= (1e-9 if len(a | b) <= simhash.SKETCH else 0.12)


# -- 6 ----------------------------------------------------------------------------


def test_language_model_bases_and_totals(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["The", "cat", "sat", "on", "mat."]) for _ in range(rng.randrange(30))) for _ in range(150)]
    texts += [None, "", LONG + " unseen"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {i for i in range(len(texts)) if crc32(str(i).encode()) % 10 == 0}
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in enumerate(texts)}
    c = Counter(w for i, ts in tokens.items() if i not in held for w in ts)
    total, v = sum(c.values()), len(c)
    # A head of three words sends all others through the join.
    for head in (3, 50_000):
        for r in lm.score(frame, head_words=head, fit_tokens=5000).collect():
            ts = tokens[r["doc_id"]]
            base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in ts)
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
                r["doc_id"] in held, len(ts), sum(c[w] > 0 for w in ts), total)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_network_probabilities_add_up_and_state_is_carried():
    rng = np.random.default_rng(3)
    share = rng.random(lm.UNITS)
    docs = [rng.integers(0, lm.UNITS, n) for n in (200, 1, 65, 64, 300)]
    net = lm.train(docs, 0, share / share.sum(), updates=2000)
    states = rng.normal(0, 1, (3, lm.HIDDEN)).astype(np.float32)
    for s in states:
        p = np.exp(net.log_probability(np.repeat(s[None], lm.UNITS, 0), np.arange(lm.UNITS)))
        assert abs(p.sum() - 1) < 1e-4
    together = lm.score_units(net, docs, 0)
    for d, want in zip(docs, together):
        h, given, total = np.zeros((1, lm.HIDDEN), np.float32), 0, 0.0
        for u in d:
            out, h = net.run(np.array([[given]]), np.ones((1, 1), np.float32), h)
            total += net.log_probability(out[0], np.array([u]))[0]
            given = u
        assert math.isclose(total, want, rel_tol=1e-4)


# -- 7 ----------------------------------------------------------------------------


def test_codec_and_higher_order_functions_against_the_library(spark):
    data = bpe.rank_file()
    codec = bpe.Codec(data, public_tokenizers.PATTERN)
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(data), special_tokens={}
    )
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab the'llé中\U0001f600\n \t  x1²_-.́!") for _ in range(rng.randrange(120))) for _ in range(600)]
    texts += ["the" * 3000 + "qzx" * 500, "a b " * 40_000, "<|endoftext|>", "\x00\x7f"]
    assert codec.encode_all(texts) == [own.encode_ordinary(t) for t in texts]
    assert all(codec.decode(codec.encode(t)) == t.encode() for t in texts)
    words = sorted({w for t in texts[:200] for w in codec.split.findall(t)})
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    native = frame.select("w", bpe.encode_words(F.col("w").cast("binary"), bpe.rank_map(data)).alias("ids")).collect()
    assert all(list(r["ids"]) == own.encode_ordinary(r["w"]) for r in native)
    ids = frame.select("w", bpe.token_ids(F.col("w")).alias("ids"))
    assert ids.select("w", bpe.decoded(F.col("ids")).cast("string").alias("t")).filter("w <> t").count() == 0


# -- 8 ----------------------------------------------------------------------------

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def _plain_spans(text):
    out = []
    for kind, pattern in zip(pii.BASE, PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
            ok = {
                "email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), pii.BASE.index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


def test_spans_against_plain_patterns(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("0123456789 -.+@ab_%()é\U0001f600") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["a." * 30 + "@b..c.de", "9" * 5000, "1 " * 9000, "a@" + "b." * 9000 + "c", "4111 1111 1111 1111 and 004.1.1.1",
              "mail x.y@z.org, call +1 (555) 010-9999", 'token = "0123456789abcdef0123456789abcdef01234567" end']
    texts += [f'the api key: "{rng.getrandbits(160):040x}" is here {i}' for i in range(60)] + [f"hash {rng.getrandbits(160):040x}" for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in pii.find(frame).collect()}
    for i, t in enumerate(texts):
        base = _plain_spans(t)
        assert [s for s in got[i] if s.split(":")[0] in pii.BASE and s in base] == base
        starts = [int(s.split(":")[1]) for s in got[i]]
        assert starts == sorted(starts)
    with_key = [got[i] for i, t in enumerate(texts) if "api key" in t]
    assert all(any(s.startswith("secret:") for s in g) for g in with_key)
    assert not any(s.startswith("secret:") for i, t in enumerate(texts) if t.startswith("hash") for s in got[i])
    red = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert red[texts.index("mail x.y@z.org, call +1 (555) 010-9999")] == "mail <email>, call <phone>"
    for i, t in enumerate(texts):
        cuts = sorted((int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in got[i])
        out, at = "", 0
        for a, b, kind in cuts:
            if a >= at:
                out, at = out + t[at:a] + f"<{kind}>", b
        assert red[i] == out + t[at:]


def test_overlapping_spans_leave_nothing_of_either(spark):
    texts = ["see 10.0.0.0 4111 1111 1111 1111 end", "plain"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    red = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert red == {0: "see <ip> end", 1: "plain"}
    spans = F.expr("array(struct(0 start, 0 kind, 9 end), struct(2 start, 1 kind, 5 end), struct(7 start, 4 kind, 12 end), struct(12 start, 5 kind, 14 end))")
    got = spark.createDataFrame([("abcdefghijklmnop",)], "t string").select(pii.redacted(F.col("t"), spans)).first()[0]
    assert got == "<email><number>op"


# -- 9 ----------------------------------------------------------------------------


def test_tables_equal_the_convolution_and_und(spark):
    rng = np.random.default_rng(2)
    net = langid.ByteNet.fresh(["x", "y", "z"], rng)
    windows = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    got = langid.Predictor(net).windows(windows)
    for w, p in zip(windows, got):
        e = net.embed[w]
        h = np.concatenate([
            np.max([e[i : i + n].reshape(-1) @ k for i in range(langid.WINDOW - n + 1)], axis=0)
            for n, k in zip(langid.WIDTHS, net.filters)
        ])
        logits = np.maximum(h + net.bias, 0) @ net.dense + net.offset
        want = np.exp(logits - logits.max())
        assert np.allclose(p, want / want.sum(), atol=1e-4)
    rows = langid.identify(spark.createDataFrame(
        [(1, None, "en"), (2, "12 !?", "en"), (3, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in rows} == {"und"} and all(r["score"] == 0 for r in rows)


# -- 10 ---------------------------------------------------------------------------


def test_template_automata():
    a = licenses.Automaton("granted <<optional>>free of<<end>> charge to <<replace:1-2>> here")
    run = lambda t: a.accepts_at(licenses.tokens_of(t), 0)
    assert run("Granted charge to you here") == 5
    assert run("granted free of charge to you all here.") == 8
    assert run("granted free charge to you here") == 0
    assert run("granted charge to a b c here") == 0
    assert run("granted charge to") == 0
    for bad in ("<<optional>>x", "<<optional>>x<<end>>", "<<other>> y"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES).scan
    assert scan("Licensed under CC BY-NC 4.0.")[4:6] == ("cc-by", "cc-by,cc-by-nc")
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
           "and associated documentation files (the Software)")
    assert scan(mit)[4:6] == ("", "mit") and scan(mit.replace("hereby", "not"))[5] == ""
    assert scan("mit license mit license")[:4] == (4, 2, 0, 2)


def test_license_texts_and_texts_with_one_word_changed():
    """Every template in full is found under its label; with any mandatory word changed its own automaton refuses it."""
    rng = random.Random(4)
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES).scan
    for label, markups in licenses.TEMPLATES.items():
        for markup in markups:
            plain = re.sub(r"<<replace:(\d+)-(\d+)>>", lambda m: "anyone " * int(m[2]), markup)
            whole = re.sub(r"<<optional>>|<<end>>", " ", plain)
            bare = plain
            while "<<optional>>" in bare:
                bare = re.sub(r"<<optional>>((?!<<optional>>).)*?<<end>>", " ", bare)
            automaton = licenses.Automaton(markup)
            for text in (whole, bare):
                words = licenses.tokens_of(text)
                assert automaton.accepts_at(words, 0) == len(words)
                assert label in scan(f"Before it: {text.upper()}. And more")[5].split(",")
            words = licenses.tokens_of(bare)
            fixed = [i for i, w in enumerate(words) if w != b"anyone"]
            for at in rng.sample(fixed, min(6, len(fixed))):
                assert automaton.accepts_at([*words[:at], b"otherwise", *words[at + 1 :]], 0) == 0
    assert scan("a " * 50)[6] == 0.0 and scan("the mit license")[6] == 0.5


def test_templates_that_no_word_begins_are_refused():
    for markup in ("<<replace:1-2>> mit license", "<<replace:0-1>> mit license", "<<optional>><<replace:1-1>><<end>> mit"):
        with pytest.raises(ValueError):
            licenses.Automaton(markup)


def test_secrets_and_numbers_are_found_without_a_cue(spark):
    """Recall of planted spans with a cue word before them and without; words and plain figures stay."""
    rng = random.Random(9)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    secret = lambda: "".join(rng.choice(chars) for _ in range(rng.randrange(24, 40)))
    words = lambda: " ".join(rng.choice(["plain", "words", "of", "no", "account"]) for _ in range(12))
    texts, planted = [], []
    for i in range(600):
        kind = ("cue", "bare", "clean")[i % 3]
        s = secret() if kind != "clean" else "-".join(["incomprehensibilities"] * 2)
        lead = 'token = "' if kind == "cue" else "see "
        texts.append(f"{words()} {lead}{s} {words()}")
        planted.append((kind, s))
    rows = pii.find(_docs(spark, texts)).collect()
    spans = {r["doc_id"]: r["spans"] for r in rows}
    found = Counter()
    for i, (kind, s) in enumerate(planted):
        at = texts[i].index(s)
        found[kind] += f"secret:{at}:{at + len(s)}" in spans[i].split(",")
    assert found["cue"] == 200 and found["clean"] == 0
    # Half of what looks like a secret has no cue, so the weak label says "no" for it: not certain enough.
    few = [i for i, (kind, _) in enumerate(planted) if kind != "bare" or i % 60 == 1]
    rows = pii.find(_docs(spark, [texts[i] for i in few])).collect()
    spans = {few[r["doc_id"]]: r["spans"] for r in rows}
    bare = [i for i in few if planted[i][0] == "bare"]
    hits = sum("secret:" in spans[i] for i in bare)
    assert len(bare) == 10 and hits >= 5
    assert not any("secret:" in spans[i] for i in few if planted[i][0] == "clean")


def test_items_of_any_id_type_and_in_several_blocks(spark):
    words = "the quick brown fox jumps over the lazy dog and runs away from all of the hounds".split()
    items = [(f"item {i}", " ".join(words[i : i + 8])) for i in range(6)]
    docs = _docs(spark, [" ".join(words), "nothing of the kind", None, items[2][1]])
    frame = spark.createDataFrame(items, "item_id string, text string")
    want = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.contaminated(docs, frame).collect())
    assert {i for d, i, _ in want if d == 0} == {i for i, _ in items}
    got = decontam.contaminated(docs, frame, block_chars=60)
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()) == want
    for chars in (60, 10**6):
        assert sorted(r["doc_id"] for r in decontam.clean(docs, frame, block_chars=chars).collect()) == [1, 2]


def test_url_rules_over_pages_with_names_of_their_own(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, None)], "page_id long, url string")
    clash = ["k", "row", "open", "host", "path", "rule", "verdict", "stack", "task", "kind"]
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    plain = sorted(urlrules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect(), key=str)
    odd = urlrules.judge(pages.select("*", *[F.lit("z").alias(c) for c in clash]), rules)
    assert sorted(odd.select("page_id", "host", "path", "rule", "verdict").collect(), key=str) == plain
    assert [r["verdict"] for r in plain].count("block") == 2


def test_every_language_is_learned_however_many(spark):
    """More languages than a limit would let through, and rare ones beside frequent ones."""
    rng = random.Random(3)
    rows = []
    for n in range(12):
        letters = "".join(chr(0x61 + 2 * n + j) if n < 12 else "" for j in range(2)) + chr(0x3B1 + n)
        for _ in range(40 if n else 200):
            rows.append((len(rows), " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(30)), f"l{n}", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    data, langs = langid.labelled_windows(docs, 20, 2)
    seen = Counter(langs)
    assert len(seen) == 12 and max(seen.values()) <= 80 and len(data) == len(langs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, per_language=20).collect()}
    assert sum(got[i] == lang for i, _, lang, _, _ in rows) >= 0.95 * len(rows)


def test_a_large_class_does_not_meet_the_others_of_its_key_one_by_one(spark):
    words = ["array(0L, 0L, 0L) AS words", "CAST(array() AS array<bigint>) AS bands"]
    at = spark.range(320).selectExpr("id AS fp", "IF(id < 300, 0L, IF(id < 310, 300L, id)) AS label", "10L AS n", *words)
    crowded = simhash._crowded(at)
    # 12 labels are few, but 20 fingerprints share their keys with 300 of another label.
    assert crowded.count() > 0 and simhash._met_all(at, crowded).count() == 0
    few = at.filter("fp < 3 OR fp >= 318")
    assert simhash._crowded(few).count() == 0 and simhash._met_all(few, simhash._crowded(few)).count() == 7


def test_near_copies_leave_no_tables_of_their_rounds(spark):
    """Each round's tables go with the round, so the disk taken doesn't grow with their number."""
    folder = session._own_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rng = random.Random(31)
    texts = _grown(rng, 30, 110, 0.02) + ["", "a b", "a b"]
    kept = sorted(r["doc_id"] for r in simhash.keep_one(_docs(spark, texts)).collect())
    assert kept == _kept_by_brute_force(texts)
    assert sorted(name[:-33] for name in set(os.listdir(folder)) - before) == ["docs-numbered", "rows-kept"]


def test_only_keys_that_bring_others_together_are_handed_on(spark):
    rng = random.Random(32)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    texts = [" ".join(word() for _ in range(120)) for _ in range(40)]
    texts.append(texts[0].rpartition(" ")[0] + " other")
    at = _docs(spark, texts).select("doc_id", simhash.prints(F.col("text")).alias("p")).select("doc_id", "p.*")
    asks, members = (side.collect() for side in simhash.shared_keys(at))
    plain = {(r["key"], r["fp"]) for r in simhash._word_keys(at, False).collect()}
    fuzzy = {(r["key"], r["fp"]) for r in simhash._word_keys(at, True).collect()}
    owners = defaultdict(set)
    for key, fp in plain:
        owners[key].add(fp)
    want = {(key, fp) for key, fp in fuzzy if owners[key] - {fp}}
    assert {(r["key"], r["fp"]) for r in asks} == want and len(asks) == len(want)
    assert {(r["key"], r["fp"]) for r in members} == {(key, fp) for key, fp in plain if key in {k for k, _ in want}}
    assert 0 < len(want) < len(fuzzy) / 10


def test_a_failed_step_forgets_its_tables(spark):
    def fails():
        session.cut(spark.range(3), "probe")
        raise ValueError("no")

    with pytest.raises(ValueError):
        session.settle(spark, fails, "never")
    inner = []

    def nested():
        inner.append(session.settle(spark, lambda: session.cut(spark.range(3), "a").filter("id > 0"), "b"))
        return inner[0].filter("id > 1")

    assert [r[0] for r in session.settle(spark, nested, "c").collect()] == [2]
    assert not session._SCRATCH.calls and not any(n.startswith(("a-", "b-")) for n in os.listdir(session._own_folder(spark).removeprefix("file://")))
