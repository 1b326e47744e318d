"""Token id shards, collocations and Merkle manifests against brute force, and their edge cases."""

import hashlib
import os
import random
import re
import sys
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hopmeter.llm import catalog, collocations, common, merkle, tokenfile  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["key", "row", "order", "ids", "tree", "at", "place", "digest", "block", "phrase", "part", "f", "n"]
LONG = "the quick brown fox jumps over the lazy dog, " * 4000


def _docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, long and repeated rows, a null id, and texts the tokenizer must not see split."""
    texts = [
        None, "", " \n\t ", "one", LONG, "ünï ÇÖDÉ 中文 \U0001f600", "one", "x" * 3000, "á e ́b\x0bc\x0cd\x1ce f\xa0g",
        "<|endoftext|> it's<|startoftext|>x A.B,C;D", "ΣΑΣ straße İ",
    ]
    rows = [(i, t, None if i % 4 == 1 else "en", "s" if i % 3 else None, i if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", None, 3), (3, "other", "de", None, 3), (None, "no id", "", "s", 0), (None, "no id", "", "s", 0)]
    return _docs(spark, rows)


# -- token ids ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenfile.vocabulary_file())


def _ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_token_query_equals_the_library(spark, tokenizer):
    docs = sorted((r["doc_id"], r["text"]) for r in common.documents(spark, SF_DIR).select("doc_id", "text").collect())
    got = {r["doc_id"]: tuple(r)[1:] for r in catalog.op11_token_ids(spark, SF_DIR).collect()}
    assert set(got) == {i for i, _ in docs}
    start = 0
    for i, text in docs:
        ids = _ids(tokenizer, text)
        assert got[i] == (start, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_shards_of_odd_rows(spark, odd, tokenizer, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_DOCS", 2)
    store = tokenfile.write(odd, "doc_id", F.col("text"))
    shards = store.shards.orderBy("shard").collect()
    assert len(shards) > 5 and [s["shard"] for s in shards] == list(range(len(shards)))
    found = sorted(((r["start"], r["key"], bytes(r["ids"])) for r in tokenfile.read(store).collect()))
    want = Counter((None if r["doc_id"] is None else str(r["doc_id"]), tuple(_ids(tokenizer, r["text"]))) for r in odd.collect())
    assert Counter((k, tuple(np.frombuffer(ids, "<u4").tolist())) for _, k, ids in found) == want
    keys = [-1 if k is None else int(k) for _, k, _ in found]
    assert keys == sorted(keys)
    ends = np.cumsum([len(ids) // 4 for _, _, ids in found])
    assert [s for s, _, _ in found] == [0, *ends[:-1].tolist()]

    asked = spark.createDataFrame([(3,), (8,), (3,), (77,), (None,), (-5,)], "key long")
    got = Counter(r["key"] for r in tokenfile.fetch(store, asked).collect())
    assert got == {"3": 3, "8": 1, None: 2}


def test_token_store_of_text_keys_and_of_nothing(spark, odd):
    named = odd.filter("doc_id IS NOT NULL").select(F.concat(F.lit("kéy "), "doc_id").alias("name"), "text").distinct()
    store = tokenfile.write(named, "name", F.col("text"))
    got = {r["key"] for r in tokenfile.fetch(store, named.select(F.col("name").alias("key"))).collect()}
    assert got == {r["name"] for r in named.collect()}
    nothing = tokenfile.write(odd.limit(0), "doc_id", F.col("text"))
    assert tokenfile.read(nothing).count() == 0
    assert tokenfile.fetch(nothing, spark.createDataFrame([(1,)], "key long")).count() == 0


def test_encoding_by_words_is_that_of_whole_texts(tokenizer):
    rng = random.Random(1)
    letters = "aBz'é́ñ,.<=>*-̸ \t\x0b\x1c0¼中İΣ| \xa0sS’“क़ẹᄀ\u1161ſ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([2, 3, 4, 30]))) for _ in range(20_000)]
    got = tokenfile.Encoder(tokenfile.vocabulary_file(), 2, "<u2").texts(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u2").tolist() == _ids(tokenizer, text), ascii(text)


def test_hash_is_perfect_and_minimal():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 65, 20_000):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        index = tokenfile.make_hash(hashes)
        assert sorted(tokenfile.slots(index, hashes).tolist()) == list(range(len(hashes)))
    keys = [tokenfile.key_bytes(str(i)) for i in range(5000) for _ in range(1 + i % 3)]
    index = tokenfile.make_index(keys, np.ones(len(keys), np.int64))
    first, runs = tokenfile.look_up(index, [tokenfile.key_bytes(str(i)) for i in range(5000)])
    assert runs.tolist() == [1 + i % 3 for i in range(5000)]
    assert [keys[f] for f in first.tolist()] == [tokenfile.key_bytes(str(i)) for i in range(5000)]
    assert tokenfile.look_up(index, [b"=x%d" % i for i in range(5000)])[1].sum() == 0


# -- collocations -----------------------------------------------------------------------


def _mined(rows, least, top):
    lower = {c: c + 32 for c in range(65, 91)}
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {
            p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
            if (i, j) != (0, len(p)) and 100 * a >= 100 * often[p[i:j]]
        }
        ranked = []
        for p, a in often.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                phrase = " ".join(p)
                ranked.append((-score, -a, phrase.encode(), phrase, a, c[p[:k]], c[p[k:]], n[lang], score))
        out += [(lang, i, *r[3:]) for i, r in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("entries", [None, 300])
def test_collocations_against_brute_force(spark, monkeypatch, entries):
    """Also with tries that burst, spill and forget their words at every turn."""
    if entries:
        for name, value in (("ENTRIES", entries), ("BURST", 5), ("WORDS", 400), ("PORTION", 500), ("PART_BYTES", 1000)):
            monkeypatch.setattr(collocations, name, value)
    rng = random.Random(5)
    words = ["A", "b", "cé", "D d", "x-y", "|", "\x00", "z\x1c"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "!,"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [(rng.choice(["en", "de", None]), t) for t in texts]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = sorted(tuple(r) for r in collocations.mine(docs, least=4, top=50).collect())
    assert got == _mined(rows, 4, 50) and len(got) > 100


def test_collocation_query_and_odd_rows(spark, odd):
    rows = [tuple(r) for r in common.documents(spark, SF_DIR).select("lang", "text").collect()]
    got = sorted(tuple(r) for r in catalog.op12_collocations(spark, SF_DIR).collect())
    assert got == _mined(rows, 100, 2000)
    own = [tuple(r) for r in odd.select("lang", "text").collect()]
    assert sorted(tuple(r) for r in collocations.mine(odd).collect()) == _mined(own, 100, 2000)
    assert collocations.mine(odd.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(1, 10**15) for _ in range(2)) + tuple(rng.randrange(10**13, 10**15) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.select("*", collocations.score(*map(F.col, ("a", "n", "l", "r"))).alias("s")).collect()
    assert all(r["s"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in got)


# -- Merkle manifests -------------------------------------------------------------------


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    return _hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_hash(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def _path(levels, at):
    for level in levels[:-1]:
        beside = at ^ 1
        yield level[beside] if beside < len(level) else None, beside < at
        at >>= 1


def _proved(rows):
    """The query's rows by recursion over whole lists."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([leaf for *_, leaf, _ in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    crown = _tree([trees[g][-1][0] for g in names])
    for j, g in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = [*_path(trees[g], i), *_path(crown, j)]
            changed = r[3] is not None and crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 0
            at = _leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf
            for beside, left in steps:
                at = _hash(beside, at) if beside and left else _hash(at, beside or "")
            root = crown[-1][0]
            yield (r[0], leaf, trees[g][-1][0], root, _hash(*[b for b, _ in steps if b]), at, at == root)


@pytest.mark.parametrize("height", [10, 2, 1])
def test_merkle_query_against_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    got = sorted(tuple(r) for r in catalog.op13_merkle(spark, SF_DIR).collect())
    rows = [tuple(r) for r in common.documents(spark, SF_DIR).select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got == sorted(_proved(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4


def test_merkle_of_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is not None, r)
    got = sorted((tuple(r) for r in catalog.op13_merkle(spark, str(tmp_path)).collect()), key=key)
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got == sorted(_proved(rows), key=key)
    fields = [F.col("doc_id"), F.col("text")]
    empty = merkle.build(odd.limit(0), fields, F.col("lang"), F.col("doc_id"))
    assert merkle.proofs(empty).count() == 0 and empty.root().count() == 0
    one = merkle.build(odd.filter("doc_id = 4"), fields, F.col("lang"), F.col("doc_id"))
    row = merkle.proofs(one).first()
    assert row["steps"] == [] and row["leaf"] == row["subroot"] == row["root"] == one.root().first()["root"]


def test_layout_addresses_are_a_permutation_of_recursive_halves():
    for levels in range(1, 12):
        at = np.concatenate([merkle.address(levels, d, np.arange(1 << d)) for d in range(levels)])
        assert sorted(at.tolist()) == list(range((1 << levels) - 1))
    # Four levels: the upper half's three nodes, then four lower subtrees of three.
    assert merkle.address(4, 2, np.arange(4)).tolist() == [3, 6, 9, 12]
    assert merkle.address(4, 3, np.arange(8)).tolist() == [4, 5, 7, 8, 10, 11, 13, 14]
