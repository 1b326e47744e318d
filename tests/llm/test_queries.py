"""Registered queries over whole small tables, against SQL or a brute-force version."""

import hashlib
import math
import os
import re
import sys
from collections import Counter
from zlib import crc32

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
import xxhash  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from compare import connect, differences  # noqa: E402

import corpus_pipeline  # noqa: E402
from hopmeter.llm import bpe, catalog, common, decontam, lm, pii  # noqa: E402
from tests.llm.test_edge_cases import _plain_spans  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in common.documents(spark, SF_DIR).collect()}


def _by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = catalog.queries()[name](spark, SF_DIR)
    assert differences(df, connect(SF_DIR), catalog.oracle_sql()[name]) is None


def test_registered_with_the_others():
    import __spark_entry__ as contract

    names = set(contract.queries())
    assert set(catalog.queries()) | {"pipeline"} <= names
    assert {re.match(r"op(\d+)_", n)[1] for n in catalog.queries()} == {str(n) for n in range(1, 14)}


def test_quality(spark, docs):
    got = _by_id(catalog.op2_quality(spark, SF_DIR))
    assert set(got) == set(docs)
    for i, text in docs.items():
        r, words = got[i], re.findall(SPACE, text)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if re.search(SPACE, x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["rule"] is None)


def test_shards(spark, docs):
    rows = catalog.op3_shards(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    slots = {}
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_simhash(spark, docs):
    got = _by_id(catalog.op5_simhash(spark, SF_DIR))
    prints = {}
    for i, text in docs.items():
        words = [w.encode() for w in re.findall(SPACE, text.translate({c: c + 32 for c in range(65, 91)}))]
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i]["fingerprint"] == f"{prints[i]:016x}"
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert {i: r["component_id"] for i, r in got.items()} == root


def test_byte_bpe(spark, docs):
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.rank_file()), special_tokens={}
    )
    got = _by_id(catalog.op7_byte_bpe(spark, SF_DIR))
    assert set(got) == set(docs)
    for i, text in docs.items():
        ids = own.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_language(spark, docs):
    got = _by_id(catalog.op9_language(spark, SF_DIR))
    truth = {r["doc_id"]: r["lang"] for r in common.documents(spark, SF_DIR).collect()}
    held = [i for i in docs if crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_licenses(spark, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = _by_id(catalog.op10_licenses(spark, SF_DIR))
    for i, text in docs.items():
        text = text.translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r, starts = got[i], [k for k, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_pipeline(spark, docs):
    """Each stage against what the queries say of its own input."""
    import corpus_pipeline as P

    left = common.documents(spark, SF_DIR)
    columns = left.columns
    kept = {r["doc_id"] for r in catalog.op2_quality(spark, SF_DIR).collect() if r["kept"]}
    texts = None
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r["text"] for r in left.collect()}
        left = P.cut(stage(spark, left, SF_DIR), f"test-{name}")
        after = {r["doc_id"]: r["text"] for r in left.collect()}
        assert set(after) <= set(before)
        if name != P.STAGES[-1][0]:
            assert left.columns == columns
        if name == "quality_rules":
            assert set(after) == kept
        if name == "near_copies":
            assert len(set(before.values())) >= len(after) and set(after.values()) <= set(before.values())
            assert all(before[i] == t for i, t in after.items()) and len(set(after.values())) == len(after)
        if name == "benchmark_passages":
            items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
            norm = lambda t: " ".join(t.lower().split())
            exact = {i for i, t in before.items() if any(norm(x) in norm(t) for x in items)}
            assert set(before) - set(after) == exact
        if name == "personal_data":
            assert set(after) == set(before)
            assert not any(re.search(r"@mail|token = \"[0-9a-f]", t) for t in after.values())
            texts = after
    assert all(r["round_trip"] for r in left.collect()) and {r["doc_id"]: r["text"] for r in left.collect()} == texts
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(texts)


def test_decontamination(spark, docs):
    """Every item against every whole text, without pieces."""
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in catalog.op4_decontamination(spark, SF_DIR).collect()}
    want = set()
    for i, text in docs.items():
        plain = decontam.normal(text or "")
        for item in items:
            pattern = decontam.normal(item["text"] or "")
            budget = decontam.edit_budget(len(pattern), decontam.RATE)
            if pattern and (least := 0 if pattern in plain else decontam.myers_least(pattern, plain)) <= budget:
                want.add((i, item["item_id"], least))
    assert got == want and want


def test_language_model(spark, docs):
    """Base scores by their formula; the network's score is better on documents it has not seen."""
    tokens = {i: [*re.findall(SPACE.encode(), (t or "").encode().lower()), b""] for i, t in docs.items()}
    held = {i for i in docs if crc32(str(i).encode()) % 10 == 0}
    c = Counter(w for i, ts in tokens.items() if i not in held for w in ts)
    total = sum(c.values())
    got = _by_id(catalog.op6_language_model(spark, SF_DIR))
    assert set(got) == set(docs)
    for i, ts in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in ts)
        assert math.isclose(got[i]["base_score"], base, rel_tol=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ts), sum(c[w] > 0 for w in ts), total)
        assert got[i]["held_out"] == (i in held)
    n = sum(len(tokens[i]) for i in held)
    gain = sum(got[i]["score"] - got[i]["base_score"] for i in held) / n
    assert gain > 0.05, gain


def test_language_model_trains_on_a_share_of_any_corpus_and_long_documents(spark, docs):
    training = common.documents(spark, SF_DIR)
    head = lm.head_of(lm.token_counts(training), 50_000)
    for fit_tokens, share in ((1000, 0.5), (1000, 1.0), (10**9, 0.05)):
        rows, shards = lm._sample(training, head, fit_tokens, share)
        found = rows.select("shard", "doc_id", F.length("u").alias("n")).collect()
        wanted = min(head.tokens, max(fit_tokens, share * head.tokens))
        assert 0.5 * wanted < sum(r["n"] for r in found) < 1.6 * wanted
        assert shards == max(1, round(wanted / fit_tokens)) and {r["shard"] for r in found} <= set(range(shards))
        if share == 1.0:
            # No document is too long to teach.
            assert {r["doc_id"] for r in found} == set(docs) and max(r["n"] for r in found) > fit_tokens
    few = lm.score(training, fit_tokens=20_000, fit_share=1.0).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert few[0] > few[1]


def test_personal_data(spark, docs):
    got = _by_id(catalog.op8_personal_data(spark, SF_DIR))
    assert set(got) == set(docs)
    for i, text in docs.items():
        base = _plain_spans(text or "")
        kinds = Counter(s.split(":")[0] for s in base)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds[k] for k in ("email", "ip", "card", "phone")]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(base) <= set(spans)
        for s in spans:
            kind, a, b = s.split(":")
            assert kind in pii.KINDS and 0 <= int(a) < int(b) <= len(text)


def test_language_model_trains_on_every_training_document(spark, docs, monkeypatch):
    seen = []

    def watched(rows, *rest):
        seen.append({r["doc_id"] for r in rows.select("doc_id").collect()})
        return fitted(rows, *rest)

    fitted = lm._fitted
    monkeypatch.setattr(lm, "_fitted", watched)
    # What is fitted doesn't hang on the size of a shard.
    lm.score(common.documents(spark, SF_DIR), fit_tokens=10_000)
    assert set().union(*seen) == {i for i in docs if crc32(str(i).encode()) % 10}
