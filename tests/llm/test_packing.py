"""Packs keep every token once, their capacity, and near-duplicates apart."""

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import packing
from tessera.llm.tokens import Counter_, ranks_of

SIZED = "doc_id long, source string, n_tokens long, tags array<long>, shard int, capacity int"
SIZES = "pack_name string, capacity_tokens int"


def sized(spark, n=800, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["a", "b", None]), int(rng.lognormvariate(5, 1.2)), [k // 3 if k % 5 else -1], 0, 0) for k in range(n)]
    rows += [(9001, "a", 0, [], 0, 0), (9002, "a", 0, None, 0, 0), (None, "a", 10, [1], 0, 0), (9003, "b", 50_000, [77], 0, 0), (9004, "b", 512, [78], 0, 0), (9004, "b", 512, [78], 0, 0)]
    return rows, spark.createDataFrame(rows, SIZED)


@pytest.mark.parametrize("shard_tokens", [4_000_000, 30_000])
def test_packs(spark, shard_tokens):
    rows, df = sized(spark)
    caps = {"small": 512, "large": 8192}
    sizes = spark.createDataFrame([*caps.items(), (None, 5), ("bad", 0), ("none", None)], SIZES)
    out = packing.packs(df, sizes, shard_tokens).collect()
    tags = {r[0]: frozenset(r[3] or ()) for r in rows}
    for name, cap in caps.items():
        mine = [r for r in out if r.pack_name == name]
        got = defaultdict(list)
        for r in mine:
            got[r.doc_id].append((r.first_token, r.n_tokens))
        for doc, _, n, *_ in rows:
            if doc is None:
                continue
            spans = sorted(got[doc])
            copies = 2 if doc == 9004 else 1
            assert sum(s for _, s in spans) == n * copies
            if n <= cap:
                assert len(spans) == copies
            else:
                assert [a for a, _ in spans] == list(range(0, n, cap)) and all(s == cap for _, s in spans[:-1])
        full = defaultdict(int)
        held = defaultdict(list)
        for r in mine:
            full[r.pack_id] += r.n_tokens
            held[r.pack_id].append(r.doc_id)
        assert max(full.values()) <= cap
        for docs in held.values():
            for k, a in enumerate(docs):
                assert all(tags[a].isdisjoint(tags[b]) for b in docs[k + 1 :])
    assert {r.pack_name for r in out} == set(caps)
    used = {r.pack_name: r.used for r in packing.fill(packing.packs(df, sizes), sizes).collect()}
    assert used["small"] > 0.9


def test_best_fit_takes_the_tightest_compatible_pack():
    p = packing.Packer(100)
    assert [p.put(60, frozenset({1}), "a"), p.put(70, frozenset({2}), "a"), p.put(80, frozenset({3}), "a")] == [0, 1, 2]
    assert p.put(20, frozenset({3}), "b") == 1  # pack 2 fits best, but holds a near-duplicate
    assert p.put(20, frozenset({4}), "b") == 2
    assert p.put(10, frozenset({5}), "b") == 1
    assert p.put(50, frozenset({1}), "b") == 3


def test_near_duplicates_share_a_tag_and_others_don_t():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    sign, hits, strange = packing.Signer(), 0, 0
    for _ in range(60):
        a = rng.choices(words, k=400)
        b = list(a)
        for at in rng.sample(range(400), 6):  # about 30 of 396 shingles: similarity above 0.8
            b[at] = rng.choice(words)
        c = rng.choices(words, k=400)
        hits += bool(set(sign(" ".join(a)).tolist()) & set(sign(" ".join(b)).tolist()))
        strange += bool(set(sign(" ".join(a)).tolist()) & set(sign(" ".join(c)).tolist()))
    assert hits >= 59 and strange == 0
    assert len(sign("")) == len(sign(None)) == 0 and len(sign("two words")) == packing.BANDS
    assert np.array_equal(sign("Same  Words here"), sign("same words HERE"))


def test_empty(spark):
    none = spark.createDataFrame([], SIZED)
    assert packing.packs(none, spark.createDataFrame([("s", 5)], SIZES)).count() == 0
    assert packing.packs(sized(spark, 5)[1], spark.createDataFrame([], SIZES)).count() == 0


def test_token_counts_are_the_tokenizer_s():
    count = Counter_(ranks_of())
    texts = ["", "Plain words, 12 of them.", "naïve café №5 „quoted“ – dash", "tabs\tand\n\nlines   spaces ", "日本語 text ②³ ½", "a" * 20_000, "x y z​", "Ünïcödé_underscore__ 'll don't", "█████ redacted"]
    for t in texts:
        assert count(t) == len(count.encoding.encode_ordinary(t)), t
    assert count(None) == 0


def test_near_duplicates_of_the_corpus_share_a_band():
    """All pairs of the test documents by exact five-word shingles: those of similarity 0.8 or more must share a band."""
    import pandas as pd

    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("the test tables aren't here")
    texts = pd.read_parquet(path)["text"].dropna().drop_duplicates().tolist()
    sign, sets, tags, holders = packing.Signer(), [], [], defaultdict(list)
    for k, t in enumerate(texts):
        words = t.lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
        tags.append(set(sign(t).tolist()))
        for s in sets[-1]:
            holders[s].append(k)
    shared = defaultdict(int)
    for ks in holders.values():
        if len(ks) < 60:  # a phrase of every decision makes no pair similar by itself
            for i, a in enumerate(ks):
                for b in ks[i + 1 :]:
                    shared[a, b] += 1
    near = [(a, b) for a, b in shared if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) > 20 and sum(bool(tags[a] & tags[b]) for a, b in near) >= 0.98 * len(near)


def test_copies_of_one_id_are_dealt_to_many_shards(spark):
    df = spark.createDataFrame([(7, "a", 500, [], 0, 0)] * 400, SIZED)
    out = packing.packs(df, spark.createDataFrame([("small", 512)], SIZES), 20_000).collect()
    assert len(out) == 400 and len({r.pack_id.split("-")[0] for r in out}) > 3
