import random

import numpy as np
from xxhash import xxh64_intdigest

from verbaloom.llm import simhash
from verbaloom.llm.common import components
from verbaloom.llm.simhash import bucket_links, fingerprint, masks, near_duplicates


def slow_fingerprint(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [words[i : i + k] for i in range(len(words) - k + 1)] or [words]
    hashes = [xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcDÉ") for _ in range(r.randint(1, 4)))
    texts = [None, "", " \n", "One", "one", "two words"]
    for _ in range(25):
        base = [word() for _ in range(r.choice([5, 60, 200]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            new = list(base)
            new[r.randrange(len(new))] = word()
            texts.append(" ".join(new))
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    fps = np.array([slow_fingerprint(t, 4) for t in texts], dtype=np.uint64)
    assert [fingerprint(t, 4) for t in texts] == fps.tolist()
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    want = components(len(texts), a, b)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id int").repartition(3)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in near_duplicates(df).collect()}
    assert got == {i: (int(fps[i]), int(want[i])) for i in range(len(texts))}


def test_large_buckets_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    r = np.random.default_rng(2)
    fps = np.unique(np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (150, 3)).astype(np.uint64), axis=1))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    rows = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    got = components(len(fps), np.array([place[x.a] for x in rows]), np.array([place[x.b] for x in rows]))
    assert (got == components(len(fps), a, b)).all()


def test_masks_find_every_pair_at_any_number_of_blocks():
    r = random.Random(1)
    for n in (10, 10**7, 10**10):
        for _ in range(200):
            x = sum(1 << b for b in r.sample(range(64), 4))
            assert any(not x & m for m in masks(n, 4))


def test_bucket_links_keep_groups_apart():
    fp = np.array([1, 3, 1, 3], dtype=np.uint64)
    a, b = bucket_links(fp, np.array([0, 0, 1, 2]), 4)
    assert sorted(zip(a.tolist(), b.tolist())) in ([(3, 1)], [(1, 3)])


def test_empty_table_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = near_duplicates(spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "x y z x y")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("4", "4"), ("None", "4"), ("None", "None")]
