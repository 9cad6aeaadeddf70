import random

import corpus_pipeline
import numpy as np

from verbaloom.llm import similar as S
from verbaloom.llm.common import components


def grams(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_the_stage_drops_every_near_copy_of_similarity_08(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = [None, "", "One", "one", "two words"]
    for _ in range(20):
        base = [word() for _ in range(r.choice([30, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(4):
            new = list(base)
            for _ in range(r.randint(0, len(base) // 30)):
                new[r.randrange(len(new))] = word()
            texts.append(" ".join(new).title())
    sets = [grams(t) for t in texts]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    want = components(len(texts), *np.nonzero(near))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, root string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns
    assert sorted(x.doc_id for x in got.collect()) == sorted(set(want.tolist()))
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


def test_bands_hold_the_recall_and_short_sets_too(monkeypatch):
    r = np.random.default_rng(4)
    all_, number = S.bands(200_000, 0.8)
    for own, common in ((1, 8), (0, 4), (20, 160), (100, 800)):
        missed, far = 0, 0
        places = all_ if own + common <= S.SMALL else all_[:number]
        for _ in range(300):
            both = r.integers(0, 1 << 64, common, dtype=np.uint64)
            a, b = (S.wide_fingerprint(np.r_[both, r.integers(0, 1 << 64, n, dtype=np.uint64)]) for n in ((own, own) if own else (1, 0)))
            bits = np.unpackbits((a ^ b).view(np.uint8), bitorder="little")
            missed += bits[places].any(axis=1).all()
            far += bits.sum() > S.radius(0.8, 256) or bits[:64].sum() > S.radius(0.8, 64)
        assert missed <= 3 and far <= 3, (own, common, missed, far)
    assert S.bands(10**9, 0.8)[0].shape > all_.shape


def bucket_rows(n, seed, roots):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, (20, 2), dtype=np.uint64)
    rows = []
    for i, (k, at) in enumerate(zip(r.integers(0, 3, n), r.integers(0, 20, n))):
        fp, more = (int(x) ^ sum(1 << int(b) for b in set(r.integers(0, 62, 6))) for x in base[at])
        rows.append((int(k), int(S.gray_rank(np.array([fp], np.uint64)).view(np.int64)[0]), i, more, i if i % 7 == 0 else roots(i), fp))
    return rows


def near_rows(rows):
    return {(a[2], b[2]) for a in rows for b in rows if a[2] < b[2] and a[0] == b[0] and (a[5] ^ b[5]).bit_count() <= S.radius(0.8, 64) and (a[5] ^ b[5]).bit_count() + (a[3] ^ b[3]).bit_count() <= S.radius(0.8, 128)}


def test_large_buckets_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 10)
    rows = bucket_rows(300, 3, lambda i: 1)
    df = spark.createDataFrame([r[:5] for r in rows], "key long, rank long, node long, more long, root long")
    root = {r[2]: r[4] for r in rows}
    want = {(a, b) for a, b in near_rows(rows) if root[a] != root[b]}
    assert len(want) > 50
    for large in ([(0, 100), (1, 100)], []):
        got = {tuple(x) for x in S.across(df, spark.createDataFrame(large, "key long, many long"), 0.8).collect()}
        assert got == want


def test_neighbours_are_near_and_count_large_buckets(spark):
    rows = bucket_rows(500, 5, lambda i: i)
    df = spark.createDataFrame([r[:4] for r in rows], "key long, rank long, node long, more long")
    got = S.neighbours(df, 0.8).collect()
    pairs = {(x.a, x.b) for x in got if x.many is None}
    assert len(pairs) > 100 and pairs <= near_rows(rows) | {(a, b) for a, b in pairs if (rows[a][5] ^ rows[b][5]).bit_count() > S.radius(0.8, 64)}
    total = {}
    for x in got:
        if x.many is not None:
            total[x.a] = total.get(x.a, 0) + x.many
    true = {k: sum(r[0] == k for r in rows) for k in range(3)}
    assert all(total[k] == true[k] for k in total) and total


def edited(r, n, words, edits):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(words)]
    out = []
    for _ in range(n):
        new = list(base)
        for at in r.sample(range(words), r.choice(edits)):
            new[at] = word()
        out.append(" ".join(new))
    return out


def brute(sets):
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    return components(len(sets), *np.nonzero(near)), near


def test_a_group_of_likenesses_below_the_similarity_makes_no_square_of_pairs(spark, monkeypatch):
    texts = edited(random.Random(2), 150, 300, [6, 7])
    assert len(set(brute([grams(t) for t in texts])[0])) > 100
    made, keep = [], S.stored

    def counted(df, name, *more):
        out = keep(df, name, *more)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(S, "stored", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert S.keep_one(df).count() == len(set(brute([grams(t) for t in texts])[0]))
    assert all(n <= 2 * len(texts) for name, n in made if name != "neighbours"), made
    assert dict(made)["neighbours"] <= 2 * len(texts) * len(S.bands(len(texts), 0.8)[0])


def test_links_of_sets_link_what_all_similar_pairs_link():
    r = random.Random(8)
    texts = edited(r, 60, 120, [0, 1, 2, 3, 4, 8]) + edited(r, 20, 9, [0, 1]) + ["a b c d e f g h", "a b c d e f g h i"]
    sets = [S.shingles(t, 5) for t in texts]
    want, near = brute([set(s.tolist()) for s in sets])
    yes = np.ones(len(sets), dtype=bool)
    pairs = S.links_of_sets(sets, yes, yes, np.arange(len(sets)), 0.8)
    assert all(near[a, b] for a, b in pairs) and len(pairs) == len(sets) - len(set(want.tolist()))
    assert (components(len(sets), *np.array(pairs).T) == want).all()


def test_a_large_group_is_verified_in_cells(spark, monkeypatch):
    r = random.Random(9)
    texts = edited(r, 60, 120, [1, 2, 3, 4, 5])
    want = brute([grams(t) for t in texts])[0]
    assert 1 < len(set(want.tolist())) < 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string").repartition(3)
    for most in (7, 25):
        monkeypatch.setattr(S, "SETS", most)
        assert sorted(x.doc_id for x in S.keep_one(df).collect()) == sorted(set(want.tolist()))


def test_a_large_group_has_few_links_a_set(spark, monkeypatch):
    r, n, counts = np.random.default_rng(7), 1200, {}
    for size in (n // 2, n):
        bits = np.tile(r.random(256) < 0.5, (size, 1)) ^ (r.random((size, 256)) < 0.06)
        rows = [(i + 1, np.packbits(b, bitorder="little").tobytes(), 100) for i, b in enumerate(bits)]
        df = spark.createDataFrame(rows, "node long, wide binary, n long")
        S.ship(spark)
        links = S.stored(S.neighbours(S.members(df, 0.8), 0.8).where("many is null").select("a", "b"), "test-links")
        counts[size] = links.distinct().count()
        roots = S.connected_components(links)
        placed = df.join(roots, "node", "left").selectExpr("node", "wide", "n", "coalesce(root, node) root")
        more = S.across(S.members(placed, 0.8), spark.createDataFrame([], "key long, many long"), 0.8, joined=True)
        whole = S.connected_components(roots.selectExpr("node a", "root b").union(more)).collect()
        assert {x.root for x in whole} == {1} and len(whole) == size
    assert all(k <= 16 * size for size, k in counts.items()), counts
