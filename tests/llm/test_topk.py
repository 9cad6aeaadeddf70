import numpy as np

from verbaloom.llm import topk as K


def brute(ids, x, k, every):
    out = []
    for i in np.flatnonzero(ids % every == 0):
        keep = ids != ids[i]
        score = x[keep] @ x[i]
        order = np.lexsort((ids[keep], -score))[:k]
        out += [(int(ids[i]), r + 1, int(ids[keep][j]), int(score[j])) for r, j in enumerate(order)]
    return sorted(out)


def vectors(n=700, d=24, seed=1, ties=False):
    r = np.random.default_rng(seed)
    v = r.normal(size=(8, d))[r.integers(0, 8, n)] + 0.5 * r.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return (np.round(v, 1) if ties else v).astype(np.float32)


def test_equals_brute_force_in_any_blocks(spark, monkeypatch):
    for ties in (False, True):
        v = vectors(ties=ties)
        ids = np.arange(len(v))
        want = brute(ids, np.floor(1024 * v.astype(np.float64)).astype(np.int64), 10, 7)
        df = spark.createDataFrame([(int(i), x.tolist(), 3) for i, x in zip(ids, v)], "vec_id long, embedding array<float>, score int")
        assert sorted(map(tuple, K.exact_top_k(df, every=7).collect())) == want
        monkeypatch.setattr(K, "BLOCK", 150)
        monkeypatch.setattr(K, "PIECE", 64)
        assert sorted(map(tuple, K.exact_top_k(df, every=7).collect())) == want


def test_bit_slices_prune_and_keep_the_top():
    v = np.floor(1024 * vectors(3000).astype(np.float64)).astype(np.int64)
    index = K.BitSliced(np.arange(len(v)), v)
    for i in range(0, 3000, 300):
        ids, score = index.top(i, v[i], 10)
        full = v @ v[i]
        full[i] = -(1 << 60)
        assert score.tolist() == np.sort(full)[::-1][:10].tolist()


def test_repeated_query_rows_are_queries_of_their_own(spark):
    rows = [(100, [1.0, 0.0], "a"), (100, [0.0, 1.0], "b"), (1, [1.0, 0.0], "c"), (2, [0.0, 0.5], "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string").repartition(3)
    got = sorted(map(tuple, K.exact_top_k(df).collect()))
    one = 1024 * 1024
    assert got == sorted([(100, 1, 1, one), (100, 2, 2, 0), (100, 3, 100, 0), (100, 1, 2, one // 2), (100, 2, 1, 0), (100, 3, 100, 0)])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [0.25]), (7, []), (8, [-1.0, 0.0]), (8, [-1.0, 0.0])]
    got = sorted(map(tuple, K.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100).collect()))
    assert got == [(0, 1, 1, 1024 * 1024 + 512 * 512), (0, 2, 6, 256 * 1024), (0, 3, 7, 0), (0, 4, 8, -1024 * 1024), (0, 5, 8, -1024 * 1024)]
    assert K.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
