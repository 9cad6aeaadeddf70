import math
import random

import numpy as np

from verbaloom.llm import quality as Q


def corpus(n=300):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 8)))
    out = []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 80))]
        bad = i % 4 == 0
        text = " ".join(w + r.choice(["###", "%%%", "|"]) if bad else w for w in words) + "."
        out.append((i, text, 0 if bad else 1))
    return out


def test_pairs_teach_the_ranking(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "l", 9) for i, t, _ in rows], "doc_id long, text string, label string, score int")
    labels = spark.createDataFrame([(i, q, 1) for i, _, q in rows if i % 5], "doc_id long, quality int, text int")
    model = Q.train(docs, labels, "quality")
    got = {r.doc_id: r for r in Q.rate(docs, model).collect()}
    assert np.mean([got[i].predicted == q for i, _, q in rows if i % 5 == 0]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_loss_and_gradient_equal_plain_loops():
    r = np.random.default_rng(1)
    w, d = r.normal(size=4), r.normal(size=(30, 4)) * 3
    loss, grad = Q.pair_loss(w, d)
    slow = lambda w: sum(math.log1p(math.exp(-sum(a * b for a, b in zip(w, row)))) for row in d.tolist()) / 30 + 1e-4 / 2 * sum(a * a for a in w)
    assert math.isclose(loss, slow(w.tolist()), rel_tol=1e-12)
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert abs((slow((w + step).tolist()) - slow((w - step).tolist())) / 2e-6 - grad[k]) < 1e-6
    assert np.isfinite(Q.pair_loss(w * 1e6, d)[1]).all()


def test_training_separates_and_the_cut_may_lie_anywhere():
    r = np.random.default_rng(1)
    for share in (0.5, 0.9, 0.1):
        x = r.normal(size=(1000, 3))
        y = (x[:, 0] > np.quantile(x[:, 0], share)).astype(int)
        m = Q.fit(x, y)
        s = m.strengths(x)
        assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.97
        p = m.scores(x) >= m.at
        assert p[y == 1].mean() > 0.9 and p[y == 0].mean() < 0.1, share


def test_odd_inputs(spark):
    rows = [(1, None), (1, ""), (None, "a b"), (2, "x " * 100000), (3, "\n\n")]
    x, y = np.array([Q.features(t) for _, t in rows]), np.array([0, 0, 1, 0, 1])
    assert Q.rate(spark.createDataFrame(rows, "doc_id long, text string"), Q.fit(x, y)).count() == 5
    alone = Q.fit(x[:2], np.array([1, 1]))
    assert np.isfinite(alone.scores(x)).all()
    assert Q.rate(spark.createDataFrame([], "doc_id long, text string"), alone).count() == 0


def test_the_loss_is_that_of_all_pairs_and_knots_are_quantiles_of_all_rows():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 3)) ** 3
    y = (x[:, 0] + r.normal(size=400) > 0.5).astype(int)
    halves = lambda f: [f(x[:150], y[:150]), f(x[150:], y[150:])]
    model = Q.learn(halves, 3)
    ranks = np.array([0.0, 79, 200, 399])
    assert np.allclose(Q.order_statistics(halves, x.min(axis=0), x.max(axis=0), ranks), np.sort(x, axis=0)[ranks.astype(int)].T, atol=1e-7)
    e = model.expand(x)
    d = (e[y == 1][:, None] - e[y == 0][None]).reshape(-1, e.shape[1])
    w = r.normal(size=e.shape[1])
    (loss, grad), (want, slope) = Q.all_pairs_loss(halves, model, w), Q.pair_loss(w, d)
    assert abs(loss - want) < 1e-3 * want and np.abs(grad - slope).max() < 2e-3 * np.abs(slope).max()
    assert np.abs(Q.pair_loss(model.weights, d)[1]).max() < 2e-3
    s = model.strengths(x)
    balance = lambda cut: (s[y == 1] >= cut).mean() + (s[y == 0] < cut).mean()
    assert balance(model.threshold) == max(map(balance, s))


def test_every_labelled_document_is_learnt_from(spark, monkeypatch):
    rows = [(i, "good words here " * (i % 7 + 1) if i % 3 else "### %%% " * (i % 5 + 1)) for i in range(6000)]
    seen = []
    learn = Q.learn
    monkeypatch.setattr(Q, "learn", lambda each, *more: (seen.append(sum(each(lambda x, y: np.array([len(y), y.sum()])))), learn(each, *more))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    Q.train(docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int"), "quality")
    assert seen[0].tolist() == [6000, 4000]
