import random

import numpy as np

from verbaloom.llm import toxicity as X


def corpus(n=400, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "sa", "re"]) for _ in range(r.randint(1, 3)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.choice([0, 5, 50, 200]))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            words.insert(r.randint(0, len(words)), r.choice(["fool", "oaf", "zaxka", "zaxlo", "zaxmi"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_gradients_equal_finite_differences():
    net = X.Net.new(1)
    net.p = {k: v.astype(np.float64) * (3 if k in "ao" else 1) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x = r.normal(size=(9, X.DIM))
    rows, mask = r.integers(0, 9, (4, 6)), np.arange(6) < np.array([6, 3, 1, 5])[:, None]
    up = r.normal(size=4)
    f = lambda: float(net.run(net.gates(x), rows, mask) @ up)
    keep = []
    net.run(net.gates(x), rows, mask, keep)
    grad, dg = net.back(rows, mask, keep, up, 9)
    h3 = 3 * X.HIDDEN
    grad |= {"wf": x.T @ dg[:, :h3], "wb": x.T @ dg[:, h3:], "vf": dg[:, :h3].sum(0), "vb": dg[:, h3:].sum(0)}
    for k, g in grad.items():
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in net.p[k].shape)
            old, e = net.p[k][at], 1e-3
            net.p[k][at] = old + e
            high = f()
            net.p[k][at] = old - e
            low = f()
            net.p[k][at] = old
            assert abs((high - low) / (2 * e) - g[at]) < 1e-3 + 1e-2 * abs(g[at]), k


def plain_logit(net, words):
    """The net by plain loops over the words of one window."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda v: 1 / (1 + np.exp(-v))
    vectors = []
    for w in words:
        b, g, _ = X.word_inputs([w])
        vectors.append(p["ew"][b[0]] + (sum(p["eg"][k] for k in g) / len(g) if len(g) else 0))
    h = X.HIDDEN
    states = {}
    for d, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
        s = np.zeros(h)
        for t in order:
            x, y = vectors[t] @ p["w" + d] + p["v" + d], s @ p["u" + d]
            z, r = sig(x[:h] + y[:h]), sig(x[h : 2 * h] + y[h : 2 * h])
            s = (1 - z) * np.tanh(x[2 * h :] + r * y[2 * h :]) + z * s
            states[d, t] = s
    both = [np.r_[states["f", t], states["b", t]] for t in range(len(words))]
    e = np.array([np.exp(v @ p["a"]) for v in both])
    pooled = sum((k / e.sum() * v for k, v in zip(e, both)), np.zeros(2 * h))
    return float(pooled @ p["o"] + p["c"][0])


def test_scores_equal_plain_loops_over_all_windows():
    net = X.fit([t for _, t, _ in corpus(60)], np.array([y for *_, y in corpus(60)]), epochs=1)
    texts = ["", "fool", "Ka lo, fool! zaxka", " ".join(f"ka{'lo' * (k % 4)}" for k in range(150)), "mi " * 64, "sa " * 65]
    want = []
    for t in texts:
        w = X.words_of(t)
        starts = [*range(0, max(1, len(w) - X.WINDOW), X.STEP), max(0, len(w) - X.WINDOW)]
        want.append(max(plain_logit(net, w[s : s + X.WINDOW]) for s in starts))
    assert np.allclose(X.Scorer(net).logits(texts), want, atol=1e-4)


def test_a_passage_of_half_a_window_lies_whole_in_one():
    for n in (64, 65, 97, 300):
        _, start, size = X.windows_of(np.array([n]))
        k = X.WINDOW - X.STEP
        assert all(any(s <= a and a + k <= s + m for s, m in zip(start, size)) for a in range(n - k + 1))


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 64, 65, 200, X.STEP * 3 + 64])
    text, start, size = X.windows_of(sizes)
    for i, n in enumerate(sizes):
        base = sizes[:i].sum()
        seen = set()
        for s, k in zip(start[text == i], size[text == i]):
            seen.update(range(s - base, s - base + k))
        assert seen == set(range(n))


def test_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 5.0) for i, t, _ in rows], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows if i % 5], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in X.score(docs, X.train(docs, labels)).collect()}
    truth = {i: y for i, _, y in rows}
    assert np.mean([got[i].predicted == truth[i] for i in range(0, 400, 5)]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_odd_inputs(spark):
    rows = corpus(60)
    net = X.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), epochs=1)
    odd = [(1, None), (1, ""), (None, "ka lo"), (2, "lo " * 50000), (3, "1 2 _")]
    got = X.score(spark.createDataFrame(odd, "doc_id long, text string"), net).collect()
    assert len(got) == 5 and all(np.isfinite(r.score) for r in got)
    assert X.score(spark.createDataFrame([], "doc_id long, text string"), net).count() == 0
    one = X.Scorer(net).logits(["ka lo " * 300])
    alone = max(X.Scorer(net).logits([" ".join(("ka lo " * 300).split()[s : s + 64])])[0] for s in [*range(0, 600 - 64, X.STEP), 600 - 64])
    assert abs(one[0] - alone) < 1e-4
