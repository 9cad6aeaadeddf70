import math
import random
from collections import Counter

import numpy as np

from verbaloom.llm import langid as L


def texts(n=60, seed=4):
    r = random.Random(seed)
    kinds = {"aa": ["ka", "lo", "mi", "sa"], "bb": ["tré", "ou", "in", "ka"], "cc": ["sch", "ei", "ung", "lo"]}
    out = []
    for i in range(n):
        g = sorted(kinds)[i % 3]
        out.append((" ".join("".join(r.choice(kinds[g]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 30))) + ".", g))
    return out


def test_arrays_equal_plain_recursion_and_probabilities_sum_to_one():
    words = {"a": Counter("the than then they hat hats cat cats".split()), "b": Counter("der die das den dem es".split())}
    m = L.build(words)
    for w in ("the", "zebra", "hathe", "x", "dädem", "caatsss"):
        s = L.MARK + w + L.MARK
        got = m.word_scores([w])[0]
        for k, g in enumerate(m.langs):
            want = sum(L.log_prob(L.kneser_ney(words[g], m.alphabet), s, i, m.alphabet) for i in range(1, len(s)))
            assert math.isclose(got[k], want, rel_tol=1e-5)
        assert got[-1] == len(w) + 1
    letters = sorted({c for w in words.values() for x in w for c in x}) + [L.MARK, "?"]
    model = L.kneser_ney(words["a"], m.alphabet)
    for context in ("", "t", "th", "zz"):
        s = L.MARK + context
        assert math.isclose(sum(math.exp(L.log_prob(model, s + c, len(s), m.alphabet)) for c in letters), 1, rel_tol=1e-9)


def slow_kneser_ney(words, n, history, c, alphabet):
    """P(c | history) by the textbook's recursion, every count taken anew from the list of padded words."""
    text = [L.MARK + w + L.MARK for w, k in words.items() for _ in range(k)]

    def count(g):
        """How often g occurs (not as a mere start mark), for the highest order and for starts of words; else how many characters come before it."""
        raw = sum(s[i : i + len(g)] == g for s in text for i in range(0 if len(g) > 1 else 1, len(s)))
        if len(g) == L.ORDER or (g[0] == L.MARK and len(g) > 1):
            return raw
        return len({s[i - 1] for s in text for i in range(1, len(s)) if s[i : i + len(g)] == g and (len(g) > 1 or i > 0)}) if raw else 0

    order = len(history) + 1
    grams = {s[i : i + order] for s in text for i in range(0 if order > 1 else 1, len(s) - order + 1)}
    counts = {g: count(g) for g in grams}
    once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05
    lower = slow_kneser_ney(words, n, history[1:], c, alphabet) if history else 1 / alphabet
    mine = {g: k for g, k in counts.items() if g[:-1] == history}
    if not mine:
        return lower
    total = sum(mine.values())
    return max(mine.get(history + c, 0) - d, 0) / total + d * len(mine) / total * lower


def test_probabilities_equal_counts_by_hand():
    words = Counter("the the than then they hat hats cat".split())
    model = L.kneser_ney(words, 12)
    for s in (L.MARK + "the" + L.MARK, L.MARK + "hatz" + L.MARK, L.MARK + "nthe"):
        for i in range(1, len(s)):
            history = s[max(0, i - L.ORDER + 1) : i]
            assert math.isclose(math.exp(L.log_prob(model, s, i, 12)), slow_kneser_ney(words, L.ORDER, history, s[i], 12), rel_tol=1e-9), (s, i)


def test_rejection_is_calibrated_on_rows_that_gave_no_counts():
    rows = texts(300)
    m = L.fit(rows)
    held = [(t, g) for k, (t, g) in enumerate(rows) if k % 5 == 0]
    sums, _ = L.Scorer(m).texts([t for t, _ in held])
    at, share, bits = L.posterior(m, sums)
    right = np.array([m.langs[a] == g for a, (_, g) in zip(at, held)])
    assert right[share >= m.accept].mean() >= 0.999
    # the least such threshold: with the next row the accepted ones would fall below
    order = np.sort(share)[::-1]
    below = order[order < m.accept]
    assert not len(below) or right[share >= below[0]].mean() < 0.999
    assert math.isclose(m.most_bits, np.quantile(bits, 0.999) * 1.5)


def test_scores_are_held_out_right(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate(texts(240))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.train(df.where("doc_id % 4 <> 2"), most_docs=40)
    got = {r.doc_id: r for r in L.identify(df, m).collect()}
    assert np.mean([got[i].lang_pred == g for i, _, g in rows if i % 4 == 2]) == 1
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_texts(spark):
    m = L.fit(texts(150))
    rows = [(1, None), (2, ""), (3, " 12 _ !"), (4, "漢字"), (None, "kalo misa"), (6, "KALO " * 30000), (7, "²"), (7, "²")]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8
    assert {i: by[i].lang_pred for i in (1, 2, 3, 7)} == dict.fromkeys((1, 2, 3, 7), "und")
    assert by[4].lang_pred in m.langs and by[4].rejected
    assert by[None].lang_pred == "aa" and by[6].lang_pred == "aa" and not by[6].rejected
    assert L.identify(spark.createDataFrame([], "doc_id long, text string"), m).count() == 0
