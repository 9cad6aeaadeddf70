import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verbaloom.llm import lmscore

PATH = public_tokenizers.path("word_bpe_49k.json")


def slow_losses(coded, chosen, v):
    """Target and background loss of each text by counts of all others, in plain Python; the background is scaled to the target."""
    def counted(which):
        one, two, context = Counter(), Counter(), Counter()
        for ids in which:
            one.update(ids)
            two.update(zip([v, *ids], ids))
            context.update([v, *ids][: len(ids)])
        return one, two, context

    both = [counted(x) for x in ([ids for ids, c in zip(coded, chosen) if c], coded)]
    sizes = [max(1, sum(one.values())) for one, *_ in both]
    out = []
    for ids, c in zip(coded, chosen):
        losses = []
        own = counted([ids])
        for (one, two, context), scale, mine in zip(both, (1, sizes[0] / sizes[1]), (c, True)):
            left = [lambda x, a=a, o=o: (a[x] - (o[x] if mine else 0)) * scale for a, o in zip((one, two, context), own)]
            n = (sum(one.values()) - (len(ids) if mine else 0)) * scale
            p = lambda h, w: (left[1]((h, w)) + lmscore.PRIOR * (left[0](w) + lmscore.FLAT) / (n + lmscore.FLAT * v)) / (left[2](h) + lmscore.PRIOR)
            losses.append(sum(-math.log2(p(h, w)) for h, w in zip([v, *ids], ids)) / max(1, len(ids)))
        out.append(tuple(losses))
    return out


def test_losses_equal_plain_counts(spark):
    """More bigrams than any small table tells apart: each is counted alone, and none of a document's own counts scores it."""
    true = Tokenizer.from_file(PATH)
    v, r = true.get_vocab_size(), np.random.default_rng(9)
    words = [w for w in ("".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 2)) for _ in range(3000)) if len(true.encode(w, add_special_tokens=False).ids) == 1]
    texts = ["of the " * 20_000, *(" ".join(r.choice(words, 300)) for _ in range(400))]
    texts += [texts[3], "one of the", ""]
    coded = [true.encode(t, add_special_tokens=False).ids for t in texts]
    want = slow_losses(coded, [i % 3 == 0 for i in range(len(texts))], v)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in lmscore.cross_entropy_difference(df, df.where("doc_id % 3 = 0").select("doc_id"), PATH).collect()}
    for i, (t, b) in enumerate(want[:-1]):
        assert (got[i].target_bits, got[i].background_bits, got[i].score) == pytest.approx((t, b, t - b), rel=1e-9, abs=1e-9)
    assert got[len(texts) - 1].score is None
    # the two rows of one text know each other, so the background expects them
    assert got[3].background_bits < min(got[i].background_bits for i in range(1, 401) if i != 3) - 1


def test_probabilities_after_a_context_sum_to_one():
    r = np.random.default_rng(2)
    v = 40
    ids = r.integers(0, v, 500).astype(np.uint16)
    key = lmscore.keys(ids, np.array([200, 0, 300]), v).astype(np.int64)
    m = lmscore.Model(np.bincount(ids, minlength=v).astype(float), np.bincount(key >> 16, minlength=v + 1).astype(float))
    two = Counter(key.tolist())
    own_key = key[:200]
    for h in (0, 7, v):
        row = np.array([h << 16 | w for w in range(v)])
        n = np.array([two[k] for k in row.tolist()], dtype=float)
        own = (np.array([(own_key == k).sum() for k in row]), (own_key >> 16 == h).sum(), np.array([(own_key & 0xFFFF == w).sum() for w in range(v)]), 200)
        for o in ((0, 0, 0, 0), own):
            assert np.exp2(-m.bits(row, n, o)).sum() == pytest.approx(1, abs=1e-12)


def test_chunks_share_one_table_of_counts(spark, monkeypatch):
    rows = [(i, f"a b c {'d ' * (i % 5)} e f") for i in range(60)] + [(7, "a b"), (None, "c d"), (61, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    good = spark.createDataFrame([(i,) for i in range(0, 60, 7)], "doc_id long")
    score = lambda: sorted(map(tuple, lmscore.cross_entropy_difference(df, good, PATH).collect()), key=str)
    whole = score()
    monkeypatch.setattr(lmscore, "CHUNK", 60)
    monkeypatch.setattr(lmscore, "SLICE", 20)
    for a, b in zip(whole, score(), strict=True):
        assert a[:2] == b[:2] and (a[2:] == b[2:] if a[1] == 0 else a[2:] == pytest.approx(b[2:]))
