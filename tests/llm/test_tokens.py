import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verbaloom.llm import lmscore, packing
from verbaloom.llm.tokencount import TokenTree, count_with_edits
from verbaloom.llm.tokens import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "Don't STOP it's 'tis", "naïve Éáx Σας İx", "a b c", "漢字 kana 12345 ½²", "<|endoftext|> x<|endoftext|>y <| ENDOFTEXT", "!!!??? a--b_c", "x" * 5000, "\x1c\x1f\x85 tab\tnew\nline", "é ́ e", "ß SS ſ K", "a'S b'Re", "🙂🙂 ok"]


@pytest.fixture(scope="module")
def true():
    return Tokenizer.from_file(PATH)


def prose(r, n):
    return "".join(r.choice(["the ", "Re", "ing", " ", "\n", "'s", "12", ", ", "é", "Ou", "word ", "<|", "漢", "-"]) for _ in range(n))


def test_ids_equal_the_tokenizer(true):
    bpe, r = WordBpe(PATH), random.Random(1)
    texts = ODD + [prose(r, 60) for _ in range(200)]
    for text, got in zip(texts, bpe.encode(texts), strict=True):
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == true.encode(text, add_special_tokens=False).ids, text
        keys, sizes = bpe.slots(text)
        assert keys == bpe.split(text) and len(sizes) == len(keys) and sum(sizes) <= len(text)


def test_trees_follow_edits(true):
    bpe, r = WordBpe(PATH), random.Random(2)
    for text in ODD + [prose(r, 80) for _ in range(60)]:
        t = TokenTree.of(bpe, text)
        assert t.n_tokens == len(true.encode(text, add_special_tokens=False).ids)
        for _ in range(12):
            a = r.randint(0, len(text) + 2)
            b = a + r.choice([0, 0, 1, 5, 30])
            new = r.choice(["", " ", "x", "The end", "'s", prose(r, 5), "<|endoftext|>"])
            t.edit(a, b, new)
            text = text[:a] + new + text[max(a, b) :]
            assert (t.n_chars, t.n_tokens) == (len(text), len(true.encode(text, add_special_tokens=False).ids))


def test_edits_encode_little_of_a_long_text():
    bpe = WordBpe(PATH)
    t = TokenTree.of(bpe, "some words here " * 5000)
    assert t.edit(40_000, 40_005, "other") < 60


def test_counts_of_tables(spark, true):
    rows = [(1, "Some text here, with words.", [(5, 9, "TEXT"), (0, 0, "It's ")]), (None, None, None), (1, "", [(0, 3, "new")]), (2, "abc", [None, (None, None, None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start: int, end: int, text: string>>")
    got = sorted(map(tuple, count_with_edits(df, PATH).collect()), key=str)
    n = lambda t: len(true.encode(t, add_special_tokens=False).ids)
    assert [x[:5] for x in got] == sorted([(1, n(rows[0][1]), 2, n("It's Some TEXT here, with words."), 32), (None, 0, 0, 0, 0), (1, 0, 1, 1, 3), (2, 1, 2, 1, 3)], key=str)
    assert count_with_edits(df.limit(0), PATH).count() == 0


def packed_corpus():
    r = random.Random(4)
    return [(i, prose(r, r.choice([0, 5, 30, 300]))) for i in range(150)] + [(200, None), (None, "x"), (3, "twice"), (201, "word " * 5000)]


def test_packing_is_a_round_trip(spark, true):
    rows = packed_corpus()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, piece int, length int").repartition(5)
    got = packing.pack(df, PATH, 512).collect()
    want = []
    for i, t in rows:
        ids = true.encode(t or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 512)):
            cut = ids[a : a + 512]
            want.append((i, k, a, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))))
    assert sorted(((*r,)[:5] for r in got), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 512
    # two pieces of over half a sequence never share one
    least = max(sum(x[3] for x in want) / 512, sum(x[3] > 256 for x in want))
    assert len(places) <= least * 1.05 + 1
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_best_two_fit():
    r = random.Random(7)
    for _ in range(30):
        counts = Counter(r.randint(1, 40) for _ in range(r.randint(0, 300)))
        plan = packing.plan_bins(dict(counts), 40)
        back = Counter()
        for times, items in plan:
            assert sum(k * n for k, n in items) <= 40
            for k, n in items:
                back[k] += times * n
        assert back == counts
        assert sum(t for t, _ in plan) <= sum(k * n for k, n in counts.items()) / 40 * 1.25 + 2
    # 6 fits first, but 5 and 4 fill what 6 leaves open
    assert packing.plan_bins({10: 1, 6: 1, 5: 1, 4: 1}, 19)[0] == (1, [(10, 1), (5, 1), (4, 1)])
    with pytest.raises(ValueError):
        packing.plan_bins({41: 1}, 40)


def test_cross_entropy_difference_equals_plain_counts(spark, true):
    r = random.Random(3)
    rows = [(i, prose(r, r.choice([0, 10, 60]))) for i in range(80)] + [(90, None), (None, "the word"), (4, "the 12 word")]
    good = {i for i in range(0, 80, 3)}
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = lmscore.cross_entropy_difference(df, spark.createDataFrame([(i, True) for i in [*good, 3, None]], "doc_id long, target boolean"), PATH).collect()
    v = true.get_vocab_size()
    coded = [(i, true.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    losses = []
    for part in (lambda i: i in good, lambda i: True):
        one, two, context = Counter(), Counter(), Counter()
        for i, ids in coded:
            if part(i):
                one.update(ids)
                two.update(zip([v, *ids], ids))
                context.update([v, *ids][: len(ids)])
        losses.append((one, two, context))
    f = sum(losses[0][0].values()) / sum(losses[1][0].values())
    want = []
    for i, ids in coded:
        means = []
        for (all_one, all_two, all_context), s, member in zip(losses, (1, f), (i in good, True)):
            # a document is scored by the counts of the others
            own = ids if member else []
            one, two, context = Counter(all_one), Counter(all_two), Counter(all_context)
            one.subtract(own)
            two.subtract(zip([v, *own], own))
            context.subtract([v, *own][: len(own)])
            n = s * sum(one.values())
            bits = [-np.log2((s * two[h, w] + lmscore.PRIOR * (s * one[w] + lmscore.FLAT) / (n + lmscore.FLAT * v)) / (s * context[h] + lmscore.PRIOR)) for h, w in zip([v, *ids], ids)]
            means.append(np.mean(bits) if ids else None)
        want.append((str(i), len(ids), *means, means[0] - means[1] if ids else None))
    key = lambda x: (x[0], x[1], x[2] or 0)
    for a, b in zip(sorted(((str(g.doc_id), *g[1:]) for g in got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2]
        assert a[2:] == (b[2:] if b[1] == 0 else pytest.approx(b[2:], rel=1e-9, abs=1e-9))
    assert lmscore.cross_entropy_difference(df.limit(0), df.select("doc_id"), PATH).count() == 0
