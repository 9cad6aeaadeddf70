import random
import struct
import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from test_decontam import slow as edits_of
from test_similar import grams
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verbaloom.llm import decontam, similar, simhash, substring, toxicity
from verbaloom.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables():
    r = random.Random(12)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "sa", "re", "tu"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    passage, items = prose(52), [" ".join(prose(25)) for _ in range(3)]
    docs, labels = [], []
    for i in range(260):
        w = prose(r.choice([12, 60, 150]))
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            w.insert(r.randint(0, len(w)), r.choice(["fool", "oaf", "zaxka"]))
        if i % 9 == 1:
            w[3:3] = passage
        if i % 25 == 2:
            w += [*r.choice(items).split(), *prose(4)]
        docs.append((i, " ".join(w), "en", "src0", 0))
        labels.append((i, 1, int(bad)))
    docs += [(300 + k, docs[7 * k + 1][1], "en", "src0", 0) for k in range(8)] + [(320, None, None, None, None), (321, "", "en", None, 0), (322, "", "en", None, 0)]
    return [(i, t, a, b, None if t is None else len(t)) for i, t, a, b, _ in docs], labels, list(enumerate(items))


def without_repeats(texts, window=35):
    words = [(t or "").split() for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), []).append((d, s))
    gone = [set() for _ in words]
    for places in seen.values():
        for d, s in places if len(places) > 1 else ():
            gone[d].update(range(s, s + window))
    return [" ".join(x for k, x in enumerate(w) if k not in g) if g else t for t, w, g in zip(texts, words, gone)]


def test_run_equals_brute_force(spark, tmp_path):
    docs, labels, items = tables()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    learn = sorted((i, y, t) for (i, t, *_), (_, _, y) in zip(docs, labels) if zlib.crc32(str(i).encode()) % 5)
    net = toxicity.fit([t for *_, t in learn], np.array([y for _, y, _ in learn]))
    p = toxicity.sigmoid(toxicity.Scorer(net).logits([t for _, t, *_ in docs]))
    left = [d for d, s in zip(docs, p) if s < 0.5]
    assert 40 < len(docs) - len(left) < 90
    sets = [grams(t) for _, t, *_ in left]
    root = components(len(left), *np.nonzero(np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])))
    ids = np.array([d[0] for d in left])
    one = [d for k, d in enumerate(left) if d[0] == ids[root == root[k]].min()]
    assert len(one) < len(left) - 5
    texts = without_repeats([t for _, t, *_ in one])
    assert sum(a != d[1] for a, d in zip(texts, one)) > 10
    keys = [decontam.normalised(b) for _, b in items]
    clean = {d[0]: t for d, t in zip(one, texts) if not any(edits_of(k, decontam.normalised(t or "")) <= int(decontam.RATE * len(k)) for k in keys)}
    assert len(clean) < len(one) - 3

    stages, given = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in P.STAGES[:-1]:
        given = f(spark, given, str(tmp_path))
        assert given.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        given.write.parquet(path := f"{tmp_path}/{len(stages)}")
        given = spark.read.parquet(path)
        stages.append({r.doc_id: r for r in given.collect()})
    assert [set(s) for s in stages] == [set(ids.tolist()), {d[0] for d in one}, {d[0] for d in one}, set(clean)]
    assert {i: r.text for i, r in stages[-1].items()} == clean
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in stages[-1].values())

    got = P.run(spark, str(tmp_path)).collect()
    true = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in clean.items():
        tokens = true.encode(t or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(tokens), 2048)):
            cut = tokens[a : a + 2048]
            want.append((i, k, a, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)


def test_keep_one_with_null_and_repeated_rows(spark):
    a, b, c = "a b c d e f", "u v w x y z", "k l m n o p"
    rows = [(4, a, "p"), (2, a, "q"), (None, a, "r"), (None, b, "s"), (None, b, "t"), (7, c, "u"), (7, c, "v"), (9, None, None), (8, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string").repartition(3)
    for f in (simhash.keep_one, similar.keep_one):
        clash = df.withColumns({"Unnamed_row": F.lit("KEEP1"), "id_of_row": F.lit("KEEP2"), "HASH_of_row": F.lit("KEEP3"), "_hash": F.lit("KEEP4"), "_id": F.lit(5), "_unnamed": F.lit(6), "node": F.lit(7), "row": F.lit(8)})
        back = f(clash)
        assert back.columns == clash.columns and {tuple(r)[3:] for r in back.collect()} == {("KEEP1", "KEEP2", "KEEP3", "KEEP4", 5, 6, 7, 8)}
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("2", a), ("None", b), ("7", c), ("8", "")])
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_filters_keep_all_columns(spark):
    net = toxicity.fit(["ka lo", "fool"] * 40, np.array([0, 1] * 40))
    df = spark.createDataFrame([(1, "ka lo", 0.25), (2, "fool", 1.0), (None, None, None)], "doc_id long, text string, score double")
    assert sorted((str(r.doc_id), r.score) for r in toxicity.drop_toxic(df, net).collect()) in ([("1", 0.25)], [("1", 0.25), ("None", None)])
    long = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([("x", 1, long, [1, 2]), ("y", 2, f"{long} end", None), (None, None, None, None)], "n_words string, doc_id long, text string, rest_0 array<int>")
    got = substring.without_repeats(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("x", 1, "", [1, 2]), ("y", 2, "end", None), (None, None, None, None)], key=str)
    assert substring.without_repeats(df.limit(0)).count() == 0
