import random

from verbaloom.llm import decontam as D


def slow(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def peq(s):
    out = {}
    for j, c in enumerate(s):
        out[c] = out.get(c, 0) | 1 << j
    return out


def damaged(r, s, edits):
    s = list(s)
    for _ in range(edits):
        at = r.randrange(len(s))
        kind = r.choice("sid")
        if kind == "d":
            del s[at]
        else:
            s[at : at + (kind == "s")] = [r.choice("abcdé ")]
    return "".join(s)


def test_myers_equals_the_table():
    r = random.Random(2)
    for _ in range(300):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 120)))
        assert D.myers(peq(p), len(p), t)[0] == slow(p, t)


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(r.choice([5, 20, 50])).capitalize() + ".") for i in range(12)]
    docs = []
    for i in range(120):
        text = prose(r.choice([0, 10, 80]))
        for _ in range(r.choice([0, 1, 1, 2])):
            item = r.choice(items)[1]
            item = damaged(r, item, r.choice([0, 0, 2, 6, 15]))
            if r.random() < 0.3:
                item = item.upper().replace(" ", " ,\n")
            text += " " + item + "!! " + prose(5)
        docs.append((i, text))
    return items, docs


def test_equals_brute_force(spark):
    items, docs = corpus()
    want = {}
    for i, t in docs:
        for k, b in items:
            p = D.normalised(b)
            d = slow(p, D.normalised(t))
            if d <= int(D.RATE * len(p)):
                want[i, k] = d
    assert 20 < len(want) < 200
    bench = spark.createDataFrame([(k, b, 1) for k, b in items] + [(99, None, 1), (98, " ", 1), (3, items[3][1], 2)], "item_id long, text string, doc_id int")
    df = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(500, None, "x"), (None, "", "x")], "doc_id long, text string, item_id string").repartition(3)
    got = {(r.doc_id, r.item_id): r.distance for r in D.matches(df, bench).collect()}
    assert got == want
    left = {r.doc_id for r in D.decontaminate(df, bench).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want} | {500, None}
    assert D.decontaminate(df, bench).columns == df.columns


def test_blocks_of_items(spark, monkeypatch):
    items, docs = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(D.matches(df, bench).collect())
    monkeypatch.setattr(D, "BLOCK_CHARS", 500)
    assert len(D.blocks(bench)) > 1
    assert sorted(D.matches(df, bench).collect()) == one
    assert D.decontaminate(df, bench).count() == len(docs) - len({r.doc_id for r in one})


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.matches(df, bench).count() == 0 and D.decontaminate(df, bench).count() == 1
    assert D.matches(df.limit(0), df.select(df.doc_id.alias("item_id"), "text")).count() == 0
