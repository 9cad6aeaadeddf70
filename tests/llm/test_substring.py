import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from verbaloom.llm.substring import OP5_SQL, LogConflict, WindowLog, cut, range_bits, remove_repeats

SCHEMA = "doc_id long, text string, source string"


def brute(texts, window):
    words = {i: (t or "").encode().split() for i, t in texts}
    seen = Counter(tuple(w[s : s + window]) for w in words.values() for s in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def corpus(seed=3, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 3)))
    passages = [[word() for _ in range(r.randint(30, 60))] for _ in range(4)]
    texts = []
    for i in range(n):
        w = [word() for _ in range(r.choice([0, 3, 40, 150]))]
        for _ in range(r.choice([0, 0, 1, 2])):
            p, at = r.choice(passages), r.randint(0, len(w))
            w[at:at] = p[r.randint(0, 5) :]
        texts.append((i, r.choice([" ", "\n", " \t"]).join(w)))
    texts += [(n, None), (n + 1, ""), (n + 2, "x " * 100), (n + 3, "x " * 34), (n + 4, texts[5][1]), (n + 5, "one two " * 40), (n + 6, "solo " * 35)]
    return texts


def digests(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_equals_brute_force(spark):
    for window in (35, 6):
        texts = corpus()
        df = spark.createDataFrame([(i, t, "s") for i, t in texts], SCHEMA).repartition(3)
        assert digests(remove_repeats(df, window, digest=True)) == brute(texts, window)


def test_texts_empty_and_unchanged(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    got = {r.doc_id: r.text for r in remove_repeats(spark.createDataFrame([(1, "a\n b", "s"), (2, None, "s"), (None, "", "s")], SCHEMA)).collect()}
    assert got == {1: "a\n b", 2: None, None: ""}


def batch_of(spark, rows):
    return spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA)


def test_log_remembers_earlier_batches(spark, tmp_path):
    texts = corpus(seed=8, n=40)
    log = WindowLog(spark, str(tmp_path / "log"), window=12, fan=2)
    for k in range(4):
        batch = texts[k::4]
        got = digests(remove_repeats(batch_of(spark, batch), 12, log, f"b{k}", digest=True))
        so_far = [x for j in range(k + 1) for x in texts[j::4]]
        want = brute(so_far, 12)
        assert got == {i: want[i] for i, _ in batch}
    state = log.state()
    assert len(state["runs"]) <= 2 and len(state["batches"]) == 4
    # a batch that comes again is judged again, and is no history of its own
    assert digests(remove_repeats(batch_of(spark, texts[3::4]), 12, log, "b3", digest=True)) == got
    assert log.state() == state
    log.vacuum()
    assert sum(p.name.startswith("run-") for p in (tmp_path / "log").iterdir()) == len(state["runs"]) and log.state() == state
    assert digests(log.judged({f"b{k}": None for k in range(4)}, digest=True)) == brute(texts, 12)


def test_a_commit_that_dies_leaves_the_log_as_it_was(spark, tmp_path, monkeypatch):
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(3)]
    log = WindowLog(spark, str(tmp_path / "log"), window=5)
    remove_repeats(batch_of(spark, texts), 5, log, "one").collect()
    before = log.state()
    true = WindowLog._commit

    def dies(self, state):
        if "two" in state["batches"]:
            raise OSError("gone")
        true(self, state)

    monkeypatch.setattr(WindowLog, "_commit", dies)
    with pytest.raises(OSError):
        log.add(batch_of(spark, texts), "two")
    monkeypatch.setattr(WindowLog, "_commit", true)
    # drafts and folders that no manifest names count for nothing
    (tmp_path / "log" / "drafts" / "unfinished").write_text("{")
    (tmp_path / "log" / "run-unfinished").mkdir()
    after = log.state()
    assert (after["batches"], after["runs"]) == (before["batches"], before["runs"])
    got = remove_repeats(batch_of(spark, texts), 5, log, "two", digest=True).collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(20, 20)] * 3


def test_two_writers_do_not_lose_a_batch(spark, tmp_path):
    log = WindowLog(spark, str(tmp_path / "log"), window=5)
    stale = log.state()
    log.add(batch_of(spark, [(1, "a b c d e f")]), "one")
    with pytest.raises(LogConflict):
        log._commit(stale | {"batches": {"lost": {}}})
    assert list(log.state()["batches"]) == ["one"]
    with pytest.raises(ValueError):
        WindowLog(spark, str(tmp_path / "log"), window=6).state()


def test_words_are_compared_not_their_hashes(monkeypatch):
    from verbaloom.llm import substring

    w = substring.Words([b"a b c d e f", b"a b c d e g"], 3)
    d = w.digests(np.array([0, 3, 6, 9]))
    assert (d[0] == d[2]).all() and not (d[1] == d[3]).all()
    assert substring.digest_run(d)[1].tolist().count(2) == 1


def test_ranges_are_occupied_ones_and_nest():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64))
    for bits in (1, 10, 24, 31):
        parts = cut(v, bits)
        assert len(parts) <= 500 and [x for _, a, b in parts for x in v[a:b]] == v.tolist()
        assert all((v[a:b] >> np.uint64(64 - bits) == r).all() for r, a, b in parts)
    assert cut(v[:0], 8) == [] and range_bits(0) == 1 and range_bits(10**14) == 24


def test_sql_says_the_same(spark):
    import duckdb

    texts = corpus(n=30)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert {r[0]: r[1:] for r in con.execute(OP5_SQL).fetchall()} == brute(texts, 35)
