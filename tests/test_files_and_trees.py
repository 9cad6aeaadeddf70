import random

import pandas as pd
from pyspark.sql import functions as F

from verbaloom.functions.schemas import PARSE
from verbaloom.operators import tree
from verbaloom.plans import fixtures, pipeline
from verbaloom.sources import files
from verbaloom.streaming.ingest import ingest

ASC = {
    "A1": "# sent_id = 1\n1\tIt\tit\t\n2\tis\tbe\tATTR\n3\ttime\ttime\n\n4\tnow\tnow\n# sent_id = 2\n# a remark\n1\tseen\tsee\tPASSIVE\n2\tshort\n",
    "A2": "1\tx\ty\tPASSIVE",
    "A3": "# sent_id = 1\none\tx\ty\n2\ta\tb\tATTR\n",
    "A4": "",
}


def folder(tmp_path, names=tuple(ASC)):
    path = tmp_path / "asc"
    path.mkdir(exist_ok=True)
    for n in names:
        (path / f"{n}_ASCinfo.txt").write_text(ASC[n])
    (path / "other.txt").write_text("1\tq\tq\tPASSIVE")
    return str(path)


def test_annotated_files(spark, tmp_path):
    given = files.read_asc_files(spark, folder(tmp_path))
    assert {r.doc_id: r.value for r in given.collect()} == {k: v for k, v in ASC.items() if v}
    got = sorted(map(tuple, files.asc_tokens(given).collect()), key=str)
    assert got == [("A1", 1, 1, "It", "it", None), ("A1", 1, 2, "is", "be", "ATTR"), ("A1", 1, 3, "time", "time", None), ("A1", 1, 4, "now", "now", None), ("A1", 2, 1, "seen", "see", "PASSIVE"), ("A2", 1, 1, "x", "y", "PASSIVE")]
    assert [r.doc_id for r in files.failed_files(given).collect()] == ["A3"]
    loose = {r.doc_id: (r.total_sentences, r.total_tokens) for r in files.asc_totals(given).collect()}
    assert loose == {"A1": (3, 5), "A2": (1, 1), "A3": (1, 2)}
    assert files.asc_tokens(given.limit(0)).count() == 0


def test_stream_takes_each_file_once(spark, tmp_path):
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    path = folder(tmp_path, ("A1",))
    ingest(spark, path, out, marks).awaitTermination(120)
    assert spark.read.parquet(f"{out}/tokens").count() == 5
    folder(tmp_path)
    ingest(spark, path, out, marks).awaitTermination(120)
    assert spark.read.parquet(f"{out}/tokens").count() == 6 and spark.read.parquet(f"{out}/failed").count() == 1


def test_corpus_lists_and_resume(spark, tmp_path):
    (tmp_path / "c.csv").write_text('file_name,text_field\nd1,"two\nlines, ""quoted"""\nd2,plain\n', encoding="utf-8")
    corpus = files.read_corpus(spark, str(tmp_path / "c.csv"), "file_name", "text_field")
    assert sorted(map(tuple, corpus.collect())) == [("d1", 'two\nlines, "quoted"'), ("d2", "plain")]
    (tmp_path / "list.txt").write_text(" d2 \n\nd9\n")
    wanted = files.read_list(spark, str(tmp_path / "list.txt"))
    assert {r.doc_id: r.found for r in files.listed_documents(wanted, corpus).collect()} == {"d2": True, "d9": False}
    assert [r.doc_id for r in files.missing_documents(corpus, wanted).collect()] == ["d1"]


WANT = {
    1: ("The book was written by students", "past-be,by_NP", "DEF_NP", "write", "The book", ["was", "written"], "students"),
    2: ("It has been analyzed", "perf-be,Ø", "PRON", "analyze", "It", ["has", "been", "analyzed"], None),
    3: ("Cities were located near train tracks", "past-be,pp_near_NP", "PL_NP", "locate", "Cities", ["were", "located"], "train"),
    4: ("that are being referred to", "prog-be,pp_to_NP", "REL", "refer", "that", ["are", "being", "referred"], None),
    5: ("should be offered outside of the classroom", "modal-be,pp_outside_NP", "DEF_NP", "offer", None, ["should", "be", "offered"], "classroom"),
}


def test_trees(spark):
    tokens, parse = (x.where("doc_id = 'T1'") for x in fixtures.trees(spark))
    rows = tree.constructions(tokens.withColumn("h", F.lit(1)), parse.withColumn("kids", F.lit("x"))).collect()
    assert {r.sent_idx: (r.surface, r.pattern, r.subjtype, r.head_lemma, r.subject_text, r.aux_chain, r.following_word) for r in rows} == WANT
    kept = {r.sent_idx: r.complements for r in rows}
    assert kept[1] == {"by": "by students", "prep_head": "by"} and kept[5] == {"prep_head": "outside", "pp_outside": "outside of the classroom"} and kept[2] == {}
    assert tree.constructions(tokens.limit(0), parse).count() == 0
    # a second tag of one lemma meets the same head; a lemma without a head gives nothing
    more = spark.createDataFrame([("T1", 1, 7, "w", "write", "PASSIVE"), ("T1", 2, 8, "z", "zap", "PASSIVE"), (None, 1, 1, "w", "write", "PASSIVE")], tokens.schema)
    assert tree.constructions(tokens.union(more), parse).count() == 6


def test_subtrees_equal_a_walk(spark):
    r = random.Random(6)
    rows, want = [], {}
    for s in range(25):
        n = r.randint(1, 12)
        heads = [0] + [r.randrange(k) for k in range(1, n)]
        order = r.sample(range(n), n)
        heads = {order[k]: order[heads[k]] for k in range(n)}
        root = r.randrange(n)
        below, grew = {root}, True
        while grew:
            more = {i for i, h in heads.items() if h in below} | below
            grew, below = more != below, more
        want[s] = (root, sorted(below))
        rows += [("d", s, i, f"w{i}", "x", "T", "P", "dep", heads[i], None) for i in range(n)]
    parse = spark.createDataFrame(rows, PARSE).groupBy("sent_idx").agg(F.array_sort(F.collect_list(F.struct("i", "text", "head_i"))).alias("s"))
    roots = spark.createDataFrame([(s, x[0]) for s, x in want.items()], "sent_idx int, root int")
    got = parse.join(roots, "sent_idx").select("sent_idx", F.transform(tree.subtree(F.col("s"), F.col("root")), lambda t: t["i"]).alias("ids"))
    assert {x.sent_idx: x.ids for x in got.collect()} == {s: x[1] for s, x in want.items()}


def test_from_tags_to_patterns(spark):
    tokens, parse = (x.where("doc_id = 'T1'") for x in fixtures.trees(spark))
    known = {(r.doc_id, r.sent_idx): [] for r in parse.collect()}
    for r in parse.collect():
        known[r.doc_id, r.sent_idx].append(tuple(r))

    def annotator(batches):
        for b in batches:
            yield pd.DataFrame([t for d, s in zip(b.doc_id, b.sent_idx) for t in known[d, s]], columns=PARSE.names)

    quiet = spark.createDataFrame([("T1", 9, 1, "no", "no", None)], tokens.schema)
    assert {r.sent_idx: r.text for r in tree.sentences(tokens.union(quiet)).collect()}.keys() == WANT.keys()
    raw = pipeline.extract(tokens.union(quiet), annotator, 2).persist()
    full, bare = pipeline.analyse(raw), pipeline.analyse(raw, normalize=False, validate_lemmas=False, doc_ids=False)
    assert full.scored.count() == bare.scored.count() == 5
    assert {r.head_lemma for r in full.scored.collect()} == {"write", "analyze", "locate", "refer", "offer"}
    assert bare.patterns.agg(F.max("n_docs")).first()[0] in (None, 1)
    assert pipeline.analyse(raw.limit(0)).patterns.count() == 0
