import math
import os
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbaloom.operators import acceptance, compare, filters, metrics, statistics
from verbaloom.plans import experiments, reports
from verbaloom.sources import files, sinks

#: A folder with constructions_formulaic.csv, patterns_all_metrics.csv and schemas_accepted.csv of a published run.
GOLD = os.environ.get("PATTERN_GOLD_DIR", "")


def brute(rows):
    """pattern -> (n, docs, atp, h, npmi, dp, g2) in plain Python; rows: (pattern, lemma, doc, atp)."""
    n, by = len(rows), defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    tam, comp, docs = Counter(p.split(",")[0] for p, *_ in rows), Counter(p.split(",")[1] for p, *_ in rows), Counter(r[2] for r in rows)
    out = {}
    for p, own in by.items():
        o, e = len(own), n / len(by)
        verbs, mine = Counter(r[1] for r in own), Counter(r[2] for r in own)
        h = -sum(c / o * math.log2(c / o) for c in verbs.values())
        dp = sum(abs(mine[d] / o - docs[d] / n) for d in docs) / 2
        q = o / n
        npmi = math.log2(q / (tam[p.split(",")[0]] / n * comp[p.split(",")[1]] / n)) / -math.log2(q) if o < n else 0
        g2 = 2 * (o * math.log(o / e) + ((n - o) * math.log((n - o) / (n - e)) if n > o else 0)) if len(by) > 1 else 0
        out[p] = (o, len(mine), sum(r[3] for r in own) / o, h, npmi, dp, g2)
    return out


ROW = st.tuples(st.sampled_from(["a,x", "a,y", "b,x", "b,z"]), st.sampled_from("uvw"), st.sampled_from("pqr"), st.floats(0, 1))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROW, min_size=1, max_size=30))
def test_metrics_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "pattern string, head_lemma string, doc_id string, instance_atp double, npmi string")
    got = {r.pattern: r for r in metrics.pattern_metrics(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for p, r in got.items():
        assert (r.n_tokens, r.n_docs, r.atp, r.h_slot, r.npmi, r.dispersion, r.g_squared) == pytest.approx(want[p], abs=1e-9)
        assert -1 - 1e-9 <= r.npmi <= 1 + 1e-9 and -1e-9 <= r.dispersion <= 1 and r.p_value_fdr >= r.p_value - 1e-12


def test_odd_rows(spark):
    schema = "pattern string, head_lemma string, doc_id string, instance_atp double"
    assert metrics.pattern_metrics(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([("a,x", None, None, None), ("a,x", None, None, 1.0), (None, "v", "d", 1.0)], schema)
    (r,) = metrics.pattern_metrics(df).collect()
    assert (r.pattern, r.n_tokens, r.n_docs, r.atp, r.h_slot) == ("a,x", 2, 1, 0.5, 0.0)
    # rows without a pattern count in the totals
    assert r.npmi == pytest.approx(math.log2((2 / 3) / (2 / 3 * 2 / 3)) / -math.log2(2 / 3))
    one = metrics.pattern_metrics(spark.createDataFrame([("a,x", "v", "d", 1.0)], schema)).first()
    assert (one.npmi, one.g_squared, one.p_value) == (0.0, 0.0, 1.0)


def test_fdr(spark):
    df = spark.createDataFrame([(str(k), p) for k, p in enumerate([0.001, 0.04, 0.04, 0.5])], "pattern string, p_value double")
    got = [r.p_value_fdr for r in metrics.with_fdr(df).orderBy("pattern").collect()]
    assert got == pytest.approx([0.004, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])


def test_exact_p_value_and_contingency(spark):
    values = [0.0, 0.3, 3.841458820694124, 12.4, 12.6, 60.0, 900.0, None, -1.0]
    got = [r.p for r in spark.createDataFrame(list(enumerate(values)), "k int, g double").orderBy("k").select(metrics.exact_p_value(F.col("g")).alias("p")).collect()]
    assert got[7] is None and [x for x in got if x is not None] == pytest.approx([math.erfc(math.sqrt(max(v, 0) / 2)) for v in values if v is not None], rel=1e-12)
    row = spark.range(1).select(metrics.exact_p_value(F.lit(3.841458820694124)).alias("p"), metrics.g_squared_contingency(*map(F.lit, (10, 20, 30, 5))).alias("g"), metrics.g_squared_contingency(*map(F.lit, (0, 0, 0, 0))).alias("z")).first()
    assert row.p == pytest.approx(0.05, abs=1e-6)
    o, n = [[10, 20], [30, 5]], 65
    want = 2 * sum(o[i][j] * math.log(o[i][j] / (sum(o[i]) * (o[0][j] + o[1][j]) / n)) for i in (0, 1) for j in (0, 1))
    assert row.g.g_squared == pytest.approx(want) and tuple(row.z) == (0.0, 1.0)


def test_instance_metrics(spark):
    rows = [("is being analyzed", "pres", "carefully"), ("has been analyzed", "perf", "thoroughly"), ("will be analyzed", "modal", "soon"), ("has been analyzed", "perf", "carefully"), ("alone", "one", None)]
    df = spark.createDataFrame([(k, c.split(), p, f) for k, (c, p, f) in enumerate(rows)] + [(9, [], "none", "x"), (10, None, "none", "x")], "k int, aux_chain array<string>, pattern string, following_word string")
    got = {r.k: (r.instance_atp, r.instance_dpb, r.instance_hr) for r in statistics.with_instance_metrics(df.where("k < 4")).collect()}
    assert got[0] == pytest.approx((2 / 3, 1 / 6, 0)) and got[1] == pytest.approx((2 / 3, 1 / 3, 1)) and got[2] == pytest.approx((2 / 3, 1 / 6, 0)) and got[3] == pytest.approx((2 / 3, 1 / 3, 1))
    more = {r.k: r for r in statistics.with_instance_metrics(df).collect()}
    assert len(more) == 7 and all((more[k].instance_atp, more[k].instance_dpb, more[k].instance_hr) == (0, 0, math.inf) for k in (4, 9, 10))
    assert filters.formulaic(statistics.with_instance_metrics(df)).count() == 4


def test_published_values(spark):
    # fixed values: a pattern of 5 rows among 114 rows and 63 patterns
    g2, p = spark.range(1).select(metrics.g_squared(F.lit(5), F.lit(114), F.lit(63)).alias("g")).select("g", metrics.p_value(F.col("g"))).first()
    assert (g2, p) == pytest.approx((3.874392893788867, 0.14410739671058048), abs=1e-12)


@pytest.mark.skipif(not os.path.isdir(GOLD), reason="PATTERN_GOLD_DIR is not set")
def test_published_run(spark):
    rows = files.read_instances(spark, f"{GOLD}/constructions_formulaic.csv")
    mine = {r.pattern: r for r in acceptance.accept(metrics.pattern_metrics(rows)).collect()}
    want = files.read_patterns(spark, f"{GOLD}/patterns_all_metrics.csv").collect()
    assert {w.pattern for w in want} == set(mine)
    for w in want:
        for c in metrics.NAMES[1:]:
            assert mine[w.pattern][c] == pytest.approx(w[c], abs=1e-9), (w.pattern, c)
    accepted = files.pattern_names(files.read_patterns(spark, f"{GOLD}/schemas_accepted.csv"))
    assert {p for p, r in mine.items() if r.accepted} == {r.pattern for r in accepted.collect()}


def test_what_is_written_reads_back(spark, tmp_path):
    rows = rows_for_shuffles(spark).withColumns({"surface": F.concat(F.lit('a "b", c\n'), "row_id"), "subjtype": F.lit("PRON"), "subject_text": F.lit(None).cast("string")})
    rows = rows.withColumn("instance_hr", F.when(F.col("row_id") < "3", float("inf")).otherwise(F.col("instance_hr"))).persist()
    got = acceptance.accept(metrics.pattern_metrics(rows)).persist()
    sinks.write_instances(rows, f"{tmp_path}/rows")
    sinks.write_patterns(got, f"{tmp_path}/patterns")
    back = Counter((r.surface, r.instance_hr) for r in files.read_instances(spark, f"{tmp_path}/rows").collect())
    assert back == Counter((r.surface, r.instance_hr) for r in rows.collect())
    assert {r.pattern: (r.n_tokens, r.npmi) for r in files.read_patterns(spark, f"{tmp_path}/patterns").collect()} == {r.pattern: (r.n_tokens, r.npmi) for r in got.collect()}
    sinks.write_inventory(got, f"{tmp_path}/inventory")
    n = got.where("accepted").count()
    assert spark.read.option("header", True).csv(f"{tmp_path}/inventory/patterns").count() == got.count()
    assert spark.read.option("header", True).csv(f"{tmp_path}/inventory/schemas").count() == n
    sinks.write_constructions(rows.withColumn("chain", F.array("tam")), f"{tmp_path}/all")
    sinks.write_json({"patterns": got}, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json/patterns").count() == got.count()
    sinks.write_venn(compare.membership(got, got.where("accepted")), f"{tmp_path}/venn")
    assert sum(r.n for r in spark.read.json(f"{tmp_path}/venn").collect()) == got.count()
    assert f"- total_accepted: {n}" in reports.lane_report(got)
    assert "## Examples" in reports.examples_report(rows, got.where("accepted"))


def rows_for_shuffles(spark, n=60):
    lines = [(str(k), "ab"[k % 2], "xyz"[k * k % 3], "uvw"[k % 3], f"d{k % 5}", 0.5, 0.5, 1.0) for k in range(n)]
    return spark.createDataFrame(lines, "row_id string, tam string, comp string, head_lemma string, doc_id string, instance_atp double, instance_dpb double, instance_hr double").withColumn("pattern", F.concat_ws(",", "tam", "comp"))


def test_shuffles_keep_marginals(spark):
    rows = rows_for_shuffles(spark)
    count = lambda df, *c: Counter(map(tuple, df.select(*c).collect()))
    copies = experiments.comp_shuffle(rows, 3).persist()
    for k in range(3):
        one = copies.where(f"iter = {k}")
        assert one.count() == 60 and count(one, "tam") == count(rows, "tam") and count(one, "comp") == count(rows, "comp")
    assert count(copies.where("iter = 0"), "row_id", "comp") != count(copies.where("iter = 1"), "row_id", "comp")
    verbs = experiments.verb_shuffle(rows, 2).where("iter = 1")
    assert count(verbs, "tam", "head_lemma") == count(rows, "tam", "head_lemma")
    # any number of bucket digits ranks alike
    order = lambda d: sorted((r.row_id, r.rn) for r in experiments.ranked(rows, [], experiments.hashed(1, "row_id"), "row_id", d).collect())
    assert order(0) == order(1) == order(3) and sorted(x for _, x in order(2)) == list(range(1, 61))


def test_replicates_need_no_more_than_lane_metrics(spark):
    rows = rows_for_shuffles(spark, 200)
    for column, copies in (("tam", experiments.tam_shuffle), ("head_lemma", experiments.verb_shuffle)):
        many = copies(rows, 3).persist()
        full = {(r.iter, r.pattern): r for r in metrics.pattern_metrics(many, ["iter"]).collect()}
        lean = metrics.lane_metrics(many, ["iter"]).collect()
        assert len(lean) == len(full)
        for r in lean:
            assert (r.n_tokens, r.h_slot, r.npmi, r.g_squared, r.p_value) == pytest.approx(tuple(full[r.iter, r.pattern][c] for c in ("n_tokens", "h_slot", "npmi", "g_squared", "p_value")), abs=1e-9)
        real = {r.pattern for r in acceptance.accept(metrics.pattern_metrics(rows)).where("accepted").collect()}
        got = {r.iter: (r.n_accepted, r.n_shared, r.n_real) for r in experiments.shuffle_results(rows, column, 3).collect()}
        for k in range(3):
            mine = {r.pattern for r in acceptance.accept(metrics.pattern_metrics(many.where(f"iter = {k}"))).where("accepted").collect()}
            assert got[k] == (len(mine), len(mine & real), len(real))
    assert experiments.digits_for(0) == experiments.digits_for(experiments.RANKED_AT_ONCE) == 0 and experiments.digits_for(experiments.RANKED_AT_ONCE * 17) == 2


def test_histogram_and_jaccard(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (5.0,), (None,)], "x double")
    assert {r.bin: r.n for r in compare.histogram(df, "x", 4).collect()} == {1: 2, 2: 0, 3: 1, 4: 1}
    assert sum(r.n for r in compare.histogram(df.where("x = 1"), "x", 4).collect()) == 2
    assert compare.histogram(df.limit(0), "x").count() == 0
    j = spark.range(1).select(*(compare.jaccard_of_arrays(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>")) for a, b in (([], []), (["x"], []), (["x", "y"], ["y", "z"])))).first()
    assert tuple(j) == (1.0, 0.0, pytest.approx(1 / 3))
    with pytest.raises(ValueError):
        acceptance.accept(df, "other")


def scored_for_cells(spark):
    rows = rows_for_shuffles(spark, 300).withColumns({"instance_atp": (F.col("row_id").cast("string").substr(-1, 1).cast("int") / 10).cast("double"), "instance_dpb": F.lit(0.2), "instance_hr": F.lit(1.0)})
    return rows.persist()


def test_cells_give_what_the_rows_give(spark):
    rows = scored_for_cells(spark)
    full = {r.pattern: r for r in metrics.pattern_metrics(filters.formulaic(rows)).collect()}
    got = {r.pattern: r for r in experiments.accepted_patterns(experiments.cells(rows)).collect()}
    assert set(got) == set(full) and all(got[p][c] == pytest.approx(full[p][c], abs=1e-9) for p in full for c in ("n_tokens", "h_slot", "npmi", "g_squared", "p_value"))
    assert experiments.cells(experiments.cells(rows)).agg(F.sum("_n")).first()[0] == 300
    both = lambda f: [Counter(f(x).collect()) for x in (rows, experiments.cells(rows))]
    for f in (experiments.filter_ablation, experiments.layer_members, experiments.sensitivity):
        one, two = both(f)
        assert one == two and one


@pytest.mark.parametrize("of", [experiments.filter_ablation, experiments.layer_members, experiments.sensitivity])
def test_acceptance_reads_no_documents(spark, of):
    """Only dispersion needs documents, and no experiment looks at it."""
    plan = of(scored_for_cells(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "doc_id" in line]


def test_no_task_has_all_rows_of_a_pattern(spark):
    """Entropies go to the rows, as a pattern may have most of them."""
    rows = spark.createDataFrame([(k, ["is", "kept"], "a,x", f"w{k % 3}") for k in range(50)], "k long, aux_chain array<string>, pattern string, following_word string")
    out = statistics.with_instance_metrics(rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join [pattern" in line and "LeftOuter" in line]
        assert len(joins) == 1 and "BroadcastHashJoin" in joins[0]
        assert out.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_csv_files_do_not_grow_with_the_table(spark, tmp_path):
    """Files with quoted lines are read whole, each by one task."""
    n = sinks.ROWS_A_FILE + 1 if hasattr(sinks, "ROWS_A_FILE") else 200_001
    sinks.write_constructions(spark.range(n).coalesce(1), f"{tmp_path}/rows")
    assert len([f for f in os.listdir(f"{tmp_path}/rows") if f.endswith(".csv")]) == 2
    assert spark.read.option("header", True).csv(f"{tmp_path}/rows").count() == n
