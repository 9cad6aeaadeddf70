"""Validation experiments, each one plan over all of its replicates or settings.

A replicate is a shuffle of one column among the rows. Rows are ranked by a hash of (seed, replicate, row id), so results
are the same on any cluster. Where a replicate is too large for one task to rank, a global rank is a rank within a hash
bucket plus the sizes of the buckets before it: tasks stay even.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.classify import pattern
from ..operators import acceptance, compare, filters, metrics

#: Rows that one task may rank; more are dealt into hash buckets.
RANKED_AT_ONCE = 200_000


def digits_for(n: int) -> int:
    """Hexadecimal digits of the hash that make a bucket, so that buckets of n rows have RANKED_AT_ONCE rows at most on average."""
    digits = 0
    while n > RANKED_AT_ONCE * 16**digits:
        digits += 1
    return digits


def hashed(seed: int | str, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def ranked(rows: DataFrame, by: Sequence[str], order: Column, tie: str, digits: int = 0) -> DataFrame:
    """Adds rn, the place (from 1) of each row among those equal in ``by``, by the hash ``order``.

    With ``digits``, a place is the place in a hash bucket plus the sizes of the buckets before it.
    """
    rows = rows.withColumn("_h", order)
    if not digits:
        return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("_h", tie)).cast("long")).drop("_h")
    rows = rows.withColumn("_b", F.substring("_h", 1, digits))
    sizes = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", tie))
    return rows.withColumn("_r", place).join(before, [*by, "_b"]).withColumn("rn", F.col("_before") + F.col("_r")).drop("_h", "_b", "_r", "_before")


def shuffled(rows: DataFrame, column: str, iterations: int, seed: int | str = 42, within: Sequence[str] = (), row_id: str = "row_id", digits: int | None = None) -> DataFrame:
    """``iterations`` copies of the rows (iter from 0), with ``column`` dealt anew among rows that are equal in ``within``.

    Rows need a unique ``row_id``. The row ranked k by hash(seed, iter, row id) gets the value of the row ranked k by
    hash(seed, row id). Only one side is as large as all copies; the values are ranked once.
    """
    digits = digits_for(rows.count()) if digits is None else digits
    many = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iter")
    kept = [c for c in rows.columns if c != column]
    values = ranked(rows.select(row_id, column, *(c for c in within if c != row_id)), within, hashed(seed, row_id), row_id, digits).select(*within, "rn", column)
    dealt = ranked(rows.select(*kept, many), ["iter", *within], hashed(seed, "iter", row_id), row_id, digits)
    return dealt.join(values, [*within, "rn"]).drop("rn")


def tam_shuffle(rows: DataFrame, iterations: int = 1000, seed: int | str = 42) -> DataFrame:
    return shuffled(rows, "tam", iterations, seed).withColumn("pattern", pattern(F.col("tam"), F.col("comp")))


def comp_shuffle(rows: DataFrame, iterations: int = 1000, seed: int | str = 42) -> DataFrame:
    return shuffled(rows, "comp", iterations, seed).withColumn("pattern", pattern(F.col("tam"), F.col("comp")))


def verb_shuffle(rows: DataFrame, iterations: int = 1000, seed: int | str = 42) -> DataFrame:
    return shuffled(rows, "head_lemma", iterations, seed, within=("tam",))


def replicate_results(rows: DataFrame, copies: DataFrame, iterations: int, mode: str = "production") -> DataFrame:
    """(iter, n_accepted, n_shared, n_real, jaccard): each replicate's accepted patterns against those of the rows.

    Only the metrics that acceptance looks at are worked out.
    """
    real = acceptance.accept(metrics.lane_metrics(rows), mode).where("accepted").select("pattern")
    n_real = real.agg(F.count("*")).scalar()
    accepted = acceptance.accept(metrics.lane_metrics(copies, ["iter"]), mode).where("accepted").select("iter", "pattern")
    known = accepted.join(real.withColumn("_real", F.lit(1)), "pattern", "left").groupBy("iter").agg(F.count("*").alias("n_accepted"), F.count("_real").alias("n_shared"))
    all_ = rows.sparkSession.range(iterations).select(F.col("id").cast("int").alias("iter"))
    out = all_.join(known, "iter", "left").select("iter", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_accepted", "n_shared"))).withColumn("n_real", n_real)
    return out.withColumn("jaccard", compare.jaccard(F.col("n_shared"), F.col("n_real"), F.col("n_accepted")))


def shuffle_results(rows: DataFrame, column: str, iterations: int = 1000, seed: int | str = 42, mode: str = "production") -> DataFrame:
    """replicate_results of a shuffle of tam, comp or head_lemma (the last within tam), from the columns that it needs."""
    slim = rows.select("row_id", "tam", "comp", "pattern", "head_lemma")
    copies = {"tam": tam_shuffle, "comp": comp_shuffle, "head_lemma": verb_shuffle}[column](slim, iterations, seed)
    return replicate_results(slim, copies, iterations, mode)


def replicate_summary(results: DataFrame) -> DataFrame:
    """One row: statistics of counts, overlaps and Jaccard indices, p-values and verdicts."""
    p = lambda c: F.avg(c.cast("double"))
    out = results.agg(
        F.count("*").alias("n_iterations"), F.max("n_real").alias("observed"), *compare.spread("n_accepted", "permuted"), *compare.spread("jaccard", "jaccard"),
        F.avg("n_shared").alias("mean_overlap"), F.max("n_shared").alias("max_overlap"),
        p(F.col("n_accepted") >= F.col("n_real")).alias("p_value_count"), p(F.col("jaccard") >= 0.5).alias("p_value_identity"),
    )
    z = F.when(F.col("std_permuted") > 0, F.try_divide(F.col("observed") - F.col("mean_permuted"), F.col("std_permuted"))).otherwise(F.lit(0.0))
    return out.withColumns({"z_score": z, "count_test_significant": F.col("p_value_count") < 0.05, "identity_test_valid": F.col("mean_jaccard") < 0.3})


def _settings(grid: dict[str, list[float]]) -> list[dict]:
    base = {"atp": vocab.ATP, "dpb": vocab.DPB, "hr": vocab.HR, "npmi": vocab.NPMI, "h_slot": vocab.H_SLOT}
    return [{"param": p, "value": float(v), **(base | {p: float(v)})} for p, vs in grid.items() for v in vs]


def _literals(settings: list[dict]) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in s.items())) for s in settings))


CELL = ["pattern", "head_lemma", "instance_atp", "instance_dpb", "instance_hr"]


def cells(rows: DataFrame) -> DataFrame:
    """(CELL, _n): all that instance filters and acceptance look at, counted; instance metrics depend on chain and pattern alone, so there are few.

    Of cells it gives the same cells.
    """
    return rows.groupBy(*CELL).agg((F.sum("_n") if "_n" in rows.columns else F.count("*")).alias("_n"))


def run_settings(rows: DataFrame, settings: list[dict], keep: list[str]) -> DataFrame:
    """Size, metrics of acceptance and acceptance of each pattern for each setting (atp, dpb, hr, npmi, h_slot, and the names in ``keep``).

    Cells of the rows, not the rows, are copied once for each distinct setting of the instance thresholds that they pass;
    settings of the pattern thresholds share those metrics.
    """
    layer1 = ["atp", "dpb", "hr"]
    distinct = [dict(zip(layer1, x)) for x in sorted({tuple(s[k] for k in layer1) for s in settings})]
    passed = F.filter(_literals(distinct), lambda s: filters.layer1_reason(s["atp"], s["dpb"], s["hr"]).isNull())
    copies = cells(rows).withColumn("_s", F.explode(passed)).select("pattern", "head_lemma", "_n", *(F.col(f"_s.{k}").alias(f"_{k}") for k in layer1))
    found = metrics.lane_metrics_of_cells(copies, [f"_{k}" for k in layer1])
    same = F.filter(_literals(settings), lambda s: (s["atp"] == F.col("_atp")) & (s["dpb"] == F.col("_dpb")) & (s["hr"] == F.col("_hr")))
    by_setting = found.withColumn("_s", F.explode(same)).select(*(F.col(f"_s.{k}").alias(k) for k in keep), F.col("_s.npmi").alias("_npmi"), F.col("_s.h_slot").alias("_h_slot"), "pattern", "n_tokens", "h_slot", "npmi", "g_squared", "p_value")
    return acceptance.with_lanes(by_setting, npmi=F.col("_npmi"), h_slot=F.col("_h_slot")).drop("_npmi", "_h_slot")


def sensitivity(rows: DataFrame, grid: dict[str, list[float]] | None = None) -> DataFrame:
    """(param, value, pattern): patterns accepted when one threshold at a time takes the values of the grid."""
    return run_settings(rows, _settings(grid or vocab.GRID), ["param", "value"]).where("accepted").select("param", "value", "pattern")


def sensitivity_counts(accepted: DataFrame, grid: dict[str, list[float]] | None = None) -> DataFrame:
    """(param, value, n_accepted), 0 where a setting accepts none."""
    rows = [(s["param"], s["value"]) for s in _settings(grid or vocab.GRID)]
    all_ = accepted.sparkSession.createDataFrame(rows, "param string, value double")
    return all_.join(accepted.groupBy("param", "value").agg(F.count("*").alias("n")), ["param", "value"], "left").select("param", "value", F.coalesce("n", F.lit(0)).alias("n_accepted"))


def stable_patterns(accepted: DataFrame, values: int = 5) -> DataFrame:
    """(param, pattern, n): patterns that most values of a parameter accept."""
    return accepted.groupBy("param", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= values // 2 + 1)


def pattern_stability(accepted: DataFrame, observed: DataFrame, values: int = 5, params: int = 5) -> DataFrame:
    """(pattern, presence_count, stability_percentage, classification, stable_params, globally_stable) of the observed patterns."""
    present = accepted.groupBy("pattern").agg(F.count("*").alias("presence_count"))
    stable = stable_patterns(accepted, values).groupBy("pattern").agg(F.count("*").alias("stable_params"))
    out = observed.select("pattern").join(present, "pattern", "left").join(stable, "pattern", "left").fillna(0, ["presence_count", "stable_params"])
    share = F.col("presence_count") / F.lit(values * params) * 100
    return out.select("pattern", "presence_count", F.bround(share, 1).alias("stability_percentage"), F.when(share >= 80, "Globally stable").otherwise("Parameter-sensitive").alias("classification"), "stable_params", (F.col("stable_params") == params).alias("globally_stable"))


def globally_stable(accepted: DataFrame, values: int = 5, params: int = 5) -> DataFrame:
    """(pattern): stable under every parameter, observed or not."""
    return stable_patterns(accepted, values).groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") == params).select("pattern")


def filter_ablation(rows: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(config, formulaic_count, schema_count, change_formulaic, change_schemas): one instance filter left out at a time.

    ``keep`` may store the counts, which are read three times.
    """
    base = {"atp": vocab.ATP, "dpb": vocab.DPB, "hr": vocab.HR, "npmi": vocab.NPMI, "h_slot": vocab.H_SLOT}
    none = {"atp": float("-inf"), "dpb": float("-inf"), "hr": float("inf")}
    settings = [{"config": "full_pipeline", **base}, *({"config": f"no_{k}", **base, k: none[k]} for k in ("atp", "dpb", "hr"))]
    found = run_settings(rows, settings, ["config"]).groupBy("config").agg(F.sum("n_tokens").alias("a"), F.count_if("accepted").alias("b"))
    all_ = rows.sparkSession.createDataFrame([(s["config"],) for s in settings], "config string")
    out = keep(all_.join(found, "config", "left").select("config", F.coalesce("a", F.lit(0)).alias("formulaic_count"), F.coalesce("b", F.lit(0)).alias("schema_count")))
    full = out.where("config = 'full_pipeline'")
    less = lambda c: F.col(c) - full.select(c).scalar()
    return out.withColumns({"change_formulaic": less("formulaic_count"), "change_schemas": less("schema_count")})


def lane_ablation(patterns: DataFrame) -> DataFrame:
    """(config, schema_count, change): either lane, one alone, or both."""
    p = acceptance.with_lanes(patterns)
    a, b = F.col("npmi_pass"), F.col("h_slot_pass")
    tests = {"full_dual_lane": a | b, "npmi_only": a, "h_slot_only": b, "both_required": a & b}
    passed = F.filter(F.array(*(F.struct(F.lit(k).alias("config"), t.alias("ok")) for k, t in tests.items())), lambda s: s["ok"])
    all_ = patterns.sparkSession.createDataFrame([(k,) for k in tests], "config string")
    found = p.select(F.explode(passed).alias("s")).groupBy("s.config").agg(F.count("*").alias("n"))
    out = all_.join(found, "config", "left").select("config", F.coalesce("n", F.lit(0)).alias("schema_count"))
    return out.withColumn("change", F.col("schema_count") - out.where("config = 'full_dual_lane'").select("schema_count").scalar())


CONFIGS = ["FULL", "NO_LAYER1", "NPMI_ONLY", "H_SLOT_ONLY", "FREQ_ONLY"]


def accepted_patterns(rows: DataFrame) -> DataFrame:
    """The patterns of formulaic rows, or cells, with what acceptance looks at and its outcome."""
    return acceptance.accept(metrics.lane_metrics_of_cells(cells(filters.formulaic(rows))))


def layer_members(rows: DataFrame, least: int = 3) -> DataFrame:
    """(config, pattern): patterns that each configuration of the layers accepts, from the rows or their cells."""
    counted = cells(rows)
    kept = acceptance.with_lanes(metrics.lane_metrics_of_cells(filters.formulaic(counted)))
    tests = {"FULL": F.col("accepted"), "NPMI_ONLY": F.col("npmi_pass"), "H_SLOT_ONLY": F.col("h_slot_pass")}
    passed = F.filter(F.array(*(F.struct(F.lit(k).alias("config"), t.alias("ok")) for k, t in tests.items())), lambda s: s["ok"])
    one = kept.select(F.explode(passed).alias("s"), "pattern").select("s.config", "pattern")
    two = acceptance.with_lanes(metrics.lane_metrics_of_cells(counted)).where("accepted").select(F.lit("NO_LAYER1").alias("config"), "pattern")
    often = counted.groupBy("pattern").agg(F.sum("_n").alias("n")).where(F.col("n") >= least)
    return one.union(two).union(often.select(F.lit("FREQ_ONLY"), "pattern"))


def layer_ablation(members: DataFrame) -> DataFrame:
    """One row: how many patterns each configuration accepts, and what each layer adds."""
    has = members.groupBy("pattern").agg(*(F.max((F.col("config") == c).cast("int")).alias(c) for c in CONFIGS))
    c = lambda test, name: F.count_if(test).alias(name)
    full, none, npmi, slot, freq = ((F.col(x) == 1) for x in CONFIGS)
    return has.agg(
        c(full, "n_full"), c(none, "n_no_layer1"), c(npmi, "n_npmi_only"), c(slot, "n_h_slot_only"), c(freq, "n_freq_only"),
        (F.count_if(none) - F.count_if(full)).alias("layer1_contribution"), c(none & ~full, "layer1_filters_out"),
        c(npmi & ~slot, "npmi_unique"), c(slot & ~npmi, "h_slot_unique"), c(npmi & slot, "both_lanes"), c(full & ~(npmi & slot), "rescued_by_or_logic"),
    )


def layer1_ablation(members: DataFrame) -> DataFrame:
    """One row: accepted with and without the instance filters, those only without (false positives), and the reduction in per cent."""
    x = layer_ablation(members)
    gain = F.when(F.col("n_no_layer1") > 0, F.bround(F.try_divide((F.col("n_no_layer1") - F.col("n_full")) * 100.0, F.col("n_no_layer1")), 1)).otherwise(F.lit(0.0))
    return x.select(F.col("n_full").alias("with_layer1"), F.col("n_no_layer1").alias("without_layer1"), F.col("layer1_filters_out").alias("false_positives"), gain.alias("reduction_percentage"))


def venn(members: DataFrame, a: str = "FULL", b: str = "NO_LAYER1") -> DataFrame:
    """(pattern, part): members of two configurations, in one alone or in both."""
    one, two = (members.where(F.col("config") == c) for c in (a, b))
    return compare.membership(one, two, names=(f"{a}_only", f"{b}_only"))


def examples(rows: DataFrame, accepted: DataFrame, most: int = 5, seed: int | str = 42, row_id: str = "row_id") -> DataFrame:
    """At most ``most`` rows of each accepted pattern, the first by hash: pattern, rank, surface, subject, verb, doc_id, atp, dpb, hr."""
    mine = rows.join(accepted.select("pattern").distinct(), "pattern", "left_semi").withColumn("_h", hashed(seed, row_id))
    # a window limit is pushed below the shuffle, so a frequent pattern sends ``most`` rows a task
    w = Window.partitionBy("pattern").orderBy("_h", row_id)
    top = mine.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    number = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    return top.select("pattern", "rank", F.col("surface"), F.coalesce("subject_text", F.lit("")).alias("subject"), F.col("head_lemma").alias("verb"), "doc_id", number("instance_atp", 0.0).alias("atp"), number("instance_dpb", 0.0).alias("dpb"), number("instance_hr", 999.0).alias("hr"))


def example_semantics(found: DataFrame, top: int = 5) -> DataFrame:
    """(pattern, n_examples, unique_verbs, top_verbs, avg_atp, avg_dpb) of the examples; top_verbs as verb(count)."""
    verbs = found.groupBy("pattern", "verb").agg(F.count("*").alias("n"), F.sum("atp").alias("atp"), F.sum("dpb").alias("dpb"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("verb"))))
    out = verbs.groupBy("pattern").agg(F.sum("n").alias("n_examples"), F.count("*").alias("unique_verbs"), ordered.alias("v"), F.sum("atp").alias("a"), F.sum("dpb").alias("d"))
    named = F.array_join(F.transform(F.slice("v", 1, top), lambda x: F.concat(x["verb"], F.lit("("), -x["k"], F.lit(")"))), ", ")
    return out.select("pattern", "n_examples", "unique_verbs", named.alias("top_verbs"), (F.col("a") / F.col("n_examples")).alias("avg_atp"), (F.col("d") / F.col("n_examples")).alias("avg_dpb"))


def cascade(raw: DataFrame, valid: DataFrame, formulaic: DataFrame, patterns: DataFrame) -> DataFrame:
    """(stage, n, percent): what is left after each filter; percentages of the stage before, rounded half to even to two decimals (NaN of an empty stage)."""
    n = lambda df, name: df.agg(F.count("*").cast("double").alias(name))
    # one row each
    all_ = n(raw, "a").join(n(valid, "b")).join(n(formulaic, "c")).join(patterns.agg(F.count("*").cast("double").alias("d"), F.count_if("accepted").cast("double").alias("e")))
    share = lambda x, y: F.coalesce(F.bround(F.try_divide(F.col(x) * 100.0, F.col(y)), 2), F.lit(float("nan")))
    rows = [("total", "a", F.lit(100.0)), ("valid", "b", share("b", "a")), ("formulaic", "c", share("c", "b")), ("patterns", "d", F.lit(None).cast("double")), ("accepted", "e", share("e", "d"))]
    return all_.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(c).cast("long").alias("n"), p.alias("percent")) for s, c, p in rows))).alias("r")).select("r.*")
