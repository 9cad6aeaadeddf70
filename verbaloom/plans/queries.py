"""The registered queries of the reference operators; each reads whole tables.

Those that start from ``raw`` use the rows of ``documents`` whose lang is ``en``, all of them: the surface rules that stand
in for a parser are English by design.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import classify, lemmas, normalize
from ..functions.schemas import INSTANCES
from ..operators import acceptance, batches, compare, filters, metrics, statistics, surface, tree
from ..sources import files, sinks, storage
from . import experiments, fixtures

#: Replicates of the permutation queries.
ITERATIONS = 1000
_KEPT: list[DataFrame] = []
Query = Callable[[SparkSession, str], DataFrame]


def r6(c: str | Column) -> Column:
    """Six decimals; never minus zero."""
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals; infinities are null."""
    return df.select(*(F.when(F.abs(c) != float("inf"), r6(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def kept(df: DataFrame) -> DataFrame:
    """df in memory, then on disk, until the next registered query begins."""
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def settled(df: DataFrame) -> DataFrame:
    """df kept and worked out now, so that a plan over it knows its size and nothing is worked out twice at once."""
    kept(df).count()
    return df


def releasing(query: Query) -> Query:
    """The query, which first lets go of what earlier ones kept (their results can still be read: they are worked out anew)."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        while _KEPT:
            old = _KEPT.pop()
            if old.sparkSession.sparkContext._jsc is not None:
                old.unpersist()
        return query(spark, sf_dir)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.constructions(table(spark, sf_dir, "documents"))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept as several aggregates of one plan read it; texts are thus read once."""
    return kept(filters.valid(raw(spark, sf_dir)).select("row_id", "doc_id", "surface", "tam", "comp", "subjtype", "pattern", "head_lemma", "subject_text", "aux_chain", "following_word"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.with_instance_metrics(valid(spark, sf_dir), keep=settled)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of scored rows that filters and acceptance need: a small table, from which all settings are tried."""
    return settled(experiments.cells(scored(spark, sf_dir)))


def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass the instance filters; kept, as experiments read them again and again."""
    return kept(filters.formulaic(scored(spark, sf_dir)))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(acceptance.accept(metrics.pattern_metrics(survivors(spark, sf_dir), keep=settled)))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in the shape of constructions: return flag, part type, brand and supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_suppkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    return lines.join(part, "l_partkey").select(classify.pattern(F.col("l_returnflag"), F.col("p_type")).alias("pattern"), F.col("p_brand").alias("head_lemma"), F.col("l_suppkey").cast("string").alias("doc_id"))


def part_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pattern_metrics(parts(spark, sf_dir))


def flagship_patterns(spark, sf_dir):
    return rounded(patterns(spark, sf_dir).drop("npmi_pass", "h_slot_pass"))


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "surface", "tam", "comp", "subjtype", "pattern", "head_lemma", "subject_text", F.array_join("aux_chain", " ").alias("chain"), "following_word")


def surface_constructions(spark, sf_dir):
    return shown(raw(spark, sf_dir))


def tree_complements(spark, sf_dir):
    c = F.col("complements")
    named = F.filter(F.map_entries(c), lambda e: e["key"].startswith("pp_"))
    pps = F.array_join(F.array_sort(F.transform(named, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    return tree.constructions(*fixtures.trees(spark)).select("doc_id", "sent_idx", "head_lemma", c["by"].alias("by_text"), c["prep_head"].alias("prep_head"), c["to_vp"].alias("vp_text"), pps.alias("pps"))


def passive_sentences(spark, sf_dir):
    tokens = fixtures.trees(spark)[0]
    return tree.sentences(tokens).join(filters.passive(tokens).groupBy(*tree.SENTENCE).agg(F.count("*").alias("n_tags")), tree.SENTENCE)


def instance_metrics(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("row_id", "instance_atp", "instance_dpb", "instance_hr"))


def layer1_filter(spark, sf_dir):
    return rounded(filters.formulaic(scored(spark, sf_dir)).select("row_id", "pattern", "head_lemma", "instance_atp", "instance_dpb", "instance_hr"))


def contingency(spark, sf_dir):
    """Event type against odd and even users."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("user_id") % 2 == 0).alias("even"), F.count_if(F.col("user_id") % 2 != 0).alias("odd"))
    total = [e.agg(F.sum(c)).scalar() for c in ("even", "odd")]
    g = metrics.g_squared_contingency(F.col("even"), F.col("odd"), total[0] - F.col("even"), total[1] - F.col("odd"))
    return rounded(e.select("event_type", "even", "odd", g.alias("g")).select("event_type", "even", "odd", "g.g_squared", "g.p_value"))


def members(spark, sf_dir):
    return kept(experiments.layer_members(cells(spark, sf_dir)))


def tam_results(spark, sf_dir):
    return experiments.shuffle_results(survivors(spark, sf_dir), "tam", ITERATIONS)


def comp_results(spark, sf_dir):
    return experiments.shuffle_results(survivors(spark, sf_dir), "comp", ITERATIONS)


def grid(spark, sf_dir):
    return kept(experiments.sensitivity(cells(spark, sf_dir)))


def stability(spark, sf_dir):
    rows = cells(spark, sf_dir)
    return experiments.pattern_stability(kept(experiments.sensitivity(rows)), experiments.accepted_patterns(rows).where("accepted"))


def multi_schema_verbs(spark, sf_dir):
    rows = cells(spark, sf_dir)
    mine = experiments.accepted_patterns(rows).where("accepted").select("pattern")
    return filters.multi_schema_verbs(filters.formulaic(rows).join(mine, "pattern", "left_semi"))


def examples(spark, sf_dir):
    rows = survivors(spark, sf_dir)
    return experiments.examples(rows, experiments.accepted_patterns(settled(experiments.cells(rows))).where("accepted"))


def _fixture(name: str, *cols: Callable[[], Column]) -> Query:
    """``cols`` are made when the query runs, as columns need a session."""
    return lambda spark, sf_dir: fixtures.table(spark, name).select("id", *(c() for c in cols))


_words = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
_set = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def profile(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "value", "event_type")
    return rounded(compare.profile(e, ["user_id", "value", "event_type"]))


def cascade(spark, sf_dir):
    rows = scored(spark, sf_dir)
    found = experiments.accepted_patterns(settled(experiments.cells(rows)))
    return experiments.cascade(raw(spark, sf_dir), rows, filters.formulaic(rows), found)


# what is written is read again


def corpus_csv(spark, sf_dir):
    path = storage.scratch(spark, "corpus")
    sinks.write_corpus(table(spark, sf_dir, "documents").where("text is not null"), path, "file_name", "text_field")
    return files.read_corpus(spark, path, "file_name", "text_field").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"))


def asc_folder(spark, sf_dir):
    """Annotated files as files in a folder, next to others."""
    path = storage.scratch(spark, "asc")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, text in [*((f"{d}{files.ASC_SUFFIX}", t) for d, t in fixtures.TABLES["asc_files"][1]), ("other.txt", "1\tq\tq\tPASSIVE")]:
        out = fs.create(hadoop.Path(f"{path}/{name}"))
        out.write(bytearray(text.encode()))
        out.close()
    given = files.read_asc_files(spark, path)
    failed = files.failed_files(given).withColumn("failed", F.lit(True))
    counted = files.asc_tokens(given).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.max("sent_idx").alias("n_sentences"))
    return given.select("doc_id").join(failed, "doc_id", "left").join(counted, "doc_id", "left").select("doc_id", F.coalesce("failed", F.lit(False)).alias("failed"), "n_tokens", "n_sentences")


def instances_csv(spark, sf_dir):
    path = storage.scratch(spark, "instances")
    sinks.write_instances(scored(spark, sf_dir), path)
    sinks.write_instances(spark.createDataFrame([], INSTANCES), f"{path}-none")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}-none")
    empty = not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return rounded(files.read_instances(spark, path)).withColumn("nothing_for_empty", F.lit(empty))


def instances_csv_missing(spark, sf_dir):
    """The two readings of a missing boundary entropy."""
    path = storage.scratch(spark, "instances")
    given = fixtures.table(spark, "instance_cases")
    sinks.write_constructions(given, path)
    a, b = (files.read_instances(spark, path, x).select(F.col("doc_id"), "instance_atp", "instance_dpb", F.col("instance_hr").alias(n)) for n, x in (("hr", float("inf")), ("hr_999", 999.0)))
    return a.select("doc_id", "instance_atp", "instance_dpb", (F.col("hr") == float("inf")).alias("hr_is_inf")).join(b.select("doc_id", "hr_999"), "doc_id").withColumn("hr_999", F.when(F.col("hr_999") != float("inf"), F.col("hr_999")))


def patterns_csv(spark, sf_dir):
    """The file's rows in its order: the most frequent first, ties by name."""
    path = storage.scratch(spark, "patterns")
    sinks.write_patterns(part_patterns(spark, sf_dir), path)
    place = F.row_number().over(Window.orderBy("_file", "_row"))  # a row a pattern
    back = files.read_patterns(spark, path).select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    return rounded(back.withColumn("place", place).drop("_file", "_row"))


def inventory_csv(spark, sf_dir):
    path = storage.scratch(spark, "inventory")
    sinks.write_inventory(patterns(spark, sf_dir), path)
    read = lambda part: spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/{part}")
    numbers = [r6(F.col(c).cast("double")).alias(c) for c in ("npmi", "h_slot", "g_squared", "atp", "delta_p")]
    cols = lambda name: [F.col(name).alias("schema"), F.col("n").cast("long").alias("n"), F.col("n_docs").cast("long").alias("n_docs"), *numbers, F.coalesce("lane", F.lit("")).alias("lane")]
    all_ = read("patterns").select(F.lit("patterns").alias("file"), *cols("pattern"), F.col("accepted").cast("boolean").alias("accepted"))
    return all_.union(read("schemas").select(F.lit("schemas"), *cols("schema"), F.lit(None).cast("boolean")))


def results_json(spark, sf_dir):
    path = storage.scratch(spark, "json")
    sinks.write_json({"patterns": part_patterns(spark, sf_dir).select("pattern", "n_tokens", "npmi"), "docs": table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"))}, path)
    a = spark.read.schema("pattern string, n_tokens long, npmi double").json(f"{path}/patterns").select(F.lit("patterns").alias("part"), F.col("pattern").alias("name"), F.col("n_tokens").alias("n"), r6("npmi").alias("x"))
    return a.union(spark.read.schema("quality string, n long").json(f"{path}/docs").select(F.lit("docs"), "quality", "n", F.lit(None).cast("double")))


def venn_json(spark, sf_dir):
    path = storage.scratch(spark, "venn")
    sinks.write_venn(experiments.venn(members(spark, sf_dir)), path)
    return spark.read.schema("part string, n long, patterns array<string>").json(path).select("part", "n", F.array_join("patterns", "|").alias("patterns"))


def list_file(spark, sf_dir):
    path = storage.scratch(spark, "list")
    given = table(spark, sf_dir, "labels").select(F.concat(F.lit("  "), F.col("doc_id").cast("string"), F.lit(" ")).alias("value"))
    given.union(spark.createDataFrame([("",), ("   ",), ("absent",)], "value string")).write.text(path)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return files.listed_documents(files.read_list(spark, path), docs).select("doc_id", "found", F.length("text").cast("long").alias("n_chars"))


def summary_profile(spark, sf_dir):
    out = compare.summary(fixtures.table(spark, "tagger_summary"), ["clauseCount", "clauseCountNoBe", "ascMATTR11", "PASSIVE_Prop"], "filename")
    stat = F.transform("stats", lambda x: F.concat_ws(" ", x["metric"], x["n"].cast("string"), F.format_number(x["least"], 4), F.format_number(x["largest"], 4), F.format_number(x["mean"], 4)))
    return out.select(F.array_join("columns", "|").alias("columns"), "num_columns", "num_rows", F.array_join("passive_columns", "|").alias("passive_columns"), F.array_join(stat, "; ").alias("stats"), F.array_join(F.transform("sample_rows", lambda r: F.get_json_object(r, "$.filename")), "|").alias("sample_rows"))


QUERIES: dict[str, Query] = {
    "flagship_patterns": flagship_patterns,
    # extraction and filters
    "surface_constructions": surface_constructions,
    "surface_chains": lambda s, d: shown(surface.constructions(fixtures.table(s, "surface_texts"))),
    "tam_first_examples": lambda s, d: filters.first_examples(raw(s, d), "tam", F.struct(F.col("doc_id").cast("long"), "sent_idx", "pos")).select("tam", "n", "row_id", "surface"),
    "filter_reasons": lambda s, d: filters.reason_counts(raw(s, d)),
    "invalid_tam": lambda s, d: filters.invalid_tam_counts(raw(s, d)),
    "filter_marginals": lambda s, d: filters.marginals(filters.valid(raw(s, d))),
    "tam_distribution": lambda s, d: raw(s, d).groupBy("tam").agg(F.count("*").alias("n")),
    # statistics and instance metrics
    "unigram_counts": lambda s, d: statistics.counts(valid(s, d)).unigrams,
    "bigram_counts": lambda s, d: statistics.counts(valid(s, d)).bigrams,
    "follower_counts": lambda s, d: statistics.counts(valid(s, d)).followers,
    "boundary_entropy": lambda s, d: rounded(statistics.boundary_entropy(statistics.counts(valid(s, d)))),
    "instance_metrics": instance_metrics,
    "layer1_filter": layer1_filter,
    "layer1_attribution": lambda s, d: filters.layer1_counts(scored(s, d)),
    # pattern metrics
    "schema_atp_dp": lambda s, d: rounded(metrics.summary(scored(s, d)).select("pattern", "n_tokens", "n_docs", "atp", "delta_p", "dispersion")),
    "slot_entropy": lambda s, d: rounded(metrics.slot_entropy(valid(s, d))),
    "npmi_tpch": lambda s, d: rounded(part_patterns(s, d).select("pattern", "n_tokens", "npmi")),
    "slot_entropy_tpch": lambda s, d: rounded(metrics.slot_entropy(parts(s, d))),
    "dispersion_tpch": lambda s, d: rounded(metrics.summary(parts(s, d)).select("pattern", "n_docs", "dispersion")),
    "g2_tpch": lambda s, d: rounded(part_patterns(s, d).select("pattern", "g_squared", "p_value")),
    "fdr_tpch": lambda s, d: rounded(part_patterns(s, d).select("pattern", "p_value", "p_value_fdr")),
    "dual_lane_tpch": lambda s, d: acceptance.accept(part_patterns(s, d)).select("pattern", "npmi_pass", "h_slot_pass", "accepted", "lane"),
    "dual_lane_discovery": lambda s, d: acceptance.accept(part_patterns(s, d), "discovery").where("accepted").select("pattern", "lane"),
    "dual_lane_stats": lambda s, d: acceptance.lane_statistics(part_patterns(s, d)),
    "g2_contingency": contingency,
    # ablations and sets
    "freq_only": lambda s, d: filters.frequent_patterns(scored(s, d)),
    "accepted_venn": lambda s, d: experiments.venn(members(s, d)),
    "layer_ablation": lambda s, d: experiments.layer_ablation(members(s, d)),
    "layer1_ablation": lambda s, d: experiments.layer1_ablation(members(s, d)),
    "filter_ablation": lambda s, d: experiments.filter_ablation(cells(s, d), settled),
    "lane_ablation": lambda s, d: experiments.lane_ablation(settled(experiments.accepted_patterns(cells(s, d)))),
    # permutations
    "tam_shuffle": lambda s, d: rounded(tam_results(s, d)),
    "comp_shuffle": lambda s, d: rounded(comp_results(s, d)),
    "verb_shuffle": lambda s, d: rounded(experiments.shuffle_results(survivors(s, d), "head_lemma", ITERATIONS)),
    "perm_summary": lambda s, d: rounded(experiments.replicate_summary(comp_results(s, d))),
    "perm_histogram": lambda s, d: rounded(compare.histogram(comp_results(s, d), "n_accepted")),
    # sensitivity
    "sensitivity_grid": lambda s, d: experiments.sensitivity_counts(grid(s, d)),
    "stable_schemas": lambda s, d: experiments.stable_patterns(grid(s, d)),
    "schema_stability": stability,
    "globally_stable": lambda s, d: experiments.globally_stable(grid(s, d)),
    # examples
    "examples_topk": lambda s, d: rounded(examples(s, d)),
    "example_semantics": lambda s, d: rounded(experiments.example_semantics(examples(s, d))),
    "multi_schema_verbs": multi_schema_verbs,
    "spatial_schemas": lambda s, d: valid(s, d).groupBy("pattern").agg(F.count("*").alias("n")).withColumn("is_spatial", filters.spatial(F.col("pattern"))),
    # classification and cleaning
    "tam_classifier": _fixture("tam_cases", lambda: classify.tam(_words("surface"), _words("lemmas"), F.col("modal")).alias("tam"), lambda: classify.has_modal(_words("lemmas")).alias("has_modal")),
    "comp_classifier": _fixture("comp_cases", lambda: classify.complement(_set("keys"), F.col("prep_head")).alias("comp")),
    "subj_classifier": _fixture("subject_cases", lambda: classify.subject_of_text(F.col("subject_text")).alias("subjtype")),
    "enum_validate": _fixture("enum_cases", lambda: classify.valid_tam(F.col("tam")).alias("tam_ok"), lambda: classify.valid_subject(F.col("subjtype")).alias("subj_ok"), lambda: classify.valid_complement(F.col("comp")).alias("comp_ok")),
    "extraposed": lambda s, d: fixtures.table(s, "filter_cases").select("id", filters.extraposed(F.col("subjtype"), F.col("subject_text"), F.col("surface")).alias("extraposed"), filters.reject_reason().alias("reason")),
    "prep_normalize": _fixture("prep_cases", lambda: normalize.preposition(F.col("prep")).alias("prep")),
    "pattern_normalize": lambda s, d: batches.judged_complements(fixtures.table(s, "pattern_cases")).select("id", F.col("_comp").alias("comp"), F.col("_pattern").alias("pattern"), "outcome", "correction"),
    "normalize_counts": lambda s, d: batches.normalization_counts(fixtures.table(s, "pattern_cases")),
    "pattern_merge": lambda s, d: batches.merged_patterns(fixtures.table(s, "merge_cases"), "ord")[0],
    "pattern_merge_log": lambda s, d: batches.merged_patterns(fixtures.table(s, "merge_cases"), "ord")[1],
    "lemma_validate": lambda s, d: fixtures.table(s, "lemma_cases").withColumn("v", lemmas.validated(F.col("lemma"))).select("id", F.col("v.lemma").alias("lemma"), F.col("v.status").alias("status")),
    "lemma_counts": lambda s, d: batches.lemma_counts(valid(s, d)),
    "jaccard_sets": _fixture("set_cases", lambda: r6(compare.jaccard_of_arrays(_set("a"), _set("b"))).alias("jaccard")),
    # files and trees
    "asc_parse": lambda s, d: files.asc_tokens(fixtures.table(s, "asc_files")),
    "asc_profile": lambda s, d: files.asc_profile(fixtures.table(s, "asc_files")),
    "asc_totals": lambda s, d: files.asc_totals(fixtures.table(s, "asc_files")),
    "tree_constructions": lambda s, d: tree.constructions(*fixtures.trees(s)).select("doc_id", "sent_idx", "surface", "tam", "comp", "subjtype", "pattern", "head_lemma", "subject_text", F.array_join("aux_chain", " ").alias("chain"), "following_word"),
    "tree_complements": tree_complements,
    "passive_sentences": passive_sentences,
    "filtering_cascade": cascade,
    "schema_inventory": lambda s, d: sinks.schema_inventory(patterns(s, d)),
    "exact_p_tpch": lambda s, d: rounded(part_patterns(s, d).select("pattern", metrics.exact_p_value(F.col("g_squared")).alias("exact_p"))),
    # readers and writers
    "corpus_csv": corpus_csv,
    "asc_folder": asc_folder,
    "instances_csv": instances_csv,
    "instances_csv_missing": instances_csv_missing,
    "patterns_csv": patterns_csv,
    "pattern_names": lambda s, d: files.pattern_names(part_patterns(s, d)),
    "inventory_csv": inventory_csv,
    "results_json": results_json,
    "venn_json": venn_json,
    "list_file": list_file,
    "summary_profile": summary_profile,
    "resume_anti_join": lambda s, d: files.missing_documents(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels")),
    "listed_documents": lambda s, d: files.listed_documents(table(s, d, "labels"), table(s, d, "documents")).select("doc_id", "found", F.length("text").cast("long").alias("n_chars")),
    "metric_profile": profile,
}
QUERIES = {name: releasing(query) for name, query in QUERIES.items()}
