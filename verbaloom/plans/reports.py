"""Text reports of results that are small by nature (a row a pattern, reason, setting or statistic)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import acceptance, batches, filters
from ..sources.sinks import schema_inventory
from . import experiments

#: Rows of a section; what is longer ends in a line that says how many rows there are.
MOST = 200


def _cell(x: object) -> str:
    if x is None:
        return "-"
    return f"{x:,.4f}".rstrip("0").rstrip(".") if isinstance(x, float) else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


def render(title: str, sections: list[tuple[str, DataFrame]], most: int = MOST) -> str:
    """A Markdown text: a table a section, or a list where a section has one row."""
    out = [f"# {title}", ""]
    for heading, table in sections:
        rows = table.limit(most + 1).collect()
        out += [f"## {heading}", ""]
        if len(rows) == 1 and len(table.columns) > 3:
            out += [f"- {c}: {_cell(v)}" for c, v in rows[0].asDict().items()]
        else:
            out += ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
            out += ["| " + " | ".join(map(_cell, r)) + " |" for r in rows[:most]]
        if len(rows) > most:
            out.append(f"\n{table.count():,} rows in all")
        out.append("")
    return "\n".join(out)


def save(text: str, path: str | Path) -> None:
    Path(path).write_text(text, encoding="utf-8")


def shares(counted: DataFrame, n: str = "n") -> DataFrame:
    """Adds the share of each row in per cent, the largest first."""
    total = counted.agg(F.sum(n)).scalar()
    return counted.withColumn("percent", F.round(F.try_divide(F.col(n) * 100.0, total), 1)).orderBy(F.desc(n), *[c for c in counted.columns if c != n])


def filter_report(rows: DataFrame) -> str:
    kept = filters.marginals(filters.valid(rows))
    top = lambda k, n=1000: shares(kept.where(F.col("kind") == k).select("value", "n")).limit(n)
    return render("Filtering", [("Outcomes", shares(filters.reason_counts(rows))), ("Invalid TAM", shares(filters.invalid_tam_counts(rows))), ("TAM", top("tam")), ("Complements, first ten", top("comp", 10)), ("Subjects", top("subjtype"))])


def normalization_report(rows: DataFrame) -> str:
    counted = batches.normalization_counts(rows)
    each = lambda o: counted.where(F.col("outcome") == o).select("detail", "n").orderBy(F.desc("n"), "detail").limit(20)
    return render("Preposition normalisation", [("Outcomes", shares(counted.groupBy("outcome").agg(F.sum("n").alias("n")))), ("Corrections, first 20", each("normalized")), ("Filtered patterns, first 20", each("filtered"))])


def lemma_report(rows: DataFrame, lemma_field: str = "head_lemma") -> str:
    changes = batches.lemma_corrections(rows, lemma_field)
    return render("Verb lemmas", [("Outcomes", batches.lemma_counts(rows, lemma_field).orderBy("status")), ("Corrections", changes.where("status <> 'filtered'").orderBy("lemma")), ("Filtered lemmas, first 50", changes.where("status = 'filtered'").select("lemma").orderBy("lemma").limit(50))])


def lane_report(patterns: DataFrame, mode: str = "production") -> str:
    return render("Acceptance lanes", [("Counts", acceptance.lane_statistics(patterns, mode))])


def analysis_report(raw: DataFrame, scored: DataFrame, patterns: DataFrame, mode: str = "production") -> str:
    """Of a whole run: filtering, instance filters, acceptance, accepted patterns and verbs."""
    kept = filters.formulaic(scored)
    accepted = acceptance.accept(patterns, mode).where("accepted").orderBy(F.desc("n_tokens"), "pattern")
    verbs = kept.groupBy("head_lemma").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "head_lemma").limit(10)
    return render("Corpus analysis", [("Filtering", shares(filters.reason_counts(raw))), ("Instance filters", shares(filters.layer1_counts(scored))), ("Lanes", acceptance.lane_statistics(patterns, mode)), ("Accepted patterns", accepted.select("pattern", "n_tokens", "npmi", "h_slot", "g_squared", "lane")), ("Verbs, first ten", verbs)])


def permutation_report(results: DataFrame) -> str:
    from ..operators.compare import histogram

    return render("Permutation test", [("Summary", experiments.replicate_summary(results)), ("Accepted patterns by replicate, 20 bins", histogram(results, "n_accepted"))])


def sensitivity_report(accepted: DataFrame, observed: DataFrame) -> str:
    return render("Sensitivity", [("Accepted patterns", experiments.sensitivity_counts(accepted).orderBy("param", "value")), ("Stability", experiments.pattern_stability(accepted, observed).orderBy(F.desc("presence_count"), "pattern")), ("Stable under all parameters", experiments.globally_stable(accepted).orderBy("pattern"))])


def ablation_report(members: DataFrame) -> str:
    return render("Ablation", [("Configurations", members.groupBy("config").agg(F.count("*").alias("n")).orderBy("config")), ("Contributions", experiments.layer_ablation(members)), ("Instance filters", experiments.layer1_ablation(members)), ("With and without instance filters", experiments.venn(members).orderBy("part", "pattern"))])


def examples_report(rows: DataFrame, accepted: DataFrame) -> str:
    found = experiments.examples(rows, accepted)
    verbs = filters.multi_schema_verbs(found.withColumnRenamed("verb", "head_lemma")).orderBy(F.desc("n_patterns"), "verb")
    return render("Examples", [("Patterns", experiments.example_semantics(found).orderBy("pattern")), ("Examples", found.orderBy("pattern", "rank")), ("Verbs of several patterns", verbs), ("Spatial patterns", accepted.select("pattern").where(filters.spatial(F.col("pattern"))).orderBy("pattern"))])


def validation_report(results: DataFrame, rows: DataFrame, patterns: DataFrame) -> str:
    return render("Validation", [("Permutation", experiments.replicate_summary(results)), ("Instance filters", experiments.filter_ablation(rows)), ("Lanes", experiments.lane_ablation(patterns))])


def annotation_report(files: DataFrame) -> str:
    from ..sources.files import asc_profile, asc_totals

    totals = asc_totals(files)
    return render("Annotation", [("Totals", totals.agg(F.count("*").alias("files"), F.sum("total_sentences").alias("sentences"), F.sum("total_tokens").alias("tokens"), F.max("total_tokens").alias("longest"))), ("Tags", shares(asc_profile(files)))])


def summary_report(raw: DataFrame, kept: DataFrame, scored: DataFrame, patterns: DataFrame, tam: DataFrame, verb: DataFrame, accepted: DataFrame, members: DataFrame) -> str:
    """Of a whole validation run: thresholds, cascade, accepted patterns, permutations, stability, ablation.

    tam and verb are replicate results, accepted the patterns by setting of the grid, members those by configuration.
    """
    limits = scored.sparkSession.createDataFrame([(k, float(getattr(vocab, k))) for k in ("ATP", "DPB", "HR", "NPMI", "H_SLOT", "G2_NPMI", "G2_H_SLOT", "NPMI_FLOOR")], "threshold string, value double")
    observed = patterns.where("accepted")
    tests = [x.select(F.lit(n).alias("test"), "n_iterations", "mean_jaccard", "std_jaccard", "p_value_identity", "identity_test_valid") for n, x in (("TAM", experiments.replicate_summary(tam)), ("verb", experiments.replicate_summary(verb)))]
    return render("Summary", [
        ("Thresholds", limits), ("Filtering cascade", experiments.cascade(raw, kept, filters.formulaic(scored), patterns)), ("Accepted schemas", schema_inventory(patterns).orderBy(F.desc("n"), "schema")),
        ("Permutations", tests[0].union(tests[1])), ("Stability", experiments.pattern_stability(accepted, observed).orderBy("pattern")), ("Instance filters", experiments.layer1_ablation(members)),
    ])
