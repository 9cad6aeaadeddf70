"""Normalisation of whole tables of constructions and of pattern metrics, with counts of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lemmas, normalize


def judged_complements(rows: DataFrame) -> DataFrame:
    """The rows with _comp and _pattern (normalised; null if either is filtered), outcome and correction.

    outcome: filtered, normalized (the preposition changed), unchanged (any other row that stays).
    """
    bare = lambda c: F.when(c.endswith("_NP"), F.substring(c, F.lit(4), F.length(c) - 6)).otherwise(F.substring(c, F.lit(4), F.length(c)))
    out = rows.withColumns({"_comp": normalize.complement(F.col("comp")), "_pattern": normalize.pattern(F.col("pattern"))})
    gone = F.col("_comp").isNull() | F.col("_pattern").isNull()
    changed = (F.col("_comp") != F.col("comp")) & F.col("comp").startswith("pp_") & F.col("_comp").startswith("pp_")
    out = out.withColumn("correction", F.when(~gone & changed, F.concat(bare(F.col("comp")), F.lit(" → "), bare(F.col("_comp")))))
    return out.withColumn("outcome", F.when(gone, "filtered").when(F.col("correction").isNotNull(), "normalized").otherwise("unchanged"))


def normalized(rows: DataFrame) -> DataFrame:
    """The rows that stay, with comp and pattern normalised, _normalized (true where either changed) and _correction."""
    out = judged_complements(rows).where("outcome <> 'filtered'")
    changed = (F.col("_comp") != F.col("comp")) | (F.col("_pattern") != F.col("pattern"))
    new = {"comp": F.col("_comp"), "pattern": F.col("_pattern"), "_normalized": F.when(changed, F.lit(True)), "_correction": F.col("correction")}
    return out.withColumns(new).drop("_comp", "_pattern", "outcome", "correction")


def normalization_counts(rows: DataFrame) -> DataFrame:
    """(outcome, detail, n): detail is the correction of normalized rows, the pattern of filtered ones."""
    detail = F.when(F.col("outcome") == "filtered", F.col("pattern")).otherwise(F.col("correction"))
    return judged_complements(rows).groupBy("outcome", detail.alias("detail")).agg(F.count("*").alias("n"))


def merged_patterns(patterns: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Pattern metrics by normalised pattern, and the log of what happened to each pattern that changed.

    n_tokens add up, n_docs is the largest; other columns are those of the first pattern by ``order``.
    """
    known = patterns.withColumn("_norm", normalize.pattern(F.col("pattern")))
    rest = [c for c in patterns.columns if c not in ("pattern", "n_tokens", "n_docs", order)]
    kept = known.where("_norm is not null").groupBy("_norm").agg(
        F.sum("n_tokens").alias("n_tokens"), F.max("n_docs").alias("n_docs"), *(F.min_by(c, order).alias(c) for c in rest)
    ).withColumnRenamed("_norm", "pattern")
    place = F.row_number().over(Window.partitionBy("_norm").orderBy(order))
    what = F.when(F.col("_norm").isNull(), "FILTERED").when(F.col("_place") > 1, F.concat(F.lit("MERGED → "), "_norm")).when(F.col("_norm") != F.col("pattern"), F.concat(F.lit("RENAMED → "), "_norm"))
    log = known.withColumn("_place", place).select("pattern", what.alias("action")).where("action is not null")
    return kept, log


def judged_lemmas(rows: DataFrame, lemma_field: str = "head_lemma", strict: bool = True) -> DataFrame:
    """The rows with _lemma (null if filtered) and status; no shuffle, as a lemma is judged inside its row."""
    return rows.withColumn("_judged", lemmas.validated(F.col(lemma_field), strict)).withColumns({"_lemma": F.col("_judged.lemma"), "status": F.col("_judged.status")}).drop("_judged")


def validated(rows: DataFrame, lemma_field: str = "head_lemma", strict: bool = True) -> DataFrame:
    """The rows whose lemma is not filtered, with the lemma replaced."""
    return judged_lemmas(rows, lemma_field, strict).where("_lemma is not null").withColumn(lemma_field, F.col("_lemma")).drop("_lemma", "status")


def lemma_counts(rows: DataFrame, lemma_field: str = "head_lemma", strict: bool = True) -> DataFrame:
    """(status, n, n_lemmas): rows and distinct lemmas by status."""
    by_lemma = judged_lemmas(rows, lemma_field, strict).groupBy("status", lemma_field).agg(F.count("*").alias("n"))
    return by_lemma.groupBy("status").agg(F.sum("n").alias("n"), F.count("*").alias("n_lemmas"))


def lemma_corrections(rows: DataFrame, lemma_field: str = "head_lemma", strict: bool = True) -> DataFrame:
    """(lemma, corrected, status) of the distinct lemmas that changed or were filtered."""
    return judged_lemmas(rows, lemma_field, strict).where("status <> 'valid'").select(F.col(lemma_field).alias("lemma"), F.col("_lemma").alias("corrected"), "status").distinct()
