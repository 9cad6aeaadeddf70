"""Metrics of patterns, all from two grouped aggregates of the rows (by document and by head lemma).

Every function takes ``by``: columns that keep several data sets apart (iterations, settings of a grid), so that an
experiment is one plan over all of its runs. Pattern tables are as large as tense-aspect-modality times complement
types; only they are windowed over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keep = Callable[[DataFrame], DataFrame]
NAMES = ["pattern", "n_tokens", "n_docs", "atp", "delta_p", "h_slot", "npmi", "dispersion", "g_squared", "p_value", "p_value_fdr"]


def g_squared(observed: Column, n: Column, k: Column) -> Column:
    """Log-likelihood of a pattern against an even share of n rows among k patterns; 0 where that says nothing."""
    o, total = observed.cast("double"), n.cast("double")
    expected = total / k
    rest = total - o
    part = F.when(rest > 0, rest * F.ln(F.try_divide(rest, total - expected))).otherwise(F.lit(0.0))
    return F.when((k <= 1) | (o <= 0), F.lit(0.0)).otherwise(2 * (o * F.ln(F.try_divide(o, expected)) + part))


def p_value(g2: Column) -> Column:
    return F.when(g2 > 0, F.exp(-g2 / 2)).otherwise(F.lit(1.0))


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of non-negative numbers: a series of positive terms below 2.5, Lentz's continued fraction from there."""
    low = np.minimum(x, 2.5)
    term = total = low.copy()
    for n in range(1, 60):
        term = term * 2 * low * low / (2 * n + 1)
        total = total + term
    high = np.maximum(x, 2.5)
    tail = high.copy()
    for n in range(80, 0, -1):
        tail = high + n / 2 / tail
    return np.where(x < 2.5, 1 - 2 / np.sqrt(np.pi) * np.exp(-low * low) * total, np.exp(-high * high) / np.sqrt(np.pi) / tail)


def exact_p_value(g2: Column) -> Column:
    """Tail of chi-square with one degree of freedom, in whole Arrow batches as Spark has no error function; a null stays null."""

    # here, as the module must import where pandas cannot
    import pandas as pd

    def tail(x):
        v = x.to_numpy(dtype=float, na_value=np.nan)
        return pd.Series(np.where(np.isnan(v), np.nan, erfc(np.sqrt(np.maximum(v, 0) / 2)))).where(x.notna().to_numpy())

    # hints that are written in the function would be looked up among the module's names
    tail.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.when(g2.isNotNull(), F.pandas_udf(tail, "double")(g2))


def g_squared_contingency(o11: Column, o12: Column, o21: Column, o22: Column) -> Column:
    """struct<g_squared, p_value> of a table of two rows and two columns; (0, 1) for an empty one."""
    cells = [[x.cast("double") for x in row] for row in ((o11, o12), (o21, o22))]
    n = cells[0][0] + cells[0][1] + cells[1][0] + cells[1][1]
    total = F.lit(0.0)
    for i in (0, 1):
        for j in (0, 1):
            o, e = cells[i][j], F.try_divide((cells[i][0] + cells[i][1]) * (cells[0][j] + cells[1][j]), n)
            total = total + F.when((o > 0) & (e > 0), o * F.ln(F.try_divide(o, e))).otherwise(F.lit(0.0))
    g2 = 2 * total
    return F.struct(g2.alias("g_squared"), p_value(g2).alias("p_value"))


def npmi(n: Column, n_tam: Column, n_comp: Column, total: Column) -> Column:
    """Normalised pointwise mutual information; 0 where all rows are of one pattern."""
    p = n / total.cast("double")
    return F.when(p < 1, F.try_divide(F.log2(p / ((n_tam / total.cast("double")) * (n_comp / total.cast("double")))), -F.log2(p))).otherwise(F.lit(0.0))


def with_fdr(patterns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds p_value_fdr, Benjamini and Hochberg's adjustment of p_value."""
    w = Window.partitionBy(*by)
    rank, n = F.row_number().over(w.orderBy("p_value", "pattern")), F.count("*").over(w)
    ranked = patterns.withColumn("_raw", F.col("p_value") * n / rank).withColumn("_rank", rank)
    best = F.min("_raw").over(w.orderBy("_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return ranked.withColumn("p_value_fdr", F.least(F.lit(1.0), best)).drop("_raw", "_rank")


def _usable(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    value = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in rows.columns else F.lit(other)
    return rows.select(
        *by, F.coalesce("pattern", F.lit("")).alias("pattern"), value("doc_id", "unknown").cast("string").alias("doc_id"), value("head_lemma", "unknown").alias("head_lemma"),
        value("instance_atp", 0.0).alias("instance_atp"), value("instance_dpb", 0.0).alias("instance_dpb"),
    )


def slot_entropy(rows: DataFrame, by: Sequence[str] = (), keep: Keep = lambda df: df) -> DataFrame:
    """(by, pattern, h_slot): entropy of a pattern's head lemmas (null: ``unknown``). ``keep`` may store their counts."""
    counted = keep(_usable(rows, by).groupBy(*by, "pattern", "head_lemma").agg(F.count("*").cast("double").alias("c")))
    key = [*by, "pattern"]
    totals = counted.groupBy(*key).agg(F.sum("c").alias("n"))
    q = F.col("c") / F.col("n")
    return counted.join(totals, key).groupBy(*key).agg(F.sum(-q * F.log2(q)).alias("h_slot"))


def by_document(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _usable(rows, by).groupBy(*by, "pattern", "doc_id").agg(F.count("*").alias("n"), F.sum("instance_atp").alias("atp"), F.sum("instance_dpb").alias("dpb"))


def summary(rows: DataFrame, by: Sequence[str] = (), keep: Keep = lambda df: df) -> DataFrame:
    """(by, pattern, n_tokens, n_docs, atp, delta_p, dispersion). ``keep`` may store the sums by document and by pattern.

    A document without a pattern adds its own share to the pattern's dispersion, so only documents with it are read:
    half of (the sum of their differences, plus one, less the sum of their shares).
    """
    key = [*by, "pattern"]
    docs = keep(by_document(rows, by))
    patterns = keep(docs.groupBy(*key).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_docs"), F.sum("atp").alias("atp"), F.sum("dpb").alias("dpb")))
    total = patterns.withColumn("total", F.sum("n_tokens").over(Window.partitionBy(*by)))
    sizes = docs.groupBy(*by, "doc_id").agg(F.sum("n").alias("doc_n"))
    share = F.col("doc_n") / F.col("total").cast("double")
    parts = docs.select(*key, "doc_id", "n").join(sizes, [*by, "doc_id"]).join(F.broadcast(total.select(*key, "n_tokens", "total")), key)
    spread = parts.groupBy(*key).agg((0.5 * (F.sum(F.abs(F.col("n") / F.col("n_tokens").cast("double") - share)) + 1 - F.sum(share))).alias("dispersion"))
    return patterns.join(spread, key).select(*key, "n_tokens", "n_docs", (F.col("atp") / F.col("n_tokens")).alias("atp"), (F.col("dpb") / F.col("n_tokens")).alias("delta_p"), "dispersion")


def association(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds npmi, g_squared and p_value to (by, pattern, n_tokens). Rows without a pattern count in totals alone."""
    part = F.split("pattern", ",")
    w = Window.partitionBy(*by)
    known = counted.withColumns({"tam": F.get(part, F.lit(0)), "comp": F.get(part, F.lit(1)), "_n": F.sum("n_tokens").over(w), "_k": F.count("*").over(w)})
    known = known.withColumns({"_t": F.sum("n_tokens").over(Window.partitionBy(*by, "tam")), "_c": F.sum("n_tokens").over(Window.partitionBy(*by, "comp"))})
    known = known.where("pattern <> ''")
    value = F.when(F.col("comp").isNull(), F.lit(0.0)).otherwise(npmi(F.col("n_tokens"), F.col("_t"), F.col("_c"), F.col("_n")))
    return known.withColumns({"npmi": value, "g_squared": g_squared(F.col("n_tokens"), F.col("_n"), F.col("_k"))}).withColumn("p_value", p_value(F.col("g_squared"))).drop("tam", "comp", "_n", "_k", "_t", "_c")


def lane_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, pattern, n_tokens, h_slot, npmi, g_squared, p_value): what acceptance needs, and no more.

    One aggregate by head lemma gives both a pattern's size n and its entropy, log2(n) less the mean of log2 of the
    lemma counts; so rows are shuffled once, after they were counted in their task.
    """
    key = [*by, "pattern"]
    counted = rows.groupBy(*by, F.coalesce("pattern", F.lit("")).alias("pattern"), F.coalesce("head_lemma", F.lit("unknown")).alias("head_lemma")).agg(F.count("*").alias("c"))
    sums = counted.groupBy(*key).agg(F.sum("c").alias("n_tokens"), F.sum(F.col("c") * F.log2("c")).alias("_s"))
    return association(sums.withColumn("h_slot", F.log2("n_tokens") - F.col("_s") / F.col("n_tokens")).drop("_s"), by)


def lane_metrics_of_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """lane_metrics of rows that were counted: (by, pattern, head_lemma, _n, ...). The entropy is summed as in slot_entropy."""
    key = [*by, "pattern"]
    counted = cells.groupBy(*by, F.coalesce("pattern", F.lit("")).alias("pattern"), F.coalesce("head_lemma", F.lit("unknown")).alias("head_lemma")).agg(F.sum("_n").alias("c"))
    q = F.col("c") / F.sum("c").over(Window.partitionBy(*key))
    shares = counted.withColumn("_q", q)
    return association(shares.groupBy(*key).agg(F.sum("c").alias("n_tokens"), F.sum(-F.col("_q") * F.log2("_q")).alias("h_slot")), by)


def pattern_metrics(rows: DataFrame, by: Sequence[str] = (), keep: Keep = lambda df: df) -> DataFrame:
    """All metrics of all patterns (NAMES, after ``by``) of constructions (pattern; doc_id, head_lemma, instance_atp and instance_dpb if there are any).

    Missing documents and lemmas are ``unknown``, missing instance metrics 0; rows without a pattern (null or empty) count in
    totals alone. Empty tables give no rows; other columns
    are ignored. ``keep`` may store the sums that several metrics are made of.
    """
    key = [*by, "pattern"]
    known = association(summary(rows, by, keep), by)
    return with_fdr(known.join(slot_entropy(rows, by, keep), key), by).select(*by, *NAMES)
