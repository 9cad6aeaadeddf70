"""Filters of constructions, each with the reason for which a row is charged. None of them shuffles but counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

REQUIRED = ["surface", "tam", "comp", "subjtype", "pattern", "head_lemma"]


def passive(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("asc_tag") == "PASSIVE")


def has_required_fields() -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in REQUIRED))


def extraposed(subjtype: Column, subject_text: Column, surface: Column) -> Column:
    """Is *it* the subject, and does a marker first occur beyond the verb? Nulls are not."""
    place = lambda m: F.locate(m, F.lower(surface)) - 1
    marked = reduce(lambda a, b: a | b, (place(m) > vocab.EXTRAPOSITION_BEYOND for m in vocab.EXTRAPOSITION_MARKERS))
    return F.coalesce((subjtype == "PRON") & (F.lower(F.trim(subject_text)) == "it") & marked, F.lit(False))


def reject_reason() -> Column:
    """The first reason that holds: missing_fields, invalid_tam, extraposed_it; null for a valid row."""
    return (
        F.when(~has_required_fields(), "missing_fields")
        .when(~F.col("tam").isin(*vocab.VALID_TAM), "invalid_tam")
        .when(extraposed(F.col("subjtype"), F.col("subject_text"), F.col("surface")), "extraposed_it")
    )


def valid(rows: DataFrame) -> DataFrame:
    return rows.where(reject_reason().isNull())


def reason_counts(rows: DataFrame) -> DataFrame:
    """(reason, n): rows by reason, ``valid`` for those kept."""
    return rows.groupBy(F.coalesce(reject_reason(), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def invalid_tam_counts(rows: DataFrame) -> DataFrame:
    return rows.where(reject_reason() == "invalid_tam").groupBy("tam").agg(F.count("*").alias("n"))


def marginals(rows: DataFrame, columns: tuple[str, ...] = ("tam", "comp", "subjtype")) -> DataFrame:
    """(kind, value, n): one pass over the rows for the counts of several columns."""
    sets = rows.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = reduce(lambda out, k: out.when(F.col("g") == (2 ** len(columns) - 1) - 2 ** (len(columns) - 1 - k), columns[k]), range(len(columns)), F.when(F.lit(False), ""))
    return sets.select(kind.alias("kind"), F.coalesce(*columns).alias("value"), "n")


def first_examples(rows: DataFrame, by: str, order: Column) -> DataFrame:
    """(by, n, and all other columns of the first row by ``order``) for each value of ``by``: one aggregate, nothing is sorted."""
    first = F.min_by(F.struct(*(c for c in rows.columns if c != by)), order)
    return rows.groupBy(by).agg(F.count("*").alias("n"), first.alias("_first")).select(by, "n", "_first.*")


def layer1_reason(atp: float | Column = vocab.ATP, dpb: float | Column = vocab.DPB, hr: float | Column = vocab.HR) -> Column:
    """The first of atp, dpb and hr that fails; missing values count as 0, 0 and infinite."""
    return (
        F.when(~(F.coalesce("instance_atp", F.lit(0.0)) >= atp), "atp")
        .when(~(F.coalesce("instance_dpb", F.lit(0.0)) >= dpb), "dpb")
        .when(~(F.coalesce("instance_hr", F.lit(float("inf"))) <= hr), "hr")
    )


def formulaic(rows: DataFrame, atp: float = vocab.ATP, dpb: float = vocab.DPB, hr: float = vocab.HR) -> DataFrame:
    return rows.where(layer1_reason(atp, dpb, hr).isNull())


def layer1_counts(rows: DataFrame) -> DataFrame:
    """(reason, n), ``formulaic`` for the rows kept."""
    return rows.groupBy(F.coalesce(layer1_reason(), F.lit("formulaic")).alias("reason")).agg(F.count("*").alias("n"))


def frequent_patterns(rows: DataFrame, least: int = 3) -> DataFrame:
    """(pattern, n): patterns of so many rows at least."""
    return rows.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def spatial(pattern: Column) -> Column:
    return pattern.rlike("_(" + "|".join(vocab.SPATIAL) + ")_")


def multi_schema_verbs(rows: DataFrame) -> DataFrame:
    """(verb, n_patterns, patterns): head lemmas of more than one pattern."""
    seen = rows.select(F.col("head_lemma").alias("verb"), "pattern").distinct()
    out = seen.groupBy("verb").agg(F.count("*").alias("n_patterns"), F.array_join(F.array_sort(F.collect_list("pattern")), "|").alias("patterns"))
    return out.where(F.col("n_patterns") > 1)


def passive_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if "PASSIVE" in c.upper()]
