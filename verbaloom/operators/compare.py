"""Comparisons of pattern sets and of replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaccard(both: Column, left: Column, right: Column) -> Column:
    """Of set sizes: shared, left, right. Two empty sets are equal."""
    return F.when((left == 0) & (right == 0), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both.cast("double"), left + right - both), F.lit(0.0)))


def jaccard_of_arrays(a: Column, b: Column) -> Column:
    return jaccard(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))


def membership(a: DataFrame, b: DataFrame, on: str = "pattern", names: tuple[str, str] = ("left_only", "right_only")) -> DataFrame:
    """(on, part): where each member of two sets is: in one alone, or in ``both``."""
    left, right = (x.select(on).distinct().withColumn(c, F.lit(1)) for x, c in ((a, "_a"), (b, "_b")))
    return left.join(right, on, "full").select(on, F.when(F.col("_a").isNull(), names[1]).when(F.col("_b").isNull(), names[0]).otherwise("both").alias("part"))


def spread(column: str, prefix: str) -> list[Column]:
    """Mean, population deviation, least, largest and interpolated median."""
    x = F.col(column)
    return [F.avg(x).alias(f"mean_{prefix}"), F.stddev_pop(x).alias(f"std_{prefix}"), F.min(x).alias(f"min_{prefix}"), F.max(x).alias(f"max_{prefix}"), F.percentile(x, F.lit(0.5)).alias(f"median_{prefix}")]


def histogram(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin from 1, low, high, n) of equal bins from least to largest, the last one closed; empty bins too.

    Without a spread there is one point: the bins then cover half on either side of it. Nulls count nowhere.
    """
    x = F.col(column).cast("double")
    ends = values.agg(F.min(x).alias("a"), F.max(x).alias("b")).where("a is not null")
    ends = ends.select(F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("a") - 0.5).alias("a"), F.when(F.col("a") < F.col("b"), F.col("b")).otherwise(F.col("b") + 0.5).alias("b"))
    low, high = ends.select("a").scalar(), ends.select("b").scalar()
    mine = values.where(x.isNotNull()).select(F.least(F.width_bucket(x, low, high, F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    step = (F.col("b") - F.col("a")) / bins
    all_ = ends.select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).select("bin", (F.col("a") + (F.col("bin") - 1) * step).alias("low"), (F.col("a") + F.col("bin") * step).alias("high"))
    return all_.join(mine, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def profile(table: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, n, least, largest, mean) of columns that may hold text; what is no number is left out."""
    long = table.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).try_cast("double").alias("x")) for c in columns))).alias("m")).select("m.*")
    return long.where("x is not null").groupBy("metric").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("largest"), F.avg("x").alias("mean"))


def summary(table: DataFrame, metrics: list[str], key: str, rows: int = 3) -> DataFrame:
    """One row about a table of a tagger: columns, num_columns, num_rows, passive_columns, stats and sample_rows.

    stats has (metric, n, least, largest, mean) for each of ``metrics`` that is a column and has numbers; sample_rows the
    first ``rows`` rows by ``key``, as JSON. Names come from the schema; the samples are a limit, not a sort of all rows.
    """
    names = lambda cs: F.array(*map(F.lit, cs)).cast("array<string>")
    found = profile(table, [m for m in metrics if m in table.columns]).agg(F.array_sort(F.collect_list(F.struct("metric", "n", "least", "largest", "mean"))).alias("stats"))
    first = table.orderBy(key).limit(rows).select(F.struct(F.col(key).alias("k"), F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}).alias("row")).alias("r")).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]).alias("sample_rows"))
    # three tables of one row each
    counted = table.agg(F.count("*").alias("num_rows"))
    return counted.select(names(table.columns).alias("columns"), F.lit(len(table.columns)).alias("num_columns"), "num_rows", names([c for c in table.columns if "PASSIVE" in c.upper()]).alias("passive_columns")).join(found).join(first)
