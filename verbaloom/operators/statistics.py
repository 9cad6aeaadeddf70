"""Counts of words, word pairs and followers, and the metrics of single constructions.

All depend on the auxiliary chain (or the pattern) alone. So rows are counted by chain first, and metrics are worked
out once for each distinct chain: what is shuffled is as large as the number of chains, not of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import lowered


@dataclass
class Counts:
    unigrams: DataFrame  # word, n
    bigrams: DataFrame  # w1, w2, n
    followers: DataFrame  # pattern, word, n
    chains: DataFrame  # chain, n


def _chain() -> Column:
    return lowered(F.col("aux_chain"))


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("aux_chain") > 0)


def pairs(chain: Column) -> Column:
    """The adjacent pairs of a chain, as structs of pos, w1, w2; none of a chain of one word."""
    some = F.sequence(F.lit(0), F.greatest(F.size(chain) - 2, F.lit(0)))
    made = F.transform(some, lambda i: F.struct(i.alias("pos"), F.get(chain, i).alias("w1"), F.get(chain, i + 1).alias("w2")))
    return F.filter(made, lambda p: p["w2"].isNotNull())


def counts(rows: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Counts:
    """Counts over constructions (aux_chain, pattern, following_word). Rows with a null or empty chain count nowhere.

    ``keep`` may store the counts of chains, which several others are made of.
    """
    chains = keep(_usable(rows).groupBy(_chain().alias("chain")).agg(F.count("*").alias("n")))
    unigrams = chains.select(F.explode("chain").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    bigrams = chains.select(F.explode(pairs(F.col("chain"))).alias("p"), "n").groupBy("p.w1", "p.w2").agg(F.sum("n").alias("n"))
    said = _usable(rows).where("pattern <> '' and following_word <> ''")
    followers = said.groupBy("pattern", F.lower("following_word").alias("word")).agg(F.count("*").alias("n"))
    return Counts(unigrams, bigrams, followers, chains)


def delta_p_forward(n12: Column, n1: Column, n2: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(n12.cast("double"), n1), F.lit(0.0)) - F.coalesce(F.try_divide(n2.cast("double"), total), F.lit(0.0))


def delta_p_backward(n12: Column, n1: Column, n2: Column, total: Column) -> Column:
    return delta_p_forward(n12, n2, n1, total)


def chain_metrics(c: Counts) -> DataFrame:
    """(chain, instance_atp, instance_dpb): mean two-way transition probability, and backward delta P of the last pair."""
    total = c.chains.agg(F.sum(F.col("n") * F.size("chain"))).scalar()
    given = c.chains.select("chain", F.explode(pairs(F.col("chain"))).alias("p")).select("chain", "p.pos", "p.w1", "p.w2")
    known = (
        given.join(c.bigrams.select("w1", "w2", F.col("n").alias("n12")), ["w1", "w2"], "left")
        .join(c.unigrams.select(F.col("word").alias("w1"), F.col("n").alias("n1")), "w1", "left")
        .join(c.unigrams.select(F.col("word").alias("w2"), F.col("n").alias("n2")), "w2", "left")
        .withColumn("total", total)
        .select("chain", "pos", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n12", "n1", "n2", "total")))
    )
    fwd, back = (f(*map(F.col, ("n12", "n1", "n2", "total"))) for f in (delta_p_forward, delta_p_backward))
    return known.withColumns({"fwd": fwd, "back": back}).groupBy("chain").agg(F.avg((F.col("fwd") + F.col("back")) / 2).alias("instance_atp"), F.max_by("back", "pos").alias("instance_dpb"))


def entropy(counted: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """(by, entropy in bits) of the counts ``n`` that share the columns ``by``."""
    totals = counted.groupBy(*by).agg(F.sum(n).cast("double").alias("_total"))
    q = F.col(n) / F.col("_total")
    return counted.join(totals, by).groupBy(*by).agg(F.sum(-q * F.log2(q)).alias("entropy"))


def boundary_entropy(c: Counts) -> DataFrame:
    """(pattern, instance_hr): entropy of the words that follow a pattern."""
    return entropy(c.followers, ["pattern"]).withColumnRenamed("entropy", "instance_hr")


def with_instance_metrics(rows: DataFrame, c: Counts | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The rows with instance_atp, instance_dpb (0 for chains of under two words) and instance_hr (infinite without followers).

    ``keep`` may store the metrics of chains and patterns: each is then worked out once, and where it is small, which is
    known once it is stored, it goes to the rows. Entropies always do, one a pattern, so that no task has a pattern's rows.
    """
    c = c or counts(rows, keep)
    by_chain, by_pattern = keep(chain_metrics(c).withColumnRenamed("chain", "_chain")), keep(boundary_entropy(c))
    out = rows.withColumn("_chain", _chain()).join(by_chain, "_chain", "left").join(F.broadcast(by_pattern), "pattern", "left")
    zero = {x: F.coalesce(x, F.lit(0.0)) for x in ("instance_atp", "instance_dpb")}
    return out.withColumns(zero | {"instance_hr": F.coalesce("instance_hr", F.lit(float("inf")))}).select(*rows.columns, "instance_atp", "instance_dpb", "instance_hr")
