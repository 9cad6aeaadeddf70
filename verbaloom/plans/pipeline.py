"""The analysis from constructions to accepted patterns, as one lazy plan with switches for its two published forms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import vocab
from ..operators import acceptance, batches, filters, metrics, statistics, tree


@dataclass
class Analysis:
    raw: DataFrame
    valid: DataFrame
    scored: DataFrame  # valid, cleaned, with instance metrics
    formulaic: DataFrame
    patterns: DataFrame  # metrics, lanes, accepted

    @property
    def accepted(self) -> DataFrame:
        return self.patterns.where("accepted")


def analyse(raw: DataFrame, normalize: bool = True, validate_lemmas: bool = True, doc_ids: bool = True, mode: str = "production", lemma_field: str = "head_lemma", strict: bool = True, atp: float = vocab.ATP, dpb: float = vocab.DPB, hr: float = vocab.HR) -> Analysis:
    """Constructions to accepted patterns.

    All switches on is the full form; the validation form has normalize, validate_lemmas and doc_ids off, so that all rows
    count as one document. An empty table gives empty results. Clean rows are kept (memory, then disk), as several
    aggregates read them.
    """
    kept = filters.valid(raw)
    clean = kept if doc_ids else kept.withColumn("doc_id", F.lit(None).cast("string"))
    if normalize:
        clean = batches.normalized(clean)
    if validate_lemmas:
        clean = batches.validated(clean, lemma_field, strict)
    clean = clean.persist(StorageLevel.MEMORY_AND_DISK)
    scored = statistics.with_instance_metrics(clean)
    formulaic = filters.formulaic(scored, atp, dpb, hr)
    return Analysis(raw, kept, scored, formulaic, acceptance.accept(metrics.pattern_metrics(formulaic), mode))


def annotate(tokens: DataFrame, annotator: Callable, partitions: int | None = None) -> DataFrame:
    """PARSE rows of the sentences that hold a PASSIVE tag.

    annotator: from batches of (doc_id, sent_idx, text) to batches of PARSE, as for mapInPandas; a parser is loaded once a
    task. A task that fails is run again by Spark. ``partitions`` deals sentences evenly before a slow parser.
    """
    from ..functions.schemas import PARSE

    given = tree.sentences(tokens)
    return (given.repartition(partitions, *tree.SENTENCE) if partitions else given).mapInPandas(annotator, PARSE)


def extract(tokens: DataFrame, annotator: Callable, partitions: int | None = None) -> DataFrame:
    """CONSTRUCTIONS of tagged tokens, through a parser."""
    return tree.constructions(tokens, annotate(tokens, annotator, partitions))


def tag_documents(documents: DataFrame, tagger: Callable, partitions: int | None = None) -> DataFrame:
    """TOKENS of (doc_id, text) by a tagger from batches of these to batches of TOKENS; batch sizes are Spark's setting."""
    from ..functions.schemas import TOKENS

    plain = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return (plain.repartition(partitions, "doc_id") if partitions else plain).mapInPandas(tagger, TOKENS)
