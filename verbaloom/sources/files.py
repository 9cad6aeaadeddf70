"""Readers of corpora, annotated tokens, and tables that were written before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.schemas import INSTANCES, PATTERNS, TOKENS

ASC_SUFFIX = "_ASCinfo.txt"


def doc_id_of(file_name: Column, suffix: str = ASC_SUFFIX) -> Column:
    """The file's name without the suffix (or without its extension, where the suffix is missing)."""
    return F.when(file_name.endswith(suffix), F.substring(file_name, F.lit(1), F.length(file_name) - len(suffix))).otherwise(F.regexp_replace(file_name, r"\.[^.]*$", ""))


def read_asc_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, value): the annotated files of a folder, each as one text; many small files share a task, empty ones give no row."""
    # wholetext must be an argument: text() overrides an option of that name
    raw = spark.read.option("pathGlobFilter", f"*{ASC_SUFFIX}").option("recursiveFileLookup", True).text(folder, wholetext=True)
    return raw.select(doc_id_of(F.col("_metadata.file_name")).alias("doc_id"), "value")


def _lines(files: DataFrame) -> DataFrame:
    line = files.select("doc_id", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    parts = F.split("line", "\t")
    is_token = (F.col("line") != "") & ~F.col("line").startswith("#") & (F.size(parts) >= 3)
    return line.withColumns({"parts": parts, "is_token": is_token})


def _sentences(lines: DataFrame, ends: Column) -> DataFrame:
    """Adds sent_idx (from 1) to token lines; a sentence ends at lines where ``ends``, and empty ones have no number."""
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = lines.withColumn("g", F.sum(ends.cast("int")).over(before))
    return grouped.where("is_token").withColumn("sent_idx", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("g")))


def _checked(files: DataFrame) -> DataFrame:
    lines = _lines(files).withColumn("token_num", F.get("parts", F.lit(0)).try_cast("int"))
    return lines.withColumn("failed", F.max(F.col("is_token") & F.col("token_num").isNull()).over(Window.partitionBy("doc_id")))


def asc_tokens(files: DataFrame) -> DataFrame:
    """TOKENS of annotated files (doc_id, value). ``# sent_id`` lines end sentences; blank and other # lines are skipped.

    Lines of under three fields are skipped, an empty tag is null. A token number that is no integer fails its whole file:
    it gives no tokens here, but is in ``failed_files``. Null and empty files give none.
    """
    good = _checked(files).where("not failed")
    out = _sentences(good, F.col("line").startswith("# sent_id"))
    field = lambda k: F.get("parts", F.lit(k))
    return out.select("doc_id", "sent_idx", "token_num", field(1).alias("token"), field(2).alias("lemma"), F.nullif(field(3), F.lit("")).alias("asc_tag")).to(TOKENS)


def failed_files(files: DataFrame) -> DataFrame:
    return _checked(files).where("failed").select("doc_id").distinct()


def asc_tokens_loose(files: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, num, token, lemma, asc_tag), all text: any blank or # line ends a sentence, a missing tag is ``-``."""
    out = _sentences(_lines(files), (F.col("line") == "") | F.col("line").startswith("#"))
    field = lambda k: F.get("parts", F.lit(k))
    return out.select("doc_id", "sent_idx", field(0).alias("num"), field(1).alias("token"), field(2).alias("lemma"), F.coalesce(F.nullif(field(3), F.lit("")), F.lit("-")).alias("asc_tag"))


def asc_profile(files: DataFrame) -> DataFrame:
    """(asc_tag, n) over the tags of files as ``asc_tokens_loose`` reads them."""
    return asc_tokens_loose(files).where("asc_tag <> '-'").groupBy("asc_tag").agg(F.count("*").alias("n"))


def asc_totals(files: DataFrame) -> DataFrame:
    """(doc_id, total_sentences, total_tokens)."""
    return asc_tokens_loose(files).groupBy("doc_id").agg(F.max("sent_idx").alias("total_sentences"), F.count("*").alias("total_tokens"))


def read_corpus(spark: SparkSession, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text) of a CSV with a header and quoted texts of many lines; another corpus names its columns file_name and text_field."""
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    return table.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


def read_instances(spark: SparkSession, path: str, missing_hr: float = float("inf")) -> DataFrame:
    """INSTANCES from CSV; a missing boundary entropy is ``missing_hr`` (infinite, or 999 as permutation scripts take it), other missing numbers 0."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("positiveInf", "inf").option("enforceSchema", False).schema(INSTANCES).csv(path)
    return raw.withColumns({"instance_atp": F.coalesce("instance_atp", F.lit(0.0)), "instance_dpb": F.coalesce("instance_dpb", F.lit(0.0)), "instance_hr": F.coalesce("instance_hr", F.lit(float(missing_hr)))})


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).schema(PATTERNS).csv(path)


def pattern_names(patterns: DataFrame) -> DataFrame:
    return patterns.select("pattern").distinct()


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id): one a line, trimmed; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("doc_id")).where("doc_id <> ''")


def missing_documents(corpus: DataFrame, done: DataFrame) -> DataFrame:
    """Documents without a result yet."""
    return corpus.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def listed_documents(wanted: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc_id, text, found) for each wanted id."""
    known = corpus.select("doc_id", "text", F.lit(True).alias("found"))
    return wanted.select("doc_id").join(known, "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
