"""Writers. Tables are written by the executors, as folders; only reports, which are small, pass through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schemas import INSTANCES
from ..operators.metrics import NAMES


#: Rows of a CSV file. A file with texts of many lines is read by one task, so it must not grow with the table.
ROWS_A_FILE = 200_000


def _csv(table: DataFrame, path: str, mode: str, rows_a_file: int = ROWS_A_FILE) -> None:
    def flat(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c).alias(f.name)
        if isinstance(f.dataType, T.DoubleType):
            return F.when(c == float("inf"), "inf").otherwise(c.cast("string")).alias(f.name)
        return c

    out = table.select(*map(flat, table.schema)).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").option("maxRecordsPerFile", rows_a_file)
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_corpus(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", mode: str = "error") -> None:
    """(doc_id, text) as a CSV that ``files.read_corpus`` reads; texts are quoted, with all their lines."""
    _csv(docs.select(F.col("doc_id").cast("string").alias(id_column), F.col("text").alias(text_column)), path, mode, ROWS_A_FILE // 10)


def write_instances(rows: DataFrame, path: str, mode: str = "error") -> None:
    """The eleven columns of INSTANCES as CSV; infinite entropies as ``inf``, other columns left out. An empty table writes nothing."""
    if not rows.isEmpty():
        _csv(rows.select(*INSTANCES.names), path, mode)


def write_patterns(patterns: DataFrame, path: str, mode: str = "error") -> None:
    """The metrics of patterns as CSV, the most frequent first. An empty table writes nothing."""
    if not patterns.isEmpty():
        _csv(patterns.select(*NAMES).orderBy(F.desc("n_tokens"), "pattern"), path, mode)


def write_constructions(rows: DataFrame, path: str, mode: str = "error") -> None:
    """All columns as CSV, nested ones as JSON."""
    _csv(rows, path, mode)


def inventory(patterns: DataFrame) -> DataFrame:
    """(pattern, n, n_docs, npmi, h_slot, g_squared, atp, delta_p, accepted, lane); an empty lane where not accepted."""
    return patterns.select("pattern", F.col("n_tokens").alias("n"), "n_docs", "npmi", "h_slot", "g_squared", "atp", "delta_p", "accepted", F.coalesce("lane", F.lit("")).alias("lane"))


def schema_inventory(patterns: DataFrame) -> DataFrame:
    """(schema, n, npmi, h_slot, g_squared, atp, delta_p, lane) of the accepted patterns, rounded half to even: four decimals, g_squared two."""
    digits = {"npmi": 4, "h_slot": 4, "g_squared": 2, "atp": 4, "delta_p": 4}
    return inventory(patterns).where("accepted").select(F.col("pattern").alias("schema"), "n", *(F.bround(c, d).alias(c) for c, d in digits.items()), "lane")


def write_inventory(patterns: DataFrame, path: str, mode: str = "error") -> None:
    """Patterns with their lanes: ``patterns`` for all, ``schemas`` for those accepted, the most frequent first."""
    all_ = inventory(patterns).orderBy(F.desc("n"), "pattern")
    _csv(all_, f"{path}/patterns", mode)
    _csv(all_.where("accepted").drop("accepted").withColumnRenamed("pattern", "schema"), f"{path}/schemas", mode)


def write_json(tables: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Results, a folder of JSON lines for each table."""
    for name, table in tables.items():
        table.write.mode(mode).json(f"{path}/{name}")


def write_venn(parts: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a part of (pattern, part): part, n, patterns."""
    out = parts.groupBy("part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("pattern")).alias("patterns"))
    out.coalesce(1).write.mode(mode).json(path)
