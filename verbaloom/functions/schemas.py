"""Schemas of the tables that operators pass on."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "strings": T.ArrayType(T.StringType()),
    "entries": T.MapType(T.StringType(), T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """Made without a session, so that modules can be imported before there is one."""
    return T.StructType([T.StructField(c, _TYPES[t]) for c, t in (x.split() for x in columns.split(", "))])


TOKENS = _schema("doc_id string, sent_idx int, token_num int, token string, lemma string, asc_tag string")
#: One row a token of a dependency parse; head_i is the place of its head (its own place at the root).
PARSE = _schema("doc_id string, sent_idx int, i int, text string, lemma string, tag string, pos string, dep string, head_i int, number string")
CONSTRUCTIONS = _schema(
    "doc_id string, sent_idx int, surface string, tam string, comp string, subjtype string, pattern string, head_lemma string, "
    "subject_text string, aux_chain strings, following_word string, complements entries"
)
#: Columns of the instance CSV.
INSTANCES = _schema(
    "doc_id string, surface string, tam string, comp string, subjtype string, head_lemma string, pattern string, subject_text string, "
    "instance_atp double, instance_dpb double, instance_hr double"
)
#: Columns of the pattern CSV.
PATTERNS = _schema(
    "pattern string, n_tokens bigint, n_docs bigint, atp double, delta_p double, h_slot double, npmi double, dispersion double, "
    "g_squared double, p_value double, p_value_fdr double"
)
