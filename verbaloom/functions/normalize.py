"""Normal forms of prepositions, complements and patterns; null where there is none."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: Corrections that lead to a preposition; the others lead nowhere.
_KNOWN = {k: v for k, v in vocab.PREP_CORRECTIONS.items() if v in vocab.VALID_PREPOSITIONS and v not in vocab.INVALID_PREPS}


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))


def preposition(prep: Column) -> Column:
    """A preposition, lower-cased and corrected; null if it is none. Unknown ones stay."""
    p = F.lower(F.trim(prep))
    return (
        F.when(prep.isNull() | (prep == "") | p.isin(*vocab.INVALID_PREPS), None)
        .when(p.isin(*vocab.PREP_CORRECTIONS), F.element_at(_lookup(_KNOWN), p))
        .otherwise(p)
    )


def complement(comp: Column) -> Column:
    """A complement type with its preposition normalised; entity marks of by-phrases go."""
    prep = preposition(F.substring(comp, F.lit(4), F.length(comp) - 6))
    return (
        F.when(comp.isNull() | (comp == ""), None)
        .when(comp.isin("Ø", "to_VP", "by_NP"), comp)
        .when(comp.startswith("by_NP[ENT="), "by_NP")
        .when(comp.startswith("pp_") & comp.endswith("_NP"), F.concat(F.lit("pp_"), prep, F.lit("_NP")))
        .otherwise(comp)
    )


def pattern(key: Column) -> Column:
    """A pattern key with its complement normalised; a key without a comma stays."""
    parts = F.split(key, ",", 2)
    return F.when(key == "", None).when(F.size(parts) != 2, key).otherwise(F.concat(F.get(parts, F.lit(0)), F.lit(","), complement(F.get(parts, F.lit(1)))))
