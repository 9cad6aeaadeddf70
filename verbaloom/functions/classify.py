"""Rule-based classification of constructions: auxiliaries, subjects, complements, pattern keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def _words(*words: str) -> Column:
    return F.array(*map(F.lit, words))


def lowered(words: Column) -> Column:
    return F.transform(words, F.lower)


def has_modal(lemmas: Column) -> Column:
    """Is any of the lemmas a modal? Null arrays have none."""
    return F.coalesce(F.arrays_overlap(lowered(lemmas), _words(*vocab.MODALS)), F.lit(False))


def tam(surface: Column, lemmas: Column, modal: Column) -> Column:
    """Tense-aspect-modality of an auxiliary chain from its forms, lemmas, and whether a modal is in it.

    The first rule that holds decides; null or empty chains, and chains that no rule knows, are ``unknown``.
    """
    s, m = lowered(surface), lowered(lemmas)
    form, lemma = (lambda w: F.array_contains(s, w)), (lambda w: F.array_contains(m, w))
    only = lambda *w: F.array_join(s, " ").isin(*w) & (F.size(s) == 1)
    return (
        F.when(F.coalesce(F.size(s), F.lit(0)) <= 0, "unknown")
        .when(modal & lemma("be"), "modal-be")
        .when(only("was", "were"), "past-be")
        .when(only("is", "are", "am"), "pres-be")
        .when((lemma("have") | form("has") | form("have")) & (form("been") | lemma("be")), "perf-be")
        .when(form("being") & lemma("be"), "prog-be")
        .when(lemma("get"), "get-be")
        .otherwise("unknown")
    )


def subject_of_text(text: Column) -> Column:
    """Subject type of a bare string; a null or empty one is a definite noun phrase."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.isin(*vocab.PRONOUNS), "PRON")
        .when(t.rlike("^(the|this|that) "), F.when(t.endswith("s"), "PL_NP").otherwise("DEF_NP"))
        .when(t.rlike("^(a|an) "), "INDEF_NP")
        .otherwise("DEF_NP")
    )


def subject_of_root(found: Column, pos: Column, dep: Column, lemma: Column, number: Column, determiners: Column) -> Column:
    """Subject type from the root of a subject span, and the lemmas of the determiners below it."""
    dets = F.coalesce(lowered(determiners), F.array().cast("array<string>"))
    return (
        F.when(~F.coalesce(found, F.lit(False)), "DEF_NP")
        .when(dep == "expl", "EXPL")
        .when(pos == "PRON", F.when(F.lower(lemma).isin(*vocab.RELATIVE_PRONOUNS), "REL").otherwise("PRON"))
        .when(pos == "PROPN", "PROPN")
        .when(number == "Plur", "PL_NP")
        .when(F.arrays_overlap(dets, _words(*vocab.DEFINITE)), "DEF_NP")
        .when(F.arrays_overlap(dets, _words(*vocab.INDEFINITE)), "INDEF_NP")
        .otherwise("DEF_NP")
    )


def complement(keys: Column, prep_head: Column) -> Column:
    """Complement type from the keys of the complements, in order, and the head preposition."""
    keys = F.coalesce(keys, F.array().cast("array<string>"))
    has = lambda *k: F.arrays_overlap(keys, _words(*k))
    named = F.when((prep_head.isNotNull()) & (prep_head != ""), F.lower(prep_head))
    first = F.get(F.filter(keys, lambda k: k.startswith("pp_")), F.lit(0))
    return (
        F.when(has("by_entity") | (named == "by"), "by_NP")
        .when(named.isNotNull(), F.concat(F.lit("pp_"), named, F.lit("_NP")))
        .when(has("to_inf", "to_vp"), "to_VP")
        .when(first.isNotNull(), F.concat(F.lit("pp_"), F.get(F.split(first, "_"), F.lit(1)), F.lit("_NP")))
        .otherwise("Ø")
    )


def pattern(tam: Column, comp: Column) -> Column:
    """Pattern key; the subject type has no part in it."""
    return F.concat(tam, F.lit(","), comp)


def valid_tam(x: Column) -> Column:
    return F.coalesce(x.isin(*vocab.VALID_TAM, *vocab.INVALID_TAM), F.lit(False))


def valid_subject(x: Column) -> Column:
    return F.coalesce(x.isin(*vocab.SUBJECT_TYPES), F.lit(False))


def valid_complement(x: Column) -> Column:
    return F.coalesce(x.isin("Ø", "to_VP", "by_NP") | (x.startswith("pp_") & x.endswith("_NP")), F.lit(False))
