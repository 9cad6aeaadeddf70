"""Constructions of bare texts by surface rules: a stand-in for a dependency parser, not its equal, and for English alone.

A run of auxiliaries (the last four words of it, as English has no longer chain) that ends in a form of *be* or *get* is
the chain, the word after it the head, the word after that the complement's preposition (or none), and the first content
word after the head the follower. Everything stays inside a sentence and inside its row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, vocab

# The forms of the auxiliaries (modals are in vocab), and prepositions that open a complement.
BE = ["is", "are", "am", "was", "were", "be", "been", "being"]
GET = ["get", "gets", "got", "gotten", "getting"]
HAVE = ["have", "has", "had", "having"]
PREPOSITIONS = ["to", "with", "for", "in", "on", "from", "of", "as", "at"]
LAST = BE + GET
AUXILIARIES = LAST + HAVE + vocab.MODALS
#: Words that are no followers.
FUNCTION_WORDS = sorted({*AUXILIARIES, *PREPOSITIONS, *vocab.DEFINITE, *vocab.INDEFINITE, *vocab.PRONOUNS, *vocab.RELATIVE_PRONOUNS, "by", "and", "or", "but", "not"})
LONGEST = 4


def lemma(word: Column) -> Column:
    return F.when(word.isin(*BE), "be").when(word.isin(*GET), "get").when(word.isin(*HAVE), "have").otherwise(word)


def constructions(docs: DataFrame, lang: str | None = "en") -> DataFrame:
    """One row a chain and its head, from documents (doc_id, text, and lang if it is given).

    Only documents of ``lang`` are read, as the rules are English by design (None: all of them). Sentences end at . ! or ?.
    Columns: row_id, doc_id (string), sent_idx, pos, surface, tam, comp, subjtype, pattern, head_lemma, subject_text,
    aux_chain, following_word. Null and empty texts give no rows; other columns are ignored.
    """
    given = docs if lang is None else docs.where(F.col("lang") == lang)
    sentence = given.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split(F.lower("text"), "[.!?]")).alias("sent_idx", "s"))
    words = sentence.select("doc_id", "sent_idx", F.regexp_extract_all("s", F.lit("[a-z]+"), F.lit(0)).alias("w")).where(F.arrays_overlap("w", F.array(*map(F.lit, LAST))))
    at = lambda i: F.get(F.col("w"), i)
    is_aux = lambda i: F.coalesce(at(i).isin(*AUXILIARIES), F.lit(False))
    hits = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0))), lambda i: at(i).isin(*LAST) & at(i + 1).isNotNull() & ~is_aux(i + 1))
    back = lambda i: F.when(~is_aux(i - 1), 0).when(~is_aux(i - 2), 1).when(~is_aux(i - 3), 2).otherwise(LONGEST - 1)
    content = lambda i: F.get(F.filter(F.slice("w", i + 3, F.size("w")), lambda x: ~x.isin(*FUNCTION_WORDS)), F.lit(0))
    found = F.transform(hits, lambda i: F.struct(i.alias("pos"), at(i - back(i) - 1).alias("subject_text"), F.slice("w", i - back(i) + 1, back(i) + 1).alias("aux"), at(i + 1).alias("head_lemma"), at(i + 2).alias("next"), content(i).alias("following_word")))
    rows = words.select("doc_id", "sent_idx", F.explode(found).alias("c")).select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), F.col("c.pos").cast("long").alias("pos"), "c.subject_text", "c.aux", "c.head_lemma", "c.next", "c.following_word")
    next_, none = F.col("next"), F.lit("Ø")
    comp = F.when(next_ == "by", "by_NP").when(next_.isin(*PREPOSITIONS), F.concat(F.lit("pp_"), next_, F.lit("_NP"))).otherwise(none)
    lemmas = F.transform("aux", lemma)
    return (
        rows.withColumns({
            "row_id": F.concat_ws(":", "doc_id", "sent_idx", "pos"),
            "comp": comp,
            "tam": classify.tam(F.col("aux"), lemmas, classify.has_modal(lemmas)),
            "subjtype": classify.subject_of_text(F.col("subject_text")),
            "aux_chain": F.concat("aux", F.array("head_lemma")),
        })
        .withColumns({"pattern": classify.pattern(F.col("tam"), F.col("comp")), "surface": F.concat_ws(" ", "subject_text", "aux", "head_lemma", F.when(F.col("comp") != none, next_))})
        .select("row_id", "doc_id", "sent_idx", "pos", "surface", "tam", "comp", "subjtype", "pattern", "head_lemma", "subject_text", "aux_chain", "following_word")
    )
