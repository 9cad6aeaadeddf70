"""Verb lemmas: invalid ones are filtered, known errors replaced, joined words and participles cut back.

A cut lemma is judged again, until nothing more can be cut. Each cut shortens it, so as many rounds as a lemma has
letters are enough; they run as one fold inside the row, without a shuffle.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: A lemma of more letters is filtered.
LONGEST = 24
#: What -ed is taken from: a doubled consonant becomes single. Words of under five letters keep it.
_IED, _ED = "(?<=..)ied$", f"(?:(?<=.)([{vocab.DOUBLED}])\\1|(?<=..)(.))ed$"
_EN = "^(.{3,})en$"
_PARTICIPLE = "^(" + "|".join(vocab.JOINED_PARTICIPLES) + ")."
#: The shortest first part, of 4 to 11 letters, of a word of nine letters or more whose second part begins like a word.
_JOINED = "^(?=.{9})(.{4,11}?)(?:" + "|".join(vocab.JOINED_BEGINNINGS) + ")"


def _table(words: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(words.items())))


def without_ed(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, _IED, "y"), _ED, "$1$2")


def cut(lemma: Column) -> Column:
    """The verb within a lower-case lemma that is a participle or two joined words; null (or itself) if it is neither."""
    part = lambda x, rule: F.nullif(F.regexp_extract(x, rule, 1), F.lit(""))
    return F.coalesce(
        F.when(lemma.endswith("ed"), part(without_ed(lemma), "^(.{3,})$")),
        part(lemma, _EN),
        F.element_at(_table(vocab.JOINED_PARTICIPLES), part(lemma, _PARTICIPLE)),
        without_ed(part(lemma, _JOINED)),
    )


def invalid(lemma: Column) -> Column:
    """Is a lower-case lemma too short, too long, or more than letters and hyphens?"""
    return lemma.isNull() | ~lemma.rlike(f"^[a-z-]{{3,{LONGEST}}}$")


def validated(lemma: Column, strict: bool = True) -> Column:
    """struct<lemma, status>: status is valid, corrected, tokenization_error or filtered (then lemma is null).

    With ``strict`` off, participle endings are left alone, as most words that end so are spelled well.
    """
    known = lambda x: x.isin(*vocab.VERB_CORRECTIONS)
    given = F.lower(F.trim(lemma))
    shorter = cut if strict else lambda x: F.when(~x.rlike("(ed|en)$"), cut(x))

    def step(at: Column, _: Column) -> Column:
        word = at["word"]
        new = F.when(~at["ended"] & ~known(word), shorter(word))
        ended = new.isNull() | (new == word) | invalid(new)
        return F.struct(F.when(ended, word).otherwise(new).alias("word"), ended.alias("ended"))

    def result(last: Column) -> Column:
        bad = invalid(given)
        final = F.coalesce(F.element_at(_table(vocab.VERB_CORRECTIONS), last), last)
        status = F.when(bad, "filtered").when(known(given), "corrected").when(last != given, "tokenization_error").otherwise("valid")
        return F.struct(F.when(~bad, final).alias("lemma"), status.alias("status"))

    start = F.struct(given.alias("word"), invalid(given).alias("ended"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST)), start, step, lambda at: at["word"])
    # bound once, as it is read more than once
    return F.get(F.transform(F.array(last), result), F.lit(0))
