"""Constructions of parsed sentences.

A sentence is an array of its tokens, and everything that is looked for in its tree (children, subtrees, followers) is a
higher-order function over that array. So the only shuffles are those that bring a sentence's tokens together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.schemas import CONSTRUCTIONS

SENTENCE = ["doc_id", "sent_idx"]
_TOKEN = ["i", "text", "lemma", "tag", "pos", "dep", "head_i", "number"]
SUBJECTS = ["nsubjpass", "csubj", "csubjpass", "nsubj"]
AUXILIARY_SUBJECTS = ["nsubjpass", "nsubj"]
FOLLOWERS = ["NOUN", "VERB", "ADJ", "ADV", "PROPN"]


def sentences(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, text): sentences that hold a PASSIVE tag, their tokens joined by one space.

    What is no passive sentence never reaches a parser.
    """
    word = F.struct("token_num", "token")
    grouped = tokens.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(word)).alias("w"), F.max(F.coalesce(F.col("asc_tag") == "PASSIVE", F.lit(False))).alias("_p"))
    return grouped.where("_p").select(*SENTENCE, F.array_join(F.transform("w", lambda t: t["token"]), " ").alias("text"))


def _first(tokens: Column, test) -> Column:
    return F.get(F.filter(tokens, test), F.lit(0))


def span_root(span: Column, tokens: Column) -> Column:
    """The root of a run of tokens: the sentence's root if it lies inside, else the token nearest to it of those whose head lies outside."""
    inside = lambda t: F.exists(span, lambda x: x["i"] == t["head_i"])
    steps = lambda t: F.aggregate(
        F.sequence(F.lit(1), F.size(tokens)), F.struct(t["i"].alias("at"), F.lit(0).alias("n")),
        lambda a, _: F.when(_first(tokens, lambda x: x["i"] == a["at"])["head_i"] == a["at"], a).otherwise(F.struct(_first(tokens, lambda x: x["i"] == a["at"])["head_i"].alias("at"), (a["n"] + 1).alias("n"))),
    )["n"]
    nearest = F.array_min(F.transform(F.filter(span, lambda t: ~inside(t)), lambda t: F.struct(steps(t).alias("n"), t["i"].alias("i"))))["i"]
    return F.coalesce(_first(span, lambda t: t["head_i"] == t["i"]), _first(span, lambda t: t["i"] == nearest), F.get(span, F.lit(0)))


def children(tokens: Column, of: Column) -> Column:
    return F.filter(tokens, lambda t: (t["head_i"] == of) & (t["i"] != of))


def subtree(tokens: Column, root: Column) -> Column:
    """The tokens below a token, itself included, in order."""

    def widen(at: Column, _: Column) -> Column:
        ids = at["ids"]
        more = F.array_union(ids, F.transform(F.filter(tokens, lambda t: F.array_contains(ids, t["head_i"])), lambda t: t["i"]))
        return F.when(at["ended"], at).otherwise(F.struct(more.alias("ids"), (F.size(more) == F.size(ids)).alias("ended")))

    start = F.struct(F.array(root).alias("ids"), F.lit(False).alias("ended"))
    ids = F.aggregate(F.sequence(F.lit(1), F.size(tokens)), start, widen)["ids"]
    return F.filter(tokens, lambda t: F.array_contains(ids, t["i"]))


def texts(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t["text"])


def phrase(tokens: Column, root: Column) -> Column:
    return F.when(root.isNotNull(), F.array_join(texts(subtree(tokens, root)), " "))


def heads(tokens: Column, lemma: Column) -> Column:
    """The participle of a lemma; else the first verb of that lemma; else null."""
    same = lambda t: F.lower(t["lemma"]) == F.lower(lemma)
    return F.coalesce(_first(tokens, lambda t: same(t) & t["tag"].isin("VBN", "VBD")), _first(tokens, lambda t: same(t) & (t["pos"] == "VERB")))


def constructions(tokens: DataFrame, parse: DataFrame) -> DataFrame:
    """One row (CONSTRUCTIONS) a PASSIVE tag of ``tokens`` whose lemma has a head in the sentence's ``parse``.

    Two tags of one lemma in a sentence are two rows with one head. Tags without a head, or in unparsed sentences, give
    none. Rows of either table with a null doc_id or sent_idx meet nothing.
    """
    tags = tokens.where(F.col("asc_tag") == "PASSIVE").select(*SENTENCE, F.col("lemma").alias("_lemma"))
    trees = parse.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(F.struct(*_TOKEN))).alias("s"))
    s, h = F.col("s"), F.col("h")
    found = tags.join(trees, SENTENCE).withColumn("h", heads(s, F.col("_lemma"))).where("h is not null")
    found = found.withColumn("kids", children(s, h["i"]))
    kids = F.col("kids")
    found = found.withColumn("aux", F.filter(kids, lambda t: t["dep"].isin("aux", "auxpass")))
    own = _first(kids, lambda t: t["dep"].isin(*SUBJECTS))
    # subjects of the auxiliaries, in the auxiliaries' order
    lent = F.get(F.flatten(F.transform("aux", lambda a: F.filter(s, lambda t: (t["head_i"] == a["i"]) & (t["i"] != a["i"]) & t["dep"].isin(*AUXILIARY_SUBJECTS)))), F.lit(0))
    found = found.withColumn("subj", F.coalesce(own, lent))
    is_by = lambda t: (F.lower(t["text"]) == "by") & (t["pos"] == "ADP")
    is_prep = lambda t: ~is_by(t) & (t["dep"] == "prep") & (t["pos"] == "ADP")
    found = found.withColumns({
        "by": F.get(F.reverse(F.filter(kids, is_by)), F.lit(0)),
        "preps": F.filter(kids, is_prep),
        "vp": F.get(F.reverse(F.filter(kids, lambda t: ~is_by(t) & ~is_prep(t) & (t["dep"] == "xcomp"))), F.lit(0)),
        "below": F.when(F.col("subj").isNotNull(), subtree(s, F.col("subj.i"))),
    })
    below, subj = F.col("below"), F.col("subj")
    # the span runs from the first to the last token below the subject
    span = F.filter(s, lambda t: (t["i"] >= F.get(below, F.lit(0))["i"]) & (t["i"] <= F.get(F.reverse(below), F.lit(0))["i"]))
    found = found.withColumn("root", F.when(subj.isNotNull(), span_root(span, s)))
    root = F.col("root")
    names = F.array_distinct(F.transform("preps", lambda t: F.lower(t["text"])))
    pps = F.transform(names, lambda n: F.struct(F.concat(F.lit("pp_"), n).alias("key"), phrase(s, F.get(F.reverse(F.filter("preps", lambda t: F.lower(t["text"]) == n)), F.lit(0))["i"]).alias("value")))
    found = found.withColumns({"pps": pps, "by_text": phrase(s, F.col("by.i")), "vp_text": phrase(s, F.col("vp.i")), "subject_text": F.array_join(texts(below), " ")})
    prep_head = F.coalesce(F.when(F.col("by").isNotNull(), F.lit("by")), F.get(names, F.lit(0)))
    entry = lambda key, value: F.when(value.isNotNull(), F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    entries = F.concat(entry("by", F.col("by_text")), entry("prep_head", prep_head), F.col("pps").cast("array<struct<key:string,value:string>>"), entry("to_vp", F.col("vp_text")))
    lemmas = F.transform("aux", lambda t: t["lemma"])
    determiners = F.transform(F.filter(span, lambda t: t["dep"] == "det"), lambda t: t["lemma"])
    tail = F.coalesce(F.when(F.col("by_text") != "", F.col("by_text")), F.when(F.col("vp_text") != "", F.col("vp_text")), F.get(F.col("pps"), F.lit(0))["value"])
    found = found.withColumns({
        "tam": classify.tam(texts(F.col("aux")), lemmas, classify.has_modal(lemmas)),
        "comp": classify.complement(F.transform(entries, lambda e: e["key"]), prep_head),
        "subjtype": classify.subject_of_root(subj.isNotNull(), root["pos"], root["dep"], root["lemma"], root["number"], determiners),
        "surface": F.concat_ws(" ", "subject_text", texts(F.col("aux")), h["text"], tail),
        "head_lemma": h["lemma"],
        "aux_chain": F.concat(texts(F.col("aux")), F.array(h["text"])),
        "following_word": _first(s, lambda t: (t["i"] > h["i"]) & t["pos"].isin(*FOLLOWERS))["text"],
        "complements": F.map_from_entries(entries),
    })
    return found.withColumn("pattern", classify.pattern(F.col("tam"), F.col("comp"))).select(*CONSTRUCTIONS.names)
