"""Small inline tables for the operators that no driver table feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "tam_cases": (
        "id int, surface string, lemmas string, modal boolean",
        [(1, "is", "be", False), (2, "was", "be", False), (3, "has been", "have be", False), (4, "will be", "will be", True), (5, "is being", "be be", False), (6, "got", "get", False),
         (7, "", "", False), (8, "'s", "be", False), (9, "Were", "be", False), (10, "being", "be", False), (11, "had been", "have be", False), (12, "can", "can", True), (13, "are", "be", False),
         (14, "should have been", "should have be", True), (15, "be", "be", False), (16, "been", "be", False), (17, "AM", "be", False), (18, "gets", "get", False)],
    ),
    "comp_cases": (
        "id int, keys string, prep_head string",
        [(1, "by", "by"), (2, "by_entity", None), (3, "to_vp", None), (4, "", None), (5, "pp_with", None), (6, "pp_On,to_vp", "On"), (7, "to_inf", None), (8, "pp_in,pp_on", None), (9, "by", None), (10, "to_vp,pp_at", None)],
    ),
    "subject_cases": (
        "id int, subject_text string",
        [(1, "it"), (2, " The books"), (3, "the book"), (4, "a student"), (5, "an apple"), (6, "students"), (7, None), (8, "This"), (9, "that idea"), (10, "those boys"), (11, "WE"), (12, ""), (13, "this boss")],
    ),
    "filter_cases": (
        "id int, subjtype string, subject_text string, surface string, tam string, comp string, pattern string, head_lemma string",
        [(1, "PRON", "it", "it is known that language is complex", "pres-be", "Ø", "pres-be,Ø", "know"), (2, "PRON", "it", "it was destroyed by fire", "past-be", "by_NP", "past-be,by_NP", "destroy"),
         (3, "DEF_NP", "the book", "the book was written that year", "past-be", "Ø", "past-be,Ø", "write"), (4, "PRON", " It ", "It was asked whether", "past-be", "Ø", "past-be,Ø", "ask"),
         (5, "PRON", "it", "it was asked whether he", "past-be", "Ø", "past-be,Ø", "ask"), (6, "PRON", None, "it is said to be", "pres-be", "Ø", "pres-be,Ø", "say"), (7, "DEF_NP", "x", "x got hit", "get-be", "Ø", "get-be,Ø", "hit"),
         (8, "DEF_NP", "x", "x hit", "unknown", "Ø", "unknown,Ø", "hit"), (9, "DEF_NP", "x", None, "pres-be", "Ø", "pres-be,Ø", "hit"), (10, "PRON", "it", "it if it is found if so", "pres-be", "Ø", "pres-be,Ø", "find")],
    ),
    "prep_cases": (
        "id int, prep string",
        [(1, "form"), (2, "fro"), (3, "amangst"), (4, "thorughout"), (5, "with"), (6, "tooin"), (7, "ie"), (8, "unknown_prep"), (9, "toward"), (10, "per"), (11, "althrough"), (12, None), (13, ""), (14, " With "), (15, "FORM"), (16, "notwithstanding"), (17, "inspite"), (18, "a")],
    ),
    "pattern_cases": (
        "id int, comp string, pattern string",
        [(1, "pp_form_NP", "modal-be,pp_form_NP"), (2, "pp_amangst_NP", "pres-be,pp_amangst_NP"), (3, "pp_tooin_NP", "pres-be,pp_tooin_NP"), (4, "by_NP", "past-be,by_NP"), (5, "by_NP[ENT=PERSON]", "past-be,by_NP[ENT=PERSON]"), (6, "Ø", "pres-be,Ø"),
         (7, "to_VP", "odd"), (8, "pp_from_NP", "modal-be,pp_from_NP"), (9, "", "x,"), (10, None, None), (11, "pp_form_NP", "pres-be,pp_form_NP"), (12, "pp_with", "pres-be,pp_with"), (13, "pp_fro_NP", "modal-be,pp_fro_NP")],
    ),
    "merge_cases": (
        "ord int, pattern string, n_tokens bigint, n_docs bigint, npmi double",
        [(1, "pres-be,pp_form_NP", 3, 2, 0.25), (2, "pres-be,pp_from_NP", 5, 4, 0.5), (3, "pres-be,pp_tooin_NP", 1, 1, 0.75), (4, "past-be,by_NP[ENT=X]", 2, 2, 0.125), (5, "past-be,by_NP", 7, 1, 0.0), (6, "odd", 1, 1, 0.0), (7, "pres-be,Ø", 9, 9, -0.5)],
    ),
    "lemma_cases": (
        "id int, lemma string",
        [(k, w) for k, w in enumerate(
            ["use", "consider", "crushedthi", "gainedSome", "seenmore", "glorifiedTo", "highlightene", "recognise", "chose", "instutationalize", "understand", "establish", "demonstrate", "screen", "threaten",
             "summarize", "do", "go", "a", "123verb", None, "", "succeed", "taken", "planned", "re-open", "don't", "abcdefghijklmnopqrstuvwxyz", " Written ", "writtendown", "wroteed", "carriedout", "needed"], 1)],
    ),
    "enum_cases": ("id int, tam string, subjtype string, comp string", [(1, "pres-be", "PRON", "Ø"), (2, "get-be", "REL", "pp_x_NP"), (3, "future", "NP", "pp_x"), (4, None, None, None), (5, "unknown", "EXPL", "to_VP"), (6, "prog-be", "PL_NP", "by_NP")]),
    "asc_files": (
        "doc_id string, value string",
        [("A1", "# sent_id = 1\n1\tIt\tit\t\n2\tis\tbe\tATTR\n3\ttime\ttime\n\n4\tnow\tnow\n# sent_id = 2\n# a remark\n1\tseen\tsee\tPASSIVE\n2\tshort\n"), ("A2", "1\tx\ty\tPASSIVE"), ("A3", "# sent_id = 1\none\tx\ty\n2\ta\tb\tATTR\n"), ("A4", ""), ("A5", "# sent_id = 1\n# sent_id = 2\r\n1\tp\tq\tTRAN-S\textra\r\n\r\n2\tr\ts\tPASSIVE\r\n")],
    ),
    "surface_texts": (
        "doc_id bigint, text string, lang string",
        [(1, "The plan has been analyzed carefully. It will be seen by us! They were being kept in Rome", "en"), (2, "he got hit by it? should have been being told to the men", "en"), (3, "is", "en"), (4, None, "en"), (5, "", "en"), (6, "El plan is made", "es"),
         (7, "A cat was . seen. may be be is was taken of of the and stone", "en"), (8, "been given, am I been made", None), (9, "Has Been Made With care; WERE getting a lift", "en")],
    ),
    "instance_cases": (
        "doc_id string, surface string, tam string, comp string, subjtype string, head_lemma string, pattern string, subject_text string, instance_atp double, instance_dpb double, instance_hr double",
        [("d1", "a, \"b\"", "pres-be", "Ø", "PRON", "see", "pres-be,Ø", "", 0.5, 0.25, 1.5), ("d2", " x", "past-be", "by_NP", "PRON", "see", "past-be,by_NP", None, None, 0.125, None), ("d3", "y", "past-be", "by_NP", "PRON", "see", "past-be,by_NP", "z", 0.75, None, float("inf"))],
    ),
    "tagger_summary": (
        "filename string, nwords int, PASSIVE_freq int, clauseCount string, clauseCountNoBe string, passive_Rate double, PASSIVE_Prop string",
        [("b.txt", 10, 2, "4", "", 0.5, "0.25"), ("a.txt", 20, 1, "6", None, None, "0.75"), ("d.txt", 5, 0, "x", "", 0.0, ""), ("c.txt", None, 3, "8", "", 1.0, "0.5")],
    ),
    "set_cases": ("id int, a string, b string", [(1, "x,y,z", "y,z,w"), (2, "", ""), (3, "x", ""), (4, "x,x", "x"), (5, "p,q", "r")]),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def cte(name: str) -> str:
    """The same table as a SQL common table expression."""
    schema, rows = TABLES[name]
    cols = [c.split() for c in schema.split(", ")]

    def literal(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, float) and x == float("inf"):
            return "'inf'::DOUBLE"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return str(x)

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    cast = ", ".join(f"{c}::{ {'string': 'VARCHAR', 'int': 'INTEGER'}.get(t, t) } AS {c}" for c, t in cols)
    return f"{name} AS (SELECT {cast} FROM (VALUES {body}) AS v({', '.join(c for c, _ in cols)}))"


# Parses of five sentences: (sent_idx, [(text, lemma, tag, pos, dep, head, number)]), heads by place.
TREES = [
    (1, [("The", "the", "DT", "DET", "det", 1, None), ("book", "book", "NN", "NOUN", "nsubjpass", 3, "Sing"), ("was", "be", "VBD", "AUX", "auxpass", 3, None), ("written", "write", "VBN", "VERB", "ROOT", 3, None), ("by", "by", "IN", "ADP", "agent", 3, None), ("students", "student", "NNS", "NOUN", "pobj", 4, "Plur")]),
    (2, [("It", "it", "PRP", "PRON", "nsubjpass", 3, "Sing"), ("has", "have", "VBZ", "AUX", "aux", 3, None), ("been", "be", "VBN", "AUX", "auxpass", 3, None), ("analyzed", "analyze", "VBN", "VERB", "ROOT", 3, None)]),
    (3, [("Cities", "city", "NNS", "NOUN", "nsubjpass", 2, "Plur"), ("were", "be", "VBD", "AUX", "auxpass", 2, None), ("located", "locate", "VBN", "VERB", "ROOT", 2, None), ("near", "near", "IN", "ADP", "prep", 2, None), ("train", "train", "NN", "NOUN", "compound", 5, "Sing"), ("tracks", "track", "NNS", "NOUN", "pobj", 3, "Plur")]),
    (4, [("that", "that", "WDT", "PRON", "nsubjpass", 3, None), ("are", "be", "VBP", "AUX", "aux", 3, None), ("being", "be", "VBG", "AUX", "auxpass", 3, None), ("referred", "refer", "VBN", "VERB", "ROOT", 3, None), ("to", "to", "IN", "ADP", "prep", 3, None)]),
    (5, [("should", "should", "MD", "AUX", "aux", 2, None), ("be", "be", "VB", "AUX", "auxpass", 2, None), ("offered", "offer", "VBN", "VERB", "ROOT", 2, None), ("outside", "outside", "IN", "ADP", "prep", 2, None), ("of", "of", "IN", "ADP", "prep", 3, None), ("the", "the", "DT", "DET", "det", 6, None), ("classroom", "classroom", "NN", "NOUN", "pobj", 4, "Sing")]),
]



#: Parts of more sentences, each token as text/lemma/tag/pos/dep/head/number: head is a place in the part, V the verb, A the last auxiliary.
SUBJECTS = [
    "", "It/it/PRP/PRON/nsubjpass/V/Sing", "The/the/DT/DET/det/1/ books/book/NNS/NOUN/nsubjpass/V/Plur", "a/a/DT/DET/det/1/ plan/plan/NN/NOUN/nsubjpass/V/Sing", "Oslo/Oslo/NNP/PROPN/nsubjpass/V/Sing",
    "There/there/EX/PRON/expl/V/", "which/which/WDT/PRON/nsubj/A/", "What/what/WP/PRON/dobj/1/ happened/happen/VBD/VERB/csubjpass/V/", "Some/some/DT/DET/det/1/ work/work/NN/NOUN/nsubj/V/Sing to/to/TO/PART/aux/3/ do/do/VB/VERB/relcl/1/",
    "time/time/NN/NOUN/nsubjpass/A/Sing", "Who/who/WP/PRON/nsubjpass/V/",
]
AUXILIARIES = [
    "is/be/VBZ/AUX/auxpass/V/", "were/be/VBD/AUX/auxpass/V/", "has/have/VBZ/AUX/aux/V/ been/be/VBN/AUX/auxpass/V/", "will/will/MD/AUX/aux/V/ be/be/VB/AUX/auxpass/V/", "are/be/VBP/AUX/aux/V/ being/be/VBG/AUX/auxpass/V/",
    "got/get/VBD/AUX/auxpass/V/", "", "May/may/MD/AUX/aux/V/ have/have/VB/AUX/aux/V/ been/be/VBN/AUX/auxpass/V/", "being/be/VBG/AUX/auxpass/V/",
]
VERBS = ["seen/see/VBN/VERB/ROOT/V/", "Made/make/VBD/VERB/ROOT/V/", "give/give/VB/VERB/ROOT/V/", "kept/Keep/VBN/VERB/ROOT/V/"]
ENDINGS = [
    "", "by/by/IN/ADP/agent/V/ us/we/PRP/PRON/pobj/0/Plur", "in/in/IN/ADP/prep/V/ May/May/NNP/PROPN/pobj/0/Sing in/in/IN/ADP/prep/V/ Rome/Rome/NNP/PROPN/pobj/2/Sing", "to/to/TO/PART/aux/1/ work/work/VB/VERB/xcomp/V/ hard/hard/RB/ADV/advmod/1/",
    "On/on/IN/ADP/prep/V/ it/it/PRP/PRON/pobj/0/Sing by/by/IN/ADP/agent/V/ me/I/PRP/PRON/pobj/2/Sing", "to/to/TO/PART/aux/1/ go/go/VB/VERB/xcomp/V/ at/at/IN/ADP/prep/V/ once/once/RB/ADV/pcomp/2/", "By/by/RB/ADV/prep/V/ far/far/RB/ADV/advmod/0/",
    "out/out/RP/ADP/prep/V/ of/of/IN/ADP/prep/0/ the/the/DT/DET/det/3/ way/way/NN/NOUN/pobj/1/Sing by/by/IN/ADP/agent/V/ him/he/PRP/PRON/pobj/4/Sing by/by/IN/ADP/prep/V/ then/then/RB/ADV/pcomp/6/",
    "quite/quite/RB/ADV/advmod/1/ often/often/RB/ADV/advmod/V/", "to/to/TO/PART/aux/1/ stop/stop/VB/VERB/xcomp/V/ and/and/CC/CCONJ/cc/1/ to/to/TO/PART/aux/4/ rest/rest/VB/VERB/xcomp/V/",
]
#: What no rule makes: a subject whose parts lie on both sides of the verb, two tags of one lemma, a tag with no head.
ODD = [
    "A/a/DT/DET/det/1/ man/man/NN/NOUN/nsubjpass/3/Sing was/be/VBD/AUX/auxpass/3/ seen/see/VBN/VERB/ROOT/3/ who/who/WP/PRON/nsubj/5/ sang/sing/VBD/VERB/relcl/1/",
    "Men/man/NNS/NOUN/nsubjpass/2/Plur are/be/VBP/AUX/auxpass/2/ seen/see/VBN/VERB/advcl/6/ who/who/WP/PRON/nsubj/4/ sing/sing/VBP/VERB/relcl/0/ ,/,/,/PUNCT/punct/6/ see/see/VB/VERB/ROOT/6/",
    "Seen/see/VBN/VERB/advcl/3/ ,/,/,/PUNCT/punct/3/ he/he/PRP/PRON/nsubj/3/Sing saw/see/VBD/VERB/ROOT/3/ it/it/PRP/PRON/dobj/3/Sing is/be/VBZ/AUX/auxpass/6/ seen/see/VBN/VERB/conj/3/",
    "Nothing/nothing/NN/NOUN/nsubj/1/Sing ends/end/VBZ/VERB/ROOT/1/",
]
MADE = 44


def _parsed(parts: list[str]) -> list[list]:
    """The tokens of a sentence from its parts (the verb is the third): text, lemma, tag, pos, dep, head, number."""
    given = [[t.split("/") for t in p.split()] for p in parts]
    starts = [sum(map(len, given[:k])) for k in range(len(given))]
    verb, last = starts[2], starts[2] - 1 if given[1] else starts[2]
    place = lambda h, k: {"V": verb, "A": last}.get(h) if not h.isdigit() else starts[k] + int(h)
    return [[*t[:5], place(t[5], k), t[6] or None] for k, p in enumerate(given) for t in p]


def _more_trees() -> list[tuple[int, list[list]]]:
    """Sentences by rule (every subject, chain, verb and ending in turn), and the odd ones."""
    made = [_parsed([SUBJECTS[k % len(SUBJECTS)], AUXILIARIES[(k * 2 + k // 11) % len(AUXILIARIES)], VERBS[k % len(VERBS)], ENDINGS[(k * 3 + k // 10) % len(ENDINGS)]]) for k in range(MADE)]
    odd = [[[*t[:5], int(t[5]), t[6] or None] for t in (x.split("/") for x in s.replace(",/,/,/", "comma/,/,/").split())] for s in ODD]
    return list(enumerate(made + odd, 1))


def _tree_tables() -> dict[str, tuple[str, list[tuple]]]:
    tokens, parse = [], []
    for doc, trees_ in (("T1", TREES), ("T2", _more_trees())):
        for s, ts in trees_:
            verbs = [i for i, t in enumerate(ts) if t[3] == "VERB" and (t[2] in ("VBN", "VBD") or t[4] == "ROOT")]
            tokens += [(doc, s, i + 1, t[0], t[1].upper() if s % 7 == 3 else t[1], "PASSIVE" if i in verbs else "ATTR" if i == 0 else None) for i, t in enumerate(ts)]
            parse += [(doc, s, i, *t) for i, t in enumerate(ts)]
    # tags that meet nothing: a lemma without a head, a sentence without a parse
    tokens += [("T2", 1, 99, "zapped", "zap", "PASSIVE"), ("T2", 999, 1, "seen", "see", "PASSIVE")]
    return {
        "tree_tokens": ("doc_id string, sent_idx int, token_num int, token string, lemma string, asc_tag string", tokens),
        "tree_parse": ("doc_id string, sent_idx int, i int, text string, lemma string, tag string, pos string, dep string, head_i int, number string", parse),
    }


TABLES |= _tree_tables()


def trees(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(TOKENS, PARSE) of all sentences; participles, past forms and root verbs are tagged."""
    return table(spark, "tree_tokens"), table(spark, "tree_parse")
