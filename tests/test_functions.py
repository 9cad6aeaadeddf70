import pytest
from pyspark.sql import functions as F

from verbaloom.functions import classify, lemmas, normalize
from verbaloom.operators import batches, filters


def column(spark, values, expr, schema="x string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, {schema}")
    return [r[0] for r in rows.orderBy("k").select(expr).collect()]


def test_lemmas(spark):
    cases = {
        "use": ("use", "valid"), "crushedthi": ("crush", "tokenization_error"), "gainedSome": ("gain", "tokenization_error"), "seenmore": ("see", "tokenization_error"),
        "glorifiedTo": ("glorify", "tokenization_error"), "highlightene": ("highlight", "corrected"), "recognise": ("recognize", "corrected"), "chose": ("choose", "corrected"),
        "understand": ("underst", "tokenization_error"), "screen": ("scre", "tokenization_error"), "summarize": ("summ", "tokenization_error"), "do": (None, "filtered"),
        "123verb": (None, "filtered"), None: (None, "filtered"), "": (None, "filtered"), "x" * 25: (None, "filtered"), "x" * 20_000: (None, "filtered"),
    }
    got = column(spark, list(cases), lemmas.validated(F.col("x")))
    assert [tuple(r) for r in got] == list(cases.values())
    lax = column(spark, ["screen", "needed", "crushedthi"], lemmas.validated(F.col("x"), strict=False))
    assert [tuple(r) for r in lax] == [("screen", "valid"), ("needed", "valid"), ("crush", "tokenization_error")]


def test_prepositions_and_patterns(spark):
    cases = {"form": "from", "fro": "from", "amangst": "amongst", "with": "with", "tooin": None, "ie": None, "unknown_prep": "unknown_prep", "toward": "towards", "per": None, "althrough": None, None: None}
    assert column(spark, list(cases), normalize.preposition(F.col("x"))) == list(cases.values())
    cases = {"modal-be,pp_form_NP": "modal-be,pp_from_NP", "pres-be,pp_tooin_NP": None, "past-be,by_NP": "past-be,by_NP", "past-be,by_NP[ENT=PERSON]": "past-be,by_NP", "odd": "odd", "": None, "a,b,c": "a,b,c"}
    assert column(spark, list(cases), normalize.pattern(F.col("x"))) == list(cases.values())


@pytest.mark.parametrize(
    "forms, stems, modal, want",
    [("is", "be", 0, "pres-be"), ("was", "be", 0, "past-be"), ("has been", "have be", 0, "perf-be"), ("will be", "will be", 1, "modal-be"), ("is being", "be be", 0, "prog-be"), ("got", "get", 0, "get-be"), ("'s", "be", 0, "unknown")],
)
def test_tam(spark, forms, stems, modal, want):
    row = spark.range(1).select(classify.tam(F.split(F.lit(forms), " "), F.split(F.lit(stems), " "), F.lit(bool(modal)))).first()
    assert row[0] == want


def test_tam_of_nothing(spark):
    empty, null = F.array().cast("array<string>"), F.lit(None).cast("array<string>")
    row = spark.range(1).select(classify.tam(empty, empty, F.lit(False)), classify.tam(null, null, classify.has_modal(null))).first()
    assert tuple(row) == ("unknown", "unknown")


def test_reasons_are_charged_in_order(spark):
    schema = "subjtype string, subject_text string, surface string, tam string, comp string, pattern string, head_lemma string, n int"
    rows = [
        ("PRON", "it", "it is known that language is complex", "pres-be", "Ø", "p", "know", 1), ("PRON", "it", "it was destroyed by fire", "past-be", "by_NP", "p", "destroy", 1),
        ("DEF_NP", "the book", "the book was written that year", "past-be", "Ø", "p", "write", 1), ("PRON", None, None, "unknown", "Ø", "p", "x", 1), ("PRON", "it", "it to it is known to be", "get-be", "Ø", "p", "x", None),
    ]
    df = spark.createDataFrame(rows, schema)
    assert {r.reason: r.n for r in filters.reason_counts(df).collect()} == {"extraposed_it": 1, "valid": 2, "missing_fields": 1, "invalid_tam": 1}
    assert filters.valid(df).count() == 2 and filters.reason_counts(df.limit(0)).count() == 0


def test_batches(spark):
    df = spark.createDataFrame([(1, "pp_form_NP", "a,pp_form_NP", "use"), (2, "pp_ie_NP", "a,pp_ie_NP", "do"), (3, "Ø", "a,Ø", "chose")], "k int, comp string, pattern string, head_lemma string")
    got = {r.k: (r.comp, r.pattern, r._normalized, r._correction) for r in batches.normalized(df).collect()}
    assert got == {1: ("pp_from_NP", "a,pp_from_NP", True, "form → from"), 3: ("Ø", "a,Ø", None, None)}
    assert {r.k: r.head_lemma for r in batches.validated(df).collect()} == {1: "use", 3: "choose"}
    assert {r.status: (r.n, r.n_lemmas) for r in batches.lemma_counts(df).collect()} == {"valid": (1, 1), "filtered": (1, 1), "corrected": (1, 1)}
    assert {(r.lemma, r.corrected) for r in batches.lemma_corrections(df).collect()} == {("do", None), ("chose", "choose")}
