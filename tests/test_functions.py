"""Golden vectors of the column functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from velario.functions import identifiers as ids
from velario.functions import lexicon as lex
from velario.functions import names
from velario.functions.similarity import NameBlock, indel_ratio, indel_ratio_py, may_be_same_names


def apply(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_checksums(spark):
    assert apply(spark, ["12345678Z", "X1234567L", "12345678A", "bad", None], ids.valid_nif) == [True, True, False, False, False]
    assert apply(spark, ["B12345674", "B12345678", "K1234567", None], ids.valid_cif) == [True, False, False, False]
    good = "ES9121000418450200051332"
    assert apply(spark, [good, "ES91 2100 0418 4502 0005 1332", "ES91-2100-0418-4502-0005-1332", "ES0021000418450200051332", ""], ids.valid_iban) == [True, True, True, False, False]


def test_keep_rule(spark):
    texts = ["Referencia interna 12345678A del pedido", "NIF: 12345678A del titular"]
    kept = lambda c: F.transform(F.filter(ids.matches_with_context(c, ids.NIF), lambda m: ids.keep_id("NIF", m["value"], m["context"])), lambda m: m["value"])
    assert apply(spark, texts, kept) == [[], ["12345678A"]]
    before = lambda c: F.size(F.filter(ids.matches_with_context(c, ids.NIF, F.lit("NIF\n")), lambda m: ids.keep_id("NIF", m["value"], m["context"])))
    assert apply(spark, ["12345678A"], before) == [1]


def test_unicode_boundaries(spark):
    assert apply(spark, ["ñB12345674", "x B12345674"], lambda c: ids.find_all(c, ids.CIF)) == [[], ["B12345674"]]
    assert apply(spark, ["+34 612 345 678"], lambda c: ids.find_all(c, ids.PHONE)) == [["34 612 345 678"]]
    assert apply(spark, ["Vive en Calle Mayor, 12 hoy", "calle mayor 12"], lambda c: ids.find_all(c, ids.ADDRESS)) == [["Calle Mayor, 12"], []]


def test_redact(spark):
    assert apply(spark, ["B12345674", "ES91 2100 0418 4502 0005 1332", "Acme"], ids.redact_id) == ["···674", "ES··1332", "Acme"]


def test_normalise(spark):
    assert apply(spark, ["Global Menta S.L.", "GlobalMenta", "Ingresos Tropical Frutas, S.L.", "ACME,SA"], names.normalize_org) == ["globalmenta", "globalmenta", "tropicalfrutas,", "acme"]
    assert apply(spark, ["  Ana   Ruiz "], names.normalize_person) == ["ana ruiz"]


def test_filters(spark):
    assert apply(spark, ["Factura 12", "FAC-PRE25-00761", "Empresa 2024", "Acme 12345", ""], names.is_document_ref) == [True, True, False, True, False]
    assert apply(spark, ["=A1", "A10", "A1+B2", "Hoja!$A:$A", "Acme", "x", "((", None], names.is_artefact) == [True, True, True, True, False, True, True, True]
    assert apply(spark, ["B12345674", "=SUM(A1)", "IF(A1,2", "Acme"], names.is_formula_cell) == [False, True, True, False]
    assert apply(spark, ["Carmen", "Carmen Ruiz"], names.is_lone_given_name) == [True, False]
    assert len(lex.STOPWORDS) > 190 and "enero-enero" in lex.STOPWORDS and "apertura-dic" in lex.STOPWORDS


def test_headings(spark):
    assert apply(spark, ["Nombre de contacto", "Nombre", "Nombre cliente", "Código cliente", "Razón social", None], names.name_head_kind) == [None, None, "CLIENTE", None, "ORG", None]


def test_accounts(spark):
    assert apply(spark, ["4300000125", "4720", "572", "6230001", "", None], names.classify_account) == ["CLIENTE", None, "BANCO", None, None, None]
    assert apply(spark, ["4300000125", "430", "43012345"], lambda c: names.account_codename(F.lit("CLIENTE"), c, "short")) == ["[Cliente-125]", "[Cliente-430]", "[Cliente-12345]"]
    assert apply(spark, [7, 1234], lambda c: names.placeholder(F.lit("CLIENTE"), c), "int") == ["[Cliente-007]", "[Cliente-1234]"]
    assert apply(spark, ["Acme SL (CIF: B12345674)", "Acme SL, B12345674", "Servicios profesionales Acme"], lambda c: names.clean_description(F.lit("CLIENTE"), c)) == ["Acme SL", "Acme SL", "Acme"]
    assert apply(spark, ["Anticipo Ana Ruiz"], lambda c: names.clean_description(F.lit("PERSONA"), c)) == ["Ana Ruiz"]


@pytest.mark.parametrize(("a", "b", "want"), [("mercadonasa", "mercadnoasa", 90.909), ("bricol", "oriol", 72.727), ("", "", 100.0), ("a", "", 0.0)])
def test_indel(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(indel_ratio(F.col("a"), F.col("b")).alias("r")).first()
    assert row["r"] == pytest.approx(want, abs=1e-3) and indel_ratio_py(a, b) == pytest.approx(want, abs=1e-3)


def test_indel_random(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abcñ ", k=rng.randint(0, 9))), "".join(rng.choices("abcñ ", k=rng.randint(0, 9)))) for _ in range(60)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r["r"] == pytest.approx(indel_ratio_py(r["a"], r["b"])) for r in rows)


def test_same_entity(spark):
    pairs = [("Mercadona", "Mercad", True), ("Mercadona SA", "Mercadnoa SA", True), ("BRICOL", "ORIOL", False), ("CONST", "CONAST", False), ("Acme", "Acme", False)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, want boolean")
    assert all(r["ok"] == r["want"] for r in rows.select("want", may_be_same_names(F.col("a"), F.col("b")).alias("ok")).collect())


def test_blocks_of_names_compare_alike():
    rng = random.Random(11)
    names = ["".join(rng.choices("abcñ ", k=rng.choice([0, 1, 5, 12, 63, 64, 80]))) for _ in range(60)]
    block = NameBlock(names)
    for name in names + ["zzz", "", "ab" * 50]:
        assert block.ratios(name).tolist() == pytest.approx([indel_ratio_py(name, n) for n in names])
    assert NameBlock([]).ratios("abc").tolist() == []
