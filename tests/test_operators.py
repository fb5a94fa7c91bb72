"""Operators against golden cases and plain versions."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from velario.operators import cluster, codenames, detect, doctype, occurrence, replace, store


def candidates(spark, rows):
    return spark.createDataFrame(rows, "text string, kind string, count long, source string, account_code string")


def fragments(spark, texts):
    rows = [("b", 1, 0, i, "cell", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "batch_id string, doc_id long, file_ord int, seq long, channel string, text string")


def mapping(spark, rows):
    return spark.createDataFrame([("p", "ORG", 0, o, i, c) for i, (o, c) in enumerate(rows)], codenames.MAPPING)


def plain_replace(text, pairs):
    table = {}
    for o, c in sorted(pairs, key=lambda p: -len(p[0])):
        table[o.lower()] = c
    parts = [(r"\b" if o[0].isalnum() else "") + re.escape(o) + (r"\b" if o[-1].isalnum() else "") for o in sorted({o for o, _ in pairs}, key=lambda o: (-len(o), o))]
    return re.sub("|".join(parts), lambda m: table.get(m[0].lower(), m[0]), text, flags=re.IGNORECASE)


def test_replace_forms_agree(spark):
    rng = random.Random(1)
    names = ["Global Menta", "Global Menta S.L.", "CAIXABANK, SA", "(Acme)", "a.b", "[X]", "Ñandú"]
    pairs = [(n, f"[C-{i}]") for i, n in enumerate(names)]
    texts = ["".join(rng.choice(["global menta", " S.L.", "CAIXABANK, SA", "(acme)", "a.b", "axb", "[x]", "ñandú", "ñandúes", " ", "_", "z"]) for _ in range(12)) for _ in range(60)] + ["", "nothing"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "i int, text string")
    want = {i: plain_replace(t, pairs) for i, t in enumerate(texts)} | {999: None}
    for form in ("native", "trie", "join"):
        got = {r["i"]: r["replaced"] for r in replace.replace_names(rows, mapping(spark, pairs), form=form).collect()}
        assert got == want, form


def test_replace_counts_and_order(spark):
    rows = spark.createDataFrame([(1, "Factura de Global Menta S.L. a CAIXABANK, SA y global menta")], "i int, text string")
    out = replace.replace_names(rows, mapping(spark, [("Global Menta", "Paradise"), ("Global Menta S.L.", "Paradise"), ("CAIXABANK, SA", "[Banco-001]")])).first()
    assert out["replaced"] == "Factura de Paradise a [Banco-001] y Paradise" and out["n_replaced"] == 3


def test_leaks(spark):
    rows = spark.createDataFrame([(1, "Factura de Mercadona pendiente"), (2, "Construcciones varias con alegria y [Z]"), (3, "ACME_2024")], "doc_id long, text string")
    found = replace.find_surviving(rows, mapping(spark, [("Mercadona", "A"), ("CON", "B"), ("ALE", "C"), ("CONSTR", "D"), ("Acme", "E")]))
    assert {(r["doc_id"], r["original"]) for r in found.collect()} == {(1, "Mercadona"), (3, "Acme")}


def test_round_trip(spark):
    m = mapping(spark, [("Global Menta", "Paradise"), ("Global Menta S.L.", "Paradise"), ("Acme", "[Cliente-001]")])
    rows = spark.createDataFrame([(1, "Global Menta S.L. paga a Acme")], "i int, text string")
    coded = replace.replace_names(rows, m).select("i", F.col("replaced").alias("text"))
    assert replace.rehydrate(coded, m).first()["restored"] == "Global Menta S.L. paga a Acme"


def test_detect(spark):
    found = detect.detect_candidates(fragments(spark, ["CIF", "B12345678", "Pago a Global Menta S.L. hoy", "Carmen Ruiz Gil firma", "DISTRIBUCIONES BADIA", "a@b.es", "SALDO INICIAL", None]))
    got = {(r["kind"], r["text"]): r["count"] for r in found.collect()}
    assert got[("CIF", "B12345678")] == 1
    assert ("PER", "Carmen Ruiz Gil") in got and ("ORG", "DISTRIBUCIONES BADIA") in got and ("EMAIL", "a@b.es") in got
    assert ("ORG", "SALDO INICIAL") not in got and any(k == "ORG" and "Global Menta S.L." in t for k, t in got)


def test_model_layer(spark):
    layer = detect.model_layer(lambda texts: [[("Fondo Azul", "FONDO", 0.9), ("x", "FONDO", 0.9), ("Bajo", "FONDO", 0.1)] for _ in texts], "gliner", {"FONDO": "ORG"})
    known = candidates(spark, [("otro", "ORG", 1, "ner", None)])
    got = layer(fragments(spark, ["texto"]), known).collect()
    assert [(r["text"], r["kind"], r["source"]) for r in got] == [("Fondo Azul", "ORG", "gliner:FONDO")]


def test_clusters(spark):
    rows = [("Global Menta S.L.", "ORG", 3, "ner", None), ("GlobalMenta", "ORG", 2, "ner", None), ("Otra Cosa SA", "ORG", 1, "ner", None), ("B12345674", "CIF", 1, "regex", None), ("B12345675", "CIF", 1, "regex", None)]
    got = {(r["kind"], r["canonical"]): (sorted(r["variants"]), r["total_count"]) for r in cluster.cluster_variants(candidates(spark, rows)).collect()}
    assert got[("ORG", "Global Menta S.L.")] == (["Global Menta S.L.", "GlobalMenta"], 5) and ("CIF", "B12345674") in got and ("CIF", "B12345675") in got


def test_short_client_stays(spark):
    rows = [("Azul Marketing SL", "CLIENTE", 5, "column", None), ("Azul", "ORG", 8, "ner", None), ("Marketing SL", "ORG", 1, "ner", None)]
    assert "Azul" in {r["canonical"] for r in cluster.cluster_variants(candidates(spark, rows)).collect()}


def test_person_joins_company(spark):
    rows = [("Global Menta", "ORG", 3, "ner", None), ("GlobalMenta", "PER", 2, "ner", None), ("Ana Ruiz", "PER", 1, "ner", None)]
    got = {(r["kind"], r["canonical"]): r["total_count"] for r in cluster.cluster_variants(candidates(spark, rows)).collect()}
    assert got == {("ORG", "Global Menta"): 5, ("PER", "Ana Ruiz"): 1}


def test_suggestions(spark):
    rows = spark.createDataFrame([(0, "ORG", "Mercadona"), (1, "ORG", "Mercad"), (2, "ORG", "Bricol"), (3, "CIF", "B12345674"), (4, "CIF", "B12345675")], "id long, kind string, name string")
    assert [r["ids"] for r in cluster.suggestion_groups(rows).collect()] == [[0, 1]]
    assert [(r["id_a"], r["id_b"]) for r in cluster.similar_pairs(rows).collect()] == [(0, 1)]


def clusters_of(spark, rows):
    return spark.createDataFrame(rows, cluster.CLUSTER_SCHEMA)


def test_codenames(spark):
    rows = [("ORG", "Clinica Dental Sonrisa S.L.", ["Clinica Dental Sonrisa S.L."], 1, []), ("ORG", "Otra SA", ["Otra SA"], 9, []), ("CLIENTE", "Acme", ["Acme"], 2, ["4300000125"]), ("PER", "Ana Ruiz", ["Ana Ruiz"], 1, [])]
    review = codenames.assign_codenames(clusters_of(spark, rows), mapping(spark, [("ana ruiz", "[Persona-7]")]), "p", main_company="Clinica Dental Sonrisa")
    got = {r["canonical"]: r["codename"] for r in review.collect()}
    assert got == {"Clinica Dental Sonrisa S.L.": "P", "Otra SA": "[Empresa-001]", "Acme": "[Cliente-4300000125]", "Ana Ruiz": "[Persona-7]"}
    missing = {r["canonical"]: r["codename"] for r in codenames.assign_codenames(clusters_of(spark, rows[1:]), None, "paradise", main_company="Sonrisa").collect()}
    assert missing["Sonrisa"] == "Paradise" and missing["Otra SA"] == "[Empresa-001]"
    first = {r["canonical"]: r["codename"] for r in codenames.assign_codenames(clusters_of(spark, rows), None, "deal", mode="sequential").collect()}
    assert first["Otra SA"] == "Deal" and first["Acme"] == "[Cliente-001]" and first["Clinica Dental Sonrisa S.L."] == "[Empresa-001]"


def test_review_edits(spark):
    review = codenames.assign_codenames(clusters_of(spark, [("ORG", "A SA", ["A SA", "A"], 2, []), ("PER", "B C", ["B C"], 1, [])]), None, "p", mode="sequential")
    edits = spark.createDataFrame([(1, False, None, None), (0, None, "Cliente", "[Z]")], "row_id int, anonymise boolean, type string, codename string")
    got = codenames.review_to_mapping(codenames.apply_edits(review, edits), "p").collect()
    assert [(r["kind"], r["original"], r["codename"]) for r in got] == [("CLIENTE", "A SA", "[Z]"), ("CLIENTE", "A", "[Z]")]
    assert codenames.set_anonymise(review, None, ("Persona",)).where("not anonymise").count() == 1


def test_store(spark, tmp_path):
    s = store.MappingStore(spark, str(tmp_path), keep=2)
    assert s.load("p").count() == 0
    for i in range(5):
        s.save("p", mapping(spark, [(f"n{i}", "c")]))
    assert s.versions("p") == [3, 4, 5] and s.load("p").first()["original"] == "n4" and s.projects() == ["p"]
    s.log("p", "run", files=2, leaks=0)
    row = s.audit().first()
    assert (row["action"], row["files"], row["entities"]) == ("run", 2, None)
    merged = store.upsert(s.load("p").drop("updated_at"), mapping(spark, [("n4", "new"), ("n9", "d")]))
    assert {(r["original"], r["codename"]) for r in merged.collect()} == {("n4", "new"), ("n9", "d")}


def test_doctype(spark):
    rows = [(1, "xlsx", 300, 1, [], [], True), (2, "docx", 0, 0, ["spa", "loi"], ["teaser"], True), (3, "pptx", 0, 0, [], [], True), (4, "pdf", 0, 0, [], [], True), (5, "pptx", 0, 0, [], ["teaser"], True)]
    docs = spark.createDataFrame(rows, "doc_id long, suffix string, n_entities int, n_sheets int, legal array<string>, teaser array<string>, readable boolean")
    got = {r["doc_id"]: (r["doctype"], round(r["confidence"], 3)) for r in doctype.guess_doctype(docs).collect()}
    assert got == {1: ("accounting", 1.0), 2: ("legal", 0.7), 3: ("teaser_im", 0.4), 4: ("generic", 0.3), 5: ("teaser_im", 0.6)}


def name_rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def test_name_hits_forms_agree(spark):
    rng = random.Random(3)
    names = ["a", "ab", "aba", "abab", "_x_", "Ñandú", "gru", "grupo", "grupo sur", "\U0001f600b", "ababab"] + [f"grupo {k}" for k in range(40)]
    texts = ["".join(rng.choices(["a", "b", "_x_", " ", "grupo ", "sur", "Ñandú", "\U0001f600", "7", "12"], k=14)) for _ in range(80)] + ["", None, "a", "ab", "ab"]
    want = sorted((i, n, t.count(n)) for i, t in enumerate(texts) if t for n in names if n in t)
    listed = spark.createDataFrame([(n,) for n in names + names[:3] + ["", None]], "name string")
    for form in ("scan", "join"):
        got = occurrence.name_hits(name_rows(spark, texts), listed, "text", "name", ["i"], form)
        assert sorted(map(tuple, got.collect())) == want, form
        assert occurrence.name_hits(name_rows(spark, texts), listed.where("false"), "text", "name", ["i"], form).collect() == []


def test_replace_forms_agree_on_odd_names(spark):
    pairs = [("_abc", "[X]"), ("abc_", "[Y]"), ("-q-", "[Q]"), ("x" * 3000, "[L]"), ("b_c", "[B]")]
    texts = ["x_abc y", "abc_ abc_d _abc", "a-q-b", "x" * 3000 + " " + "x" * 2999, "b_c b_cd ab_c"]
    want = {i: plain_replace(t, pairs) for i, t in enumerate(texts)}
    for form in ("native", "trie", "join"):
        got = {r["i"]: r["replaced"] for r in replace.replace_names(name_rows(spark, texts), mapping(spark, pairs), form=form).collect()}
        assert got == want, form


def test_previous_text_follows_the_files(spark):
    rng = random.Random(5)
    rows, text = [], ""
    want = {}
    for file in range(6):
        for seq in range(rng.choice([1, 3, 40])):
            t = rng.choice([None, "", "CIF:", "x" * rng.randint(1, 20), "ab"])
            want[file, seq] = text[-14:]
            text += (t or "") + "\n"
            rows.append(("b", 100 - file, file, seq, "cell", t))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "batch_id string, doc_id long, file_ord int, seq long, channel string, text string")
    for block in (10_000, 16):
        got = detect.with_previous_text(df, block=block).collect()
        assert len(got) == len(rows)
        assert {(r["file_ord"], r["seq"]): r["before"].lstrip("\n") for r in got} == {k: v.lstrip("\n") for k, v in want.items()}
