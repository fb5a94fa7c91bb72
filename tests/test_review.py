"""Model layers, questions, suggested merges, sessions, reports and the command line's edit."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from velario import cli, interactive
from velario.operators import cluster, codenames, detect, models, quality
from velario.operators.store import MappingStore


def fragments(spark, texts):
    rows = [("b", 1, 0, i, "cell", t, "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "batch_id string, doc_id long, file_ord int, seq long, channel string, text string, before string")


def found(rows):
    return {(r["kind"], r["text"]): (r["count"], r["source"]) for r in rows.collect()}


ENTITIES = {
    "uno": [("Ingresos Global Menta", "ORG", 1.0), (" \"Carmen Ruiz\".", "PER", 1.0), ("Calle Mayor 5", "LOC", 1.0), ("Madrid", "LOC", 1.0), ("B12345674", "PER", 1.0), ("Saldo", "ORG", 1.0), ("Carmen", "PER", 1.0), ("123", "ORG", 1.0), ("a@b.es", "PER", 1.0), ("X", "ORG", 1.0)],
    "dos": [("Global Menta", "ORG", 1.0)],
}


def test_tagger_cleans_what_it_tags(spark):
    texts = fragments(spark, ["uno Calle Mayor 5 y Global Menta S.L. fin", "dos Calle Mayor 5", "dos Calle Mayor 5"])
    extract = lambda batch: [ENTITIES[t.split()[0]] for t in batch]
    known = detect.structured_candidates(texts)
    got = found(detect.name_candidates(texts, (), known, models.tagged_names(extract)))
    want = {("ORG", "Global Menta"): (2, "ner"), ("ORG", "Global Menta S.L."): (1, "ner"), ("PER", "Carmen Ruiz"): (1, "ner")}
    # An address that the rules know already is not offered again; without them the tagger gives it.
    assert ("ADDRESS", "Calle Mayor 5") in found(known) and got == want
    assert found(detect.name_candidates(texts, (), None, models.tagged_names(extract)))[("ADDRESS", "Calle Mayor 5")] == (3, "regex")


def test_layers_add_what_is_new(spark, monkeypatch):
    texts = fragments(spark, ["Fondo Norte compra Menta. Ana Gil firma. Fondo Norte paga."])
    answers = [("Fondo Norte", "FONDO", 0.9), ("Banca X", "BANCO", 0.8), ("Ana Gil", "PERSONA", 0.3), ("menta", "MARCA", 0.9), ("Raro", "OTRA", 0.9)]
    layer = detect.model_layer(lambda batch: [answers for _ in batch], "zero-shot", models.lex.MODEL_LABEL_KINDS, 0.5, other_kind="ORG", drop_given_names=False)
    known = spark.createDataFrame([("Menta", "ORG", 1, "ner", None)], "text string, kind string, count long, source string, account_code string")
    assert found(layer(texts, known)) == {("ORG", "Fondo Norte"): (2, "zero-shot:FONDO"), ("BANCO", "Banca X"): (1, "zero-shot:BANCO"), ("ORG", "Raro"): (1, "zero-shot:OTRA")}
    assert [x(texts, known).collect() for x in models.layers(models.Settings(zero_shot=True, service=True))] == [[], []]
    assert models.tagger_extract(models.Settings(tagger=True))(["x"]) == [[]]


def test_settings():
    env = {"VELARIO_ZERO_SHOT": "Yes", "VELARIO_ZERO_SHOT_THRESHOLD": "x", "VELARIO_SERVICE_THRESHOLD": "0.7", "VELARIO_ZERO_SHOT_LABELS": "A, B,", "VELARIO_OCR": "0"}
    s = models.Settings.from_env(env)
    assert (s.zero_shot, s.zero_shot_threshold, s.service_threshold, s.zero_shot_labels, s.ocr) == (True, 0.5, 0.7, ("A", "B"), False)
    assert models.Settings.from_env({}) == models.Settings() and models.ocr_reader(s) is None


def review_table(spark, rows):
    frame = spark.createDataFrame(rows, "kind string, canonical string, variants array<string>, account_codes array<string>, total_count long, codename string")
    return codenames.with_review_columns(frame)


def test_questions(spark):
    review = review_table(spark, [("ORG", "Menta", ["Menta", "Mentas", "Otra"], [], 9, "Paradise"), ("ORG", "Conocida", ["Conocida"], [], 8, "X"), ("ORG", "Fuera", ["Fuera"], [], 7, "Y"), ("PER", "Ana Gil", ["Ana Gil"], [], 6, "[Persona-1]"), ("PER", "Luis", ["Luis"], [], 5, "[Persona-2]"), ("CIF", "B1", ["B1"], [], 4, "[CIF-1]")])
    mapping = spark.createDataFrame([("p", "ORG", 0, "CONOCIDA", 0, "X")], codenames.MAPPING)
    said = iter(["y", "Edén", "n", "y", "y", "n", "n", "1", "CEO", "3", "y", "[CIF-9]"])
    got = {r["canonical"]: r for r in interactive.resolve(review, mapping, "paradise", lambda q, d: next(said), ask_all=True).collect()}
    assert got["Menta"]["codename"] == "Edén" and got["Menta"]["variants"] == ["Menta", "Mentas"]
    assert got["Conocida"]["codename"] == "X" and not got["Fuera"]["anonymise"]
    assert got["Ana Gil"]["codename"] == "[CEO]" and not got["Luis"]["anonymise"] and got["B1"]["codename"] == "[CIF-9]" and next(said, None) is None


def test_suggested_merges(spark):
    review = review_table(spark, [("ORG", "Mercadona", ["Mercadona"], [], 9, "A"), ("ORG", "Mercad", ["Mercad"], [], 2, "B"), ("ORG", "Tropical", ["Tropical"], [], 5, "C"), ("ORG", "Tropica", ["Tropica"], [], 6, "D"), ("CIF", "Mercado", ["Mercado"], [], 1, "E")])
    ids = {r["canonical"]: r["row_id"] for r in review.collect()}
    offered = codenames.merge_suggestions(review)
    assert {(r["canonical"], r["target"]) for r in offered.collect()} == {("Mercadona", "A"), ("Mercad", "A"), ("Tropical", "D"), ("Tropica", "D")}
    names = lambda rows: {r["canonical"]: r["codename"] for r in rows.collect()}
    assert names(codenames.unify(review, offered)) == {"Mercadona": "A", "Mercad": "A", "Tropical": "D", "Tropica": "D", "Mercado": "E"}
    group = {r["canonical"]: r["group"] for r in offered.collect()}
    choices = spark.createDataFrame([(ids["Mercad"], None), (ids["Tropical"], group["Mercadona"])], "row_id long, group long")
    targets = spark.createDataFrame([(group["Mercadona"], " Z "), (group["Tropica"], "")], "group long, codename string")
    assert names(codenames.unify(review, offered, choices, targets)) == {"Mercadona": "Z", "Mercad": "B", "Tropical": "Z", "Tropica": "D", "Mercado": "E"}


def test_persons_join_one_after_the_other(spark):
    rows = [("ORG", "abcdefghij", ["abcdefghij"], 5), ("ORG", "abcdefghijk", ["abcdefghijk"], 1), ("PER", "abcdefghijx", ["abcdefghijx"], 3), ("PER", "Ana Gil", ["Ana Gil"], 1)]
    frame = spark.createDataFrame([(k, c, v, n, []) for k, c, v, n in rows], cluster.CLUSTER_SCHEMA)
    got = {(r["kind"], r["canonical"]): (r["variants"], r["total_count"]) for r in cluster.merge_persons(frame).collect()}
    # Both companies are near enough: the first in cluster order, the longer name, takes the person.
    assert got == {("ORG", "abcdefghij"): (["abcdefghij"], 5), ("ORG", "abcdefghijk"): (["abcdefghijk", "abcdefghijx"], 4), ("PER", "Ana Gil"): (["Ana Gil"], 1)}
    chain = [("ORG", "abcdefghij", ["abcdefghij"], 5), ("PER", "abcdefghijkl", ["abcdefghijkl"], 3), ("PER", "abcdefghkl", ["abcdefghkl"], 2), ("PER", "bcdefghkl", ["bcdefghkl"], 1)]
    frame = spark.createDataFrame([(k, c, v, n, []) for k, c, v, n in chain], cluster.CLUSTER_SCHEMA)
    got = {(r["kind"], r["canonical"]): (r["variants"], r["total_count"]) for r in cluster.merge_persons(frame).collect()}
    assert got == {("ORG", "abcdefghij"): (["abcdefghij", "abcdefghijkl", "abcdefghkl", "bcdefghkl"], 11)}


def test_sessions_and_reports(spark, tmp_path):
    store = MappingStore(spark, str(tmp_path / "store"))
    review = review_table(spark, [("ORG", "Menta", ["Menta"], [], 9, "A")])
    assert store.load_session("p") is None
    store.save_session("p", review)
    store.save_session("p", store.load_session("p").withColumn("codename", F.lit("B")))
    assert store.load_session("p").first()["codename"] == "B"
    store.clear_session("p")
    assert store.load_session("p") is None
    truth = spark.createDataFrame([(1, "Ana"), (1, "Menta"), (2, "Luis")], "doc_id long, name string")
    base = spark.createDataFrame([(1, "Ana"), (2, "zzz")], "doc_id long, text string")
    more = spark.createDataFrame([(1, "Ana"), (1, "Menta"), (2, "zzz")], "doc_id long, text string")
    rows = quality.compare_detectors(truth, base, more)
    assert {(r["doc_id"], r["base_hits"], r["more_hits"], r["gain"], r["advice"]) for r in rows.collect()} == {(1, 1, 2, 1, "use"), (2, 0, 0, 0, "skip")}
    totals = quality.write_report(rows, str(tmp_path / "report")).first()
    assert totals["documents"] == 2 and totals["more_hits"] == 2
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report/markdown")).collect())
    assert text.startswith("| documents | truth |") and spark.read.option("header", True).csv(str(tmp_path / "report/csv")).count() == 2


def test_edit(spark, tmp_path):
    store = MappingStore(spark, str(tmp_path / "store"))
    store.save("demo", spark.createDataFrame([("demo", "ORG", 0, "Menta", 0, "A"), ("demo", "PER", 1, "Ana", 0, "B")], codenames.MAPPING))
    script = tmp_path / "editor.py"
    script.write_text("import json, sys\np = sys.argv[1]\nd = json.load(open(p))\nd['entries']['ORG']['Nueva'] = 'N'\njson.dump(d, open(p, 'w'))\n")
    args = argparse.Namespace(store=str(tmp_path / "store"), project="demo", editor=f"python {script}")
    assert cli.edit(spark, args) == 0
    got = {(r["kind"], r["original"]): r["codename"] for r in store.load("demo").collect()}
    assert got == {("ORG", "Menta"): "A", ("ORG", "Nueva"): "N", ("PER", "Ana"): "B"} and store.versions("demo") == [1, 2]
    script.write_text("")
    assert cli.edit(spark, args) == 0 and store.versions("demo") == [1, 2]
