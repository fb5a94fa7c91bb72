"""Office files, end-to-end plans and streaming waves."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from velario.operators import codenames, ledger
from velario.operators.store import MappingStore, upsert
from velario.plans import pseudonymise
from velario.sources import ooxml
from velario.streaming.waves import FRAGMENTS, stream_waves

LEDGER = [["Informe X"], [], ["Cuenta", "Descripción", "Debe", "Saldo"], ["4300000001", "Global Menta S.L.", 10, 20], ["4300000002", "Acme Norte SA, CIF B12345674", 5, 1], ["4720000", "Hacienda", 1, 1], ["4100000003", "Tropical Frutas", 3.5, 2]]
LISTING = [["Nombre cliente", "CIF", "Importe"], ["CONST. A", "B12345674", "100"], ["CONST. Y", "B12345682", "200"], ["varios", "", "1"]]


def docx(text_runs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p>{"".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in runs)}</w:p>' for runs in text_runs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/comments.xml", f'<w:comments xmlns:w="{w}"><w:comment><w:p><w:r><w:t>Nota de Acme Norte SA</w:t></w:r></w:p></w:comment></w:comments>')
        z.writestr("docProps/core.xml", '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Acme Norte SA</dc:title><dc:creator>Ana</dc:creator></cp:coreProperties>')
    return out.getvalue()


def write_files(folder):
    (folder / "libro.xlsx").write_bytes(ooxml.simple_workbook({"Sumas": LEDGER, "Listado": LISTING}))
    (folder / "nota.docx").write_bytes(docx([["Pago a Acme ", "Norte SA hoy"], ["Firma Carmen Ruiz Gil"]]))
    (folder / "roto.pptx").write_bytes(b"not a zip")


def test_extract(spark, tmp_path):
    write_files(tmp_path)
    files = ooxml.read_files(spark, str(tmp_path))
    rows = ooxml.extract_fragments(files).collect()
    by = {(r["channel"], r["text"]) for r in rows}
    assert ("paragraph", "Pago a Acme Norte SA hoy") in by and ("comment", "Nota de Acme Norte SA") in by and ("meta:title", "Acme Norte SA") in by and ("title", "Sumas") in by
    assert [r["error"] is not None for r in rows if r["path"].endswith("roto.pptx")] == [True]
    cells = ooxml.extract_cells(files)
    layout = ledger.ledger_layout(cells)
    entities = ledger.ledger_entities(ledger.ledger_rows(cells, layout))
    assert {(r["kind"], r["name"]) for r in entities.collect()} == {("CLIENTE", "Global Menta S.L."), ("CLIENTE", "Acme Norte SA"), ("PROVEEDOR", "Tropical Frutas")}
    finding = ledger.ledger_findings(ledger.ledger_rows(cells, layout), entities, layout).first()
    assert (finding["header_row"], finding["rows_scanned"], finding["rows_matched"], finding["mode"]) == (3, 4, 3, "headers")
    assert {r["text"] for r in ledger.named_column_candidates(cells).collect()} == {"CONST. A", "CONST. Y"}
    wanted = spark.createDataFrame([("const. a",), ("const. y",)], "name_lower string")
    got = {r["name_lower"]: r["snippet"] for r in ledger.row_contexts(cells, wanted).collect()}
    assert got == {"const. a": "CONST. A · ···674 · 100", "const. y": "CONST. Y · ···682 · 200"}


def test_content_fallback(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(ooxml.simple_workbook({"H": [["x", "y"], *[[f"43000{i}", f"Cliente numero {'abcdefg'[i]}"] for i in range(7)]]}))
    cells = ooxml.extract_cells(ooxml.read_files(spark, str(tmp_path)))
    row = ledger.ledger_layout(cells).first()
    assert (row["mode"], row["col_account"], row["col_desc"], row["header_row"]) == ("content", 1, 2, 1)


def test_end_to_end(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_files(source)
    store = MappingStore(spark, str(tmp_path / "store"))
    found = pseudonymise.analyse(spark, str(source), store, "paradise")
    types = {r["doctype"] for r in found.types.collect()}
    assert "accounting" in types
    review = {r["canonical"]: r["codename"] for r in found.review.collect()}
    assert review["Global Menta S.L."] == "[Cliente-4300000001]" and review["Carmen Ruiz Gil"] == "[Persona-1]"
    store.save("paradise", upsert(store.load("paradise").drop("updated_at"), codenames.review_to_mapping(found.review, "paradise")))
    done, report = pseudonymise.apply_mapping(found.files, store, "paradise")
    assert all(r["is_clean"] for r in report.collect())
    rows = {r["out_name"]: r for r in done.collect()}
    assert set(rows) == {"libro.paradise.xlsx", "nota.paradise.docx", "roto.ERROR.txt"}
    with zipfile.ZipFile(io.BytesIO(bytes(rows["nota.paradise.docx"]["content"]))) as z:
        text = z.read("word/document.xml").decode() + z.read("docProps/core.xml").decode()
    assert "Acme" not in text and "[Cliente-4300000002]" in text and ">Ana<" not in text
    out = tmp_path / "coded"
    out.mkdir()
    for name, r in rows.items():
        if r["content"] is not None:
            (out / name).write_bytes(bytes(r["content"]))
    back, _ = pseudonymise.apply_mapping(ooxml.read_files(spark, str(out)), store, "paradise", inverse=True)
    again = ooxml.extract_fragments(back.where("error is null").select("doc_id", "path", ooxml.suffix_of(F.col("path")).alias("suffix"), "content"))
    assert {"Global Menta S.L.", "Tropical Frutas"} <= {r["text"] for r in again.collect()}
    assert ooxml.write_zip(done, str(tmp_path / "all.zip")) == 3


def test_waves(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    rows = lambda i, t: spark.createDataFrame([("b", i, 0, 0, "cell", None, None, None, t)], FRAGMENTS)
    run = lambda: stream_waves(spark, str(source), str(tmp_path / "store"), "demo", str(out), str(tmp_path / "cp")).awaitTermination()
    rows(1, "Escribe a ana@uno.es").write.parquet(str(source))
    run()
    rows(2, "Escribe a luis@dos.es y ana@uno.es").write.mode("append").parquet(str(source))
    run()
    got = {r["doc_id"]: r["replaced"] for r in spark.read.parquet(str(out)).collect()}
    assert got == {1: "Escribe a [Email-1]", 2: "Escribe a [Email-2] y [Email-1]"}
