"""The command line from files to rewritten files and back."""

from __future__ import annotations

from velario import cli
from velario.operators.store import MappingStore
from velario.sources import ooxml, pdf

ROWS = [["Cuenta", "Descripción", "Debe"], ["4300000001", "Mercadona Norte SA", 10], ["4300000002", "Tropical Frutas", 5]]


def texts(path):
    return [t for *_, t in ooxml.fragments_of(path.suffix[1:], path.read_bytes())]


def test_run_resume_and_rehydrate(spark, tmp_path, capsys):
    source, out, store = tmp_path / "in", tmp_path / "out", str(tmp_path / "store")
    source.mkdir()
    (source / "libro.xlsx").write_bytes(ooxml.simple_workbook({"Sumas": ROWS}))
    (source / "nota.pdf").write_bytes(pdf.simple_pdf([["Pago a Tropical Frutas por ana@uno.es", "Aviso de MERCADONA NORTE SA"]]))
    (source / "carta.docx.bak").write_bytes(b"x")
    files = [str(source / "libro.xlsx"), str(source / "nota.pdf")]
    assert cli.main(["run", "demo", *files, "--store", store, "--out", str(out), "--dry-run"]) == 0
    kept = MappingStore(spark, store)
    assert kept.load_session("demo") is not None and kept.versions("demo") == []
    assert cli.main(["run", "demo", *files, "--store", store, "--out", str(out), "--resume", "--unify"]) == 0
    assert kept.load_session("demo") is None and kept.versions("demo") == [1]
    said = " ".join(texts(out / "libro.demo.xlsx") + texts(out / "nota.demo.pdf"))
    assert "[Cliente-4300000002]" in said and "[Email-1]" in said and not any(n in said.lower() for n in ("tropical", "mercadona", "ana@uno"))
    back = tmp_path / "back"
    assert cli.main(["rehydrate", "demo", str(out / "nota.demo.pdf"), "--store", store, "--out", str(back)]) == 0
    (again,) = back.iterdir()
    assert "Tropical Frutas por ana@uno.es" in " ".join(texts(again))
    cli.main(["list", "--store", store])
    assert "demo" in capsys.readouterr().out
