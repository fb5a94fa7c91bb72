"""PDF files: text, counts, metadata, rewriting and errors."""

from __future__ import annotations

import zlib

import pytest

from velario.operators import codenames
from velario.sources import ooxml, pdf


def page_texts(content):
    return [text for channel, _, _, _, text in pdf.fragments(content) if channel == "page"]


def swap(text):
    return text.replace("Acme Norte", "[Cliente-001]")


def test_values_round_trip():
    value = {"A": [1, -2.5, True, None, pdf.Name("x y"), pdf.Text(b"a(b)\\c\r\n"), pdf.Ref(7)], "B": {"C": pdf.Text(b"")}}
    data = pdf.write_value(value)
    assert pdf.read_value(data, 0) == (value, len(data))
    assert pdf.read_value(rb"(a\(b\)\101\n\
c) <4 1> % note", 0)[0] == b"a(b)A\nc"


def test_text_counts_and_metadata():
    content = pdf.simple_pdf([["Pago a Acme Norte", "señal"], ["otra"], []], {"Title": "Acme Norte €", "Author": "Ana"})
    found = list(pdf.fragments(content))
    assert ("meta:title", None, None, None, "Acme Norte €") in found and ("meta:author", None, None, None, "Ana") in found
    assert page_texts(content) == ["Pago a Acme Norte\nseñal", "otra"] and pdf.counts(content) == (3, 0)


def test_rewrite():
    content = pdf.simple_pdf([["Pago a Acme Norte (hoy)"], ["nada"]], {"Title": "Para Acme Norte", "Author": "Ana", "Producer": "X"})
    done = pdf.rewrite(content, swap)
    texts = [t for *_, t in pdf.fragments(done)]
    assert texts == ["Para [Cliente-001]", "Pago a [Cliente-001] (hoy)", "nada"] and b"Ana" not in done
    assert pdf.rewrite(done, swap) == pdf.rewrite(pdf.rewrite(done, swap), swap)


def build(stream, font=None, extra=None, packed=False):
    objects = {1: {"Type": pdf.Name("Catalog"), "Pages": pdf.Ref(2)}, 2: {"Type": pdf.Name("Pages"), "Kids": [pdf.Ref(5)], "Resources": {"Font": {"F": pdf.Ref(6)}}}, 5: {"Type": pdf.Name("Page"), "Contents": [pdf.Ref(7), pdf.Ref(8)]}}
    objects[6] = font or {"Type": pdf.Name("Font"), "Subtype": pdf.Name("Type1")}
    objects[7], objects[8] = pdf.Stream({}, stream[0]), pdf.Stream({}, stream[1])
    objects |= extra or {}
    if packed:
        moved = {n: v for n, v in objects.items() if not isinstance(v, pdf.Stream)}
        bodies = [pdf.write_value(v) for v in moved.values()]
        heads, at = [], 0
        for n, b in zip(moved, bodies, strict=True):
            heads += [n, at]
            at += len(b) + 1
        head = " ".join(map(str, heads)).encode() + b"\n"
        data = zlib.compress(head + b"\n".join(bodies))
        objects = {n: v for n, v in objects.items() if n not in moved} | {20: pdf.Stream({"Type": pdf.Name("ObjStm"), "N": len(moved), "First": len(head), "Filter": pdf.Name("FlateDecode")}, data)}
    return pdf.written(objects, {"Root": pdf.Ref(1)})


def test_names_over_several_strings():
    """Kerned arrays, strings side by side and contents in two parts; object streams too."""
    parts = (b"BT /F 9 Tf 10 700 Td [(Ac) -20 (me) -300 (Norte)] TJ 0 -12 Td (a Ac) Tj", b"(me No) Tj (rte.) Tj BI /W 1 ID \x00(Acme Norte) Tj EI ET")
    for packed in (False, True):
        content = build(parts, packed=packed)
        assert page_texts(content) == ["Acme Norte\na Acme Norte."]
        assert page_texts(pdf.rewrite(content, swap)) == ["[Cliente-001]\na [Cliente-001]."]


def test_fonts_with_a_table():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <003F> endbfchar 1 beginbfrange <0010> <0029> <0061> <0030> <0030> [<0020>] endbfrange"
    font = {"Type": pdf.Name("Font"), "Subtype": pdf.Name("Type0"), "ToUnicode": pdf.Ref(9)}
    extra = {9: pdf.Stream({"Filter": pdf.Name("FlateDecode")}, zlib.compress(cmap))}
    content = build((b"BT /F 9 Tf <00010012001C00140030001D> Tj ET", b""), font, extra)
    assert page_texts(content) == ["Acme n"]
    assert page_texts(pdf.rewrite(content, lambda t: t.replace("Acme", "zeta7"))) == ["zeta? n"]


def test_notes_forms_and_images():
    extra = {
        10: {"Type": pdf.Name("Annot"), "Contents": pdf.Text(b"nota de Acme Norte"), "A": {"URI": pdf.Text(b"x")}},
        11: pdf.Stream({"Subtype": pdf.Name("Form")}, b"BT (forma Acme Norte) Tj ET"),
        12: pdf.Stream({"Subtype": pdf.Name("Image")}, b"pixels"),
        13: pdf.Stream({"Type": pdf.Name("Metadata")}, b"<x>Acme Norte</x>"),
        2: {"Type": pdf.Name("Pages"), "Kids": [pdf.Ref(5)], "Resources": {"XObject": {"X": pdf.Ref(11), "I": pdf.Ref(12)}}},
    }
    content = build((b"", b""), None, extra)
    assert pdf.counts(content) == (1, 1) and page_texts(content) == ["forma Acme Norte"]
    done = pdf.rewrite(content, swap)
    assert [t for *_, t in pdf.fragments(done)] == ["forma [Cliente-001]", "nota de [Cliente-001]"] and b"Acme" not in done
    scanned = build((b"", b""), None, extra | {11: pdf.Stream({"Subtype": pdf.Name("PS")}, b"")})
    assert ("scan", None, 1, None, "read pixels") in list(pdf.fragments(scanned, lambda images: "read " + images[0].decode()))


def test_errors():
    with pytest.raises(ValueError):
        list(pdf.fragments(b"nothing"))
    with pytest.raises(ValueError):
        list(pdf.fragments(pdf.written({1: {"Type": pdf.Name("Catalog")}}, {"Root": pdf.Ref(1), "Encrypt": {}})))


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf.simple_pdf([["Pago a Acme Norte"]], {"Author": "Ana"}))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    files = ooxml.read_files(spark, str(tmp_path))
    mapping = spark.createDataFrame([("p", "ORG", 0, "Acme Norte", 0, "[Empresa-001]")], codenames.MAPPING)
    done = ooxml.rewrite_files(files, mapping, "p")
    rows = {r["out_name"]: r for r in done.collect()}
    assert set(rows) == {"a.p.pdf", "b.ERROR.txt"} and page_texts(bytes(rows["a.p.pdf"]["content"])) == ["Pago a [Empresa-001]"]
    assert all(r["is_clean"] for r in ooxml.verify_files(files, done, mapping).collect())
    counted = sorted((r["pages"] or 0, r["images"] or 0, r["error"] is None) for r in ooxml.page_counts(files).collect())
    assert counted == [(0, 0, False), (1, 0, True)]
