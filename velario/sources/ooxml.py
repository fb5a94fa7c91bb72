"""Office documents (xlsx, xlsm, docx, pptx) from and to ``binaryFile`` rows, by zip and XML parts.

One file is one row of ``binaryFile`` and is parsed where it lies; a file's cells or fragments leave
the task row by row. Every text channel is read, those included that a rewriter changes: cells,
titles, comments, links, validations, headers, footers, notes and properties. No row, page or
length limits unless options set them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velario.sources import pdf

OFFICE = ("xlsx", "xlsm", "docx", "pptx")
#: Properties that name a person, and properties that hold text; fixed values.
IDENTITY_PROPS = ("creator", "lastModifiedBy")
TEXT_PROPS = ("title", "subject", "keywords", "description", "category")

CELLS = "doc_id long, sheet_ord int, sheet string, row int, col int, vtype string, value string"
FRAGMENTS = "doc_id long, path string, seq long, channel string, sheet string, row int, col int, text string, error string"


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def read_files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(doc_id, path, suffix, length, content) of the files of a path, list or glob."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    rows = reader.load(path)
    return rows.select(F.abs(F.xxhash64("path")).alias("doc_id"), "path", suffix_of(F.col("path")).alias("suffix"), "length", "content")


def _tag(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _texts(element: ET.Element, name: str = "t") -> str:
    return "".join(e.text or "" for e in element.iter() if _tag(e) == name)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _parts(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [n for n in z.namelist() if re.fullmatch(pattern, n)]
    return sorted(found, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])


def properties(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    if "docProps/core.xml" in z.namelist():
        for e in ET.fromstring(z.read("docProps/core.xml")):
            if _tag(e) in IDENTITY_PROPS + TEXT_PROPS and (e.text or "").strip():
                yield f"meta:{_tag(e)}", e.text.strip()


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(title, part) of the sheets in workbook order."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in z.namelist() else {}
    out = []
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter():
        if _tag(s) == "sheet":
            rel = next((v for k, v in s.attrib.items() if k.endswith("}id")), None)
            target = targets.get(rel, "").lstrip("/")
            out.append((s.get("name", ""), target if target.startswith("xl/") else f"xl/{target}"))
    return out


def workbook_cells(content: bytes) -> Iterator[tuple[int, str, int, int, str, str]]:
    """(sheet_ord, sheet, row, col, vtype, value): s text, n number, b boolean, f formula text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_texts(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        for order, (title, part) in enumerate(_sheets(z)):
            if part not in z.namelist():
                continue
            with z.open(part) as f:
                row = 0
                for _, e in ET.iterparse(f):
                    if _tag(e) != "row":
                        continue
                    row = int(e.get("r") or row + 1)
                    col = 0
                    for c in e:
                        col = _column(c.get("r")) if c.get("r") else col + 1
                        kind, value = c.get("t", "n"), next((x.text for x in c if _tag(x) == "v"), None)
                        formula = next((x for x in c if _tag(x) == "f"), None)
                        if kind == "s" and value is not None:
                            yield order, title, row, col, "s", shared[int(value)]
                        elif kind == "inlineStr":
                            yield order, title, row, col, "s", _texts(c)
                        elif value is not None:
                            yield order, title, row, col, {"str": "s", "b": "b", "e": "e"}.get(kind, "n"), value
                        elif formula is not None and formula.text:
                            yield order, title, row, col, "f", f"={formula.text}"
                    e.clear()


def _workbook_fragments(content: bytes, z: zipfile.ZipFile) -> Iterator[tuple]:
    seen = None
    for _, title, row, col, kind, value in workbook_cells(content):
        if title != seen:
            seen = title
            yield "title", title, None, None, title
        if kind == "s" and value.strip():
            yield "cell", title, row, col, value.strip()
    for part in _parts(z, r"xl/comments\d*\.xml"):
        for c in ET.fromstring(z.read(part)).iter():
            if _tag(c) == "comment" and _texts(c).strip():
                yield "comment", None, None, None, _texts(c).strip()
    for part in _parts(z, r"xl/worksheets/sheet\d+\.xml"):
        for e in ET.fromstring(z.read(part)).iter():
            if _tag(e) in ("formula1", "formula2") and e.text and not e.text.startswith("$"):
                yield "validation", None, None, None, e.text.strip('"')
            elif _tag(e) in ("oddHeader", "oddFooter", "evenHeader", "evenFooter") and (e.text or "").strip():
                yield "header", None, None, None, e.text.strip()
    yield from _links(z, r"xl/worksheets/_rels/.*\.rels")
    for part in _parts(z, r"xl/charts/chart\d*\.xml"):
        for e in ET.fromstring(z.read(part)).iter():
            if _tag(e) == "title" and _texts(e).strip():
                yield "chart", None, None, None, _texts(e).strip()


def _links(z: zipfile.ZipFile, pattern: str) -> Iterator[tuple]:
    for part in _parts(z, pattern):
        for r in ET.fromstring(z.read(part)):
            if r.get("TargetMode") == "External" and r.get("Target"):
                yield "link", None, None, None, r.get("Target")


def _paragraphs(z: zipfile.ZipFile, part: str, channel: str) -> Iterator[tuple]:
    for p in ET.fromstring(z.read(part)).iter():
        if _tag(p) == "p" and (text := _texts(p).strip()):
            yield channel, None, None, None, text


def _word_fragments(z: zipfile.ZipFile) -> Iterator[tuple]:
    for pattern, channel in ((r"word/document\.xml", "paragraph"), (r"word/(header|footer)\d*\.xml", "header"), (r"word/comments\.xml", "comment"), (r"word/(footnotes|endnotes)\.xml", "note")):
        for part in _parts(z, pattern):
            yield from _paragraphs(z, part, channel)
    yield from _links(z, r"word/_rels/.*\.rels")


def _slide_fragments(z: zipfile.ZipFile) -> Iterator[tuple]:
    for pattern, channel in ((r"ppt/slides/slide\d+\.xml", "slide"), (r"ppt/notesSlides/notesSlide\d+\.xml", "note")):
        for part in _parts(z, pattern):
            yield from _paragraphs(z, part, channel)
    yield from _links(z, r"ppt/slides/_rels/.*\.rels")


def fragments_of(suffix: str, content: bytes, ocr: Callable[[list[bytes]], str] | None = None) -> Iterator[tuple]:
    """(channel, sheet, row, col, text) of one file; ``ocr`` reads the images of PDF pages without text."""
    if suffix == "pdf":
        yield from pdf.fragments(content, ocr)
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for channel, text in properties(z):
            yield channel, None, None, None, text
        if suffix in ("xlsx", "xlsm"):
            yield from _workbook_fragments(content, z)
        elif suffix == "docx":
            yield from _word_fragments(z)
        elif suffix == "pptx":
            yield from _slide_fragments(z)
        else:
            raise ValueError(f"no reader for {suffix!r}")


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def extract_fragments(files: DataFrame, rows_per_frame: int = 20_000, ocr: Callable[[list[bytes]], str] | None = None) -> DataFrame:
    """FRAGMENTS of office files; a file that can't be read gives one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for doc_id, path, suffix, content in zip(frame["doc_id"], frame["path"], frame["suffix"], frame["content"], strict=True):
                try:
                    for seq, (channel, sheet, row, col, text) in enumerate(fragments_of(suffix, bytes(content), ocr)):
                        out.append((doc_id, path, seq, channel, sheet, row, col, text, None))
                        if len(out) >= rows_per_frame:
                            yield _frame(out, FRAGMENTS)
                            out = []
                except Exception as e:  # one broken file is a row, not a failed job
                    out.append((doc_id, path, -1, "error", None, None, None, None, f"{type(e).__name__}: {e}"))
            yield _frame(out, FRAGMENTS)

    return files.select("doc_id", "path", "suffix", "content").mapInPandas(run, FRAGMENTS)


def extract_cells(files: DataFrame, rows_per_frame: int = 20_000) -> DataFrame:
    """CELLS of workbooks, read once for all ledger operators; unreadable files give no cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                try:
                    for cell in workbook_cells(bytes(content)):
                        out.append((doc_id, *cell))
                        if len(out) >= rows_per_frame:
                            yield _frame(out, CELLS)
                            out = []
                except Exception:  # extract_fragments reports the file
                    continue
            yield _frame(out, CELLS)

    books = files.where(F.col("suffix").isin("xlsx", "xlsm"))
    return books.select("doc_id", "content").mapInPandas(run, CELLS)


def page_counts(files: DataFrame) -> DataFrame:
    """(doc_id, pages, images, error) of the PDF files: images may hold names that no rewriter reaches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                try:
                    out.append((doc_id, *pdf.counts(bytes(content)), None))
                except Exception as e:  # the file's row carries its error
                    out.append((doc_id, None, None, f"{type(e).__name__}: {e}"))
            yield _frame(out, "doc_id long, pages long, images long, error string")

    return files.where("suffix = 'pdf'").select("doc_id", "content").mapInPandas(run, "doc_id long, pages long, images long, error string")


#: Elements whose text a rewriter changes, by part; fixed values.
_TEXT_PARTS = (
    (r"xl/sharedStrings\.xml|xl/worksheets/sheet\d+\.xml|xl/comments\d*\.xml|xl/charts/chart\d*\.xml", ("si", "is", "comment", "title", "oddHeader", "oddFooter", "evenHeader", "evenFooter", "formula1", "formula2")),
    (r"word/(document|header\d*|footer\d*|comments|footnotes|endnotes)\.xml", ("p",)),
    (r"ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml", ("p",)),
)


def _rewrite_block(block: ET.Element, change: Callable[[str], str]) -> None:
    """Each run by itself; the whole text in the first run where a name spans several runs."""
    runs = [e for e in block.iter() if _tag(e) == "t"] or ([block] if block.text and not len(block) else [])
    before = [e.text or "" for e in runs]
    if not any(before):
        return
    whole = change("".join(before))
    single = [change(t) for t in before]
    if "".join(single) == whole:
        for e, t in zip(runs, single, strict=True):
            e.text = t
    else:
        for e in runs:
            e.text = ""
        runs[0].text = whole


def rewrite(suffix: str, content: bytes, change: Callable[[str], str]) -> bytes:
    """The file with ``change`` applied to every text channel and its authors cleared."""
    if suffix == "pdf":
        return pdf.rewrite(content, change)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in z.namelist():
            data = z.read(name)
            blocks = next((tags for pattern, tags in _TEXT_PARTS if re.fullmatch(pattern, name)), None)
            if blocks or name == "docProps/core.xml" or name == "xl/workbook.xml" or name.endswith(".rels"):
                for prefix, uri in re.findall(rb'xmlns:?(\w*)="([^"]*)"', data):
                    if not re.fullmatch(rb"ns\d+", prefix):
                        ET.register_namespace(prefix.decode(), uri.decode())
                root = ET.fromstring(data)
                for e in root.iter():
                    tag = _tag(e)
                    if blocks and tag in blocks:
                        _rewrite_block(e, change)
                    elif name == "docProps/core.xml" and tag in IDENTITY_PROPS:
                        e.text = ""
                    elif name == "docProps/core.xml" and tag in TEXT_PROPS and e.text:
                        e.text = change(e.text)
                    elif name == "xl/workbook.xml" and tag == "sheet":
                        e.set("name", re.sub(r"[\[\]:*?/\\]", "", change(e.get("name", "")))[:31])
                    elif name.endswith(".rels") and e.get("TargetMode") == "External":
                        e.set("Target", change(e.get("Target", "")))
                data = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
            new.writestr(name, data)
    return out.getvalue()


def rewrite_files(files: DataFrame, mapping: DataFrame, suffix: str) -> DataFrame:
    """(doc_id, path, out_name, content, error) of each office file rewritten with the mapping.

    The mapping of one project is shared with tasks; its size is checked first.
    """
    from velario.operators.replace import SHARED_CHARS, substitute, trie_pattern, unique_names
    from velario.operators.store import error_name, output_name

    names = unique_names(mapping)
    chars = names.agg(F.coalesce(F.sum(F.length("low") + F.length("codename")), F.lit(0)).alias("n")).first()["n"]
    if chars > SHARED_CHARS:
        raise ValueError(f"the mapping has {chars} characters; rewrite files by project with at most {SHARED_CHARS}")
    shared = files.sparkSession.sparkContext.broadcast([(r["low"], r["codename"]) for r in names.collect()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = dict(shared.value)
        pattern = re.compile(trie_pattern(list(table)), re.IGNORECASE)
        for frame in frames:
            out = []
            for doc_id, path, kind, content in zip(frame["doc_id"], frame["path"], frame["suffix"], frame["content"], strict=True):
                try:
                    out.append((doc_id, path, rewrite(kind, bytes(content), lambda t: substitute(t, pattern, table)[0]), None))
                except Exception as e:  # the file's row carries its error
                    out.append((doc_id, path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "path", "content", "error"], dtype=object)

    done = files.select("doc_id", "path", "suffix", "content").mapInPandas(run, "doc_id long, path string, content binary, error string")
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    return done.withColumn("out_name", F.when(F.col("error").isNull(), output_name(base, suffix)).otherwise(error_name(base)))


def verify_files(files: DataFrame, rewritten: DataFrame, mapping: DataFrame) -> DataFrame:
    """The verification report of rewritten files, each read again through the same readers."""
    from velario.operators.replace import verify_report

    again = rewritten.where("error is null").join(files.select("doc_id", "suffix", "length"), "doc_id")
    texts = extract_fragments(again.select("doc_id", "path", "suffix", "content"))
    return verify_report(again.select("doc_id", "length"), texts.select("doc_id", "text"), mapping)


def write_zip(rewritten: DataFrame, path: str) -> int:
    """One zip of a reviewed batch on the driver's disk, file by file; returns the number of entries."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in rewritten.select("out_name", "content", "error").toLocalIterator():
            z.writestr(r["out_name"], bytes(r["content"]) if r["content"] is not None else r["error"])
            n += 1
    return n


def simple_workbook(sheets: dict[str, list[list]]) -> bytes:
    """A small xlsx with inline strings and numbers, for tests and exports."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheets)
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r}">' + "".join(_cell(v, r, c) for c, v in enumerate(row, 1) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _cell(value, row: int, col: int) -> str:
    letters, n = "", col
    while n:
        n, rest = divmod(n - 1, 26)
        letters = chr(65 + rest) + letters
    if isinstance(value, int | float):
        return f'<c r="{letters}{row}"><v>{value}</v></c>'
    return f'<c r="{letters}{row}" t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'
