"""PDF files read and rewritten without a PDF library.

Objects are found by scanning the file, object streams are unpacked, and the shown text of every
page and form is decoded through its fonts. Rewriting changes the text where it is shown, clears the
authors and the XMP packet, and writes all objects anew; the verification reads the result again, so
text that this reader can't see is reported and never taken for clean. Encrypted files and filters
other than Flate are errors of the file's row. Pages without text give their images to ``ocr``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

_SPACE, _DELIMITERS = b" \t\r\n\x0c\x00", b"()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REFERENCE = re.compile(rb"(\d+)\s+(\d+)\s+R(?![A-Za-z])")
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
#: Keys of an information dictionary that hold text, and those that name people and programs.
TEXT_KEYS, IDENTITY_KEYS = ("Title", "Subject", "Keywords"), ("Author", "Creator", "Producer")
#: Keys elsewhere whose strings a reader shows or follows.
SHOWN_KEYS = ("Title", "Contents", "T", "TU", "V", "DV", "URI", "Subj", "Alt", "ActualText")


class Name(str):
    """A PDF name, without its slash."""


class Text(bytes):
    """A PDF string."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    data: bytes


def _skip(data: bytes, i: int) -> int:
    while i < len(data):
        if data[i] in _SPACE:
            i += 1
        elif data[i] == 37:  # a comment
            while i < len(data) and data[i] not in b"\r\n":
                i += 1
        else:
            break
    return i


def _literal(data: bytes, i: int) -> tuple[Text, int]:
    out, depth = bytearray(), 1
    while i < len(data):
        c = data[i]
        i += 1
        if c == 92:
            if i >= len(data):
                break
            c = data[i]
            i += 1
            if c in b"01234567":
                digits = re.compile(rb"[0-7]{1,3}").match(data, i - 1)[0]
                out.append(int(digits, 8) & 255)
                i += len(digits) - 1
            elif c == 13:
                i += data[i : i + 1] == b"\n"
            elif c != 10:
                out.append(_ESCAPES.get(c, c))
            continue
        depth += (c == 40) - (c == 41)
        if not depth:
            break
        out.append(c)
    return Text(out), i


def read_value(data: bytes, i: int) -> tuple[object, int]:
    """The value at ``i`` and where it ends; a word that is no value comes as bytes (an operator)."""
    i = _skip(data, i)
    if i >= len(data):
        return b"", i
    if data.startswith(b"<<", i):
        out: dict = {}
        i = _skip(data, i + 2)
        while i < len(data) and not data.startswith(b">>", i):
            key, i = read_value(data, i)
            value, i = read_value(data, i)
            if isinstance(key, Name):
                out[key] = value
            i = _skip(data, i)
        return out, i + 2
    c = data[i : i + 1]
    if c == b"(":
        return _literal(data, i + 1)
    if c == b"<":
        end = data.find(b">", i)
        end = len(data) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[i + 1 : end])
        return Text(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())), end + 1
    if c == b"[":
        items = []
        i = _skip(data, i + 1)
        while i < len(data) and data[i] != 93:
            value, i = read_value(data, i)
            items.append(value)
            i = _skip(data, i)
        return items, i + 1
    if c == b"/":
        j = i + 1
        while j < len(data) and data[j] not in _SPACE + _DELIMITERS:
            j += 1
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data[i + 1 : j]).decode("latin-1")), j
    ref = _REFERENCE.match(data, i)
    if ref:
        return Ref(int(ref[1])), ref.end()
    number = _NUMBER.match(data, i)
    if number:
        return (float(number[0]) if b"." in number[0] else int(number[0])), number.end()
    j = i + 1
    while j < len(data) and data[j] not in _SPACE + _DELIMITERS:
        j += 1
    word = data[i:j]
    return {b"true": True, b"false": False, b"null": None}.get(word, word), j


def write_value(value: object) -> bytes:
    if isinstance(value, Name):
        return b"/" + re.sub(rb"[^!-~]|[()<>\[\]{}/%#]", lambda m: b"#%02X" % m[0][0], value.encode("latin-1", "replace"))
    if isinstance(value, bytes):
        return b"(" + re.sub(rb"[()\\]", lambda m: b"\\" + m[0], value).replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"
    if isinstance(value, Ref):
        return b"%d 0 R" % value.number
    if isinstance(value, dict):
        return b"<<" + b" ".join(write_value(Name(k)) + b" " + write_value(v) for k, v in value.items()) + b">>"
    if isinstance(value, list):
        return b"[" + b" ".join(map(write_value, value)) + b"]"
    if isinstance(value, bool) or value is None:
        return {True: b"true", False: b"false", None: b"null"}[value]
    return (f"{value:.6f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)).encode()


def decode_text(value: bytes) -> str:
    return value[2:].decode("utf-16-be", "replace") if value.startswith(b"\xfe\xff") else value.decode("latin-1")


def encode_text(text: str) -> Text:
    try:
        return Text(text.encode("latin-1"))
    except UnicodeEncodeError:
        return Text(b"\xfe\xff" + text.encode("utf-16-be"))


class Document:
    def __init__(self, content: bytes):
        if b"%PDF" not in content[:1024]:
            raise ValueError("not a PDF")
        self.objects: dict[int, object] = {}
        self.trailer: dict = {}
        at = 0
        while found := _OBJECT.search(content, at):
            value, at = read_value(content, found.end())
            after = re.compile(rb"\s*stream\r?\n").match(content, at)
            if after and isinstance(value, dict):
                at = self._end(content, value, after.end())
                value = Stream(value, content[after.end() : at].removesuffix(b"\n").removesuffix(b"\r") if not isinstance(value.get("Length"), int) else content[after.end() : at])
            self.objects[int(found[1])] = value
        for found in re.finditer(rb"\btrailer\b", content):
            head, _ = read_value(content, found.end())
            self.trailer |= head if isinstance(head, dict) else {}
        for value in list(self.objects.values()):
            if isinstance(value, Stream) and value.head.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in value.head.items() if k in ("Root", "Info", "Encrypt")}
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted PDF")
        self._unpack()

    @staticmethod
    def _end(content: bytes, head: dict, start: int) -> int:
        length = head.get("Length")
        if isinstance(length, int) and re.compile(rb"\s*endstream").match(content, start + length):
            return start + length
        head.pop("Length", None)
        end = content.find(b"endstream", start)
        return len(content) if end < 0 else end

    def _unpack(self) -> None:
        packed: dict[int, object] = {}
        for number, value in list(self.objects.items()):
            if isinstance(value, Stream) and value.head.get("Type") in ("ObjStm", "XRef"):
                del self.objects[number]
                if value.head["Type"] == "ObjStm":
                    data = self.decoded(value)
                    first = self.get(value.head.get("First"))
                    heads = [int(x) for x in data[:first].split()]
                    packed |= {n: read_value(data, first + offset)[0] for n, offset in zip(heads[::2], heads[1::2], strict=False)}
        self.objects = packed | self.objects

    def get(self, value: object) -> object:
        for _ in range(32):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(value.number)
        return value

    def head(self, value: object) -> dict:
        value = self.get(value)
        return value.head if isinstance(value, Stream) else value if isinstance(value, dict) else {}

    def decoded(self, stream: Stream) -> bytes:
        filters = self.get(stream.head.get("Filter")) or []
        data = stream.data
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) not in ("FlateDecode", "Fl"):
                raise ValueError(f"no reader for filter {f}")
            data = zlib.decompressobj().decompress(data)
        return data

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with inherited resources."""
        out, seen = [], set()

        def walk(node: object, resources: object) -> None:
            head = self.head(node)
            if id(head) in seen:
                return
            seen.add(id(head))
            resources = head.get("Resources", resources)
            kids = self.get(head.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, resources)
            elif head.get("Type") == "Page":
                out.append(head | {"Resources": resources})

        walk(self.head(self.trailer.get("Root")).get("Pages"), None)
        return out

    def contents(self, page: dict) -> list[Stream]:
        found = self.get(page.get("Contents"))
        return [s for s in map(self.get, found if isinstance(found, list) else [found]) if isinstance(s, Stream)]

    def xobjects(self, resources: object, subtype: str) -> list[Stream]:
        named = self.get(self.head(resources).get("XObject"))
        return [s for s in map(self.get, (named or {}).values()) if isinstance(s, Stream) and s.head.get("Subtype") == subtype]

    def fonts(self, resources: object) -> dict[str, Font]:
        named = self.get(self.head(resources).get("Font"))
        return {name: Font(self, self.head(font)) for name, font in (named or {}).items()}


class Font:
    """How the strings of one font read and are written."""

    def __init__(self, document: Document, head: dict):
        self.width = 2 if head.get("Subtype") == "Type0" else 1
        self.table: dict[bytes, str] = {}
        stream = document.get(head.get("ToUnicode"))
        if isinstance(stream, Stream):
            self._read(document.decoded(stream))
        self.codes = {text: code for code, text in reversed(list(self.table.items()))}

    def _read(self, data: bytes) -> None:
        spaces = re.findall(rb"<([0-9A-Fa-f]+)>\s*<[0-9A-Fa-f]+>", b"".join(re.findall(rb"begincodespacerange(.*?)endcodespacerange", data, re.S)))
        if spaces:
            self.width = len(spaces[0]) // 2
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                self.table[bytes.fromhex(code.decode())] = text(to)
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
            for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[[^\]]*\])", part):
                first, last = int(low, 16), int(high, 16)
                listed = re.findall(rb"<([0-9A-Fa-f]+)>", to)
                for k in range(min(last - first + 1, 65536)):
                    if to[:1] == b"[":
                        value = text(listed[k]) if k < len(listed) else ""
                    else:
                        start = text(listed[0])
                        value = start[:-1] + chr(ord(start[-1]) + k) if start else ""
                    self.table[(first + k).to_bytes(self.width, "big")] = value

    def read(self, value: bytes) -> str:
        if not self.table:
            return value.decode("cp1252", "replace") if self.width == 1 else ""
        return "".join(self.table.get(value[i : i + self.width], "") for i in range(0, len(value), self.width))

    def write(self, text: str) -> Text:
        """Characters that the font can't show become question marks, or nothing."""
        if not self.table:
            return Text(text.encode("cp1252", "replace")) if self.width == 1 else Text(b"")
        return Text(b"".join(self.codes.get(c, self.codes.get("?", b"")) for c in text))


@dataclass
class Shown:
    """One operand that shows text: its place in the stream, line, font and text."""

    start: int
    end: int
    line: int
    font: Font | None
    text: str
    array: bool


def shown_text(data: bytes, fonts: dict[str, Font]) -> list[Shown]:
    out: list[Shown] = []
    operands: list[tuple[object, int, int]] = []
    font, line, i = None, 0, 0
    while (i := _skip(data, i)) < len(data):
        value, end = read_value(data, i)
        if type(value) is not bytes:
            operands.append((value, i, end))
            i = end
            continue
        values = [v for v, _, _ in operands]
        if value == b"BI":  # an inline image: its bytes are no operators
            end = m.end() if (m := re.compile(rb"\bID\s.*?\sEI(?=\s|$)", re.S).search(data, end)) else len(data)
        elif value == b"Tf" and len(values) >= 2:
            font = fonts.get(values[-2])
        elif value in (b"Td", b"TD") and len(values) >= 2:
            line += bool(values[-1])
        elif value in (b"Tm", b"T*", b"BT", b"ET", b"'", b'"'):
            line += 1
        if value in (b"Tj", b"'", b'"') and values and isinstance(values[-1], Text):
            out.append(Shown(*operands[-1][1:], line, font, _read(font, values[-1]), False))
        elif value == b"TJ" and values and isinstance(values[-1], list):
            text = "".join(_read(font, v) if isinstance(v, Text) else " " if isinstance(v, int | float) and v < -200 else "" for v in values[-1])
            out.append(Shown(*operands[-1][1:], line, font, text, True))
        operands = []
        i = end
    return out


def _read(font: Font | None, value: Text) -> str:
    return font.read(value) if font else value.decode("cp1252", "replace")


def _lines(shown: list[Shown]) -> list[list[Shown]]:
    lines: dict[int, list[Shown]] = {}
    for s in shown:
        lines.setdefault(s.line, []).append(s)
    return list(lines.values())


def changed_stream(data: bytes, fonts: dict[str, Font], change: Callable[[str], str]) -> bytes:
    """Each shown string by itself; a line's whole text in its first string where a name spans several."""
    edits: list[tuple[int, int, bytes]] = []
    for line in _lines(shown_text(data, fonts)):
        whole = change("".join(s.text for s in line))
        each = [change(s.text) for s in line]
        if "".join(each) != whole:
            each = [whole] + [""] * (len(line) - 1)
        for s, new in zip(line, each, strict=True):
            if new != s.text:
                text = write_value(s.font.write(new) if s.font else Text(new.encode("cp1252", "replace")))
                edits.append((s.start, s.end, b"[" + text + b"]" if s.array else text))
    for start, end, new in sorted(edits, reverse=True):
        data = data[:start] + new + data[end:]
    return data


def _page_text(document: Document, page: dict) -> str:
    data = b"\n".join(document.decoded(s) for s in document.contents(page))
    parts = [(data, page["Resources"])] + [(document.decoded(f), f.head.get("Resources", page["Resources"])) for f in document.xobjects(page["Resources"], "Form")]
    lines = [line for part, resources in parts for line in _lines(shown_text(part, document.fonts(resources)))]
    return "\n".join(t for t in ("".join(s.text for s in line).strip() for line in lines) if t)


def fragments(content: bytes, ocr: Callable[[list[bytes]], str] | None = None) -> Iterator[tuple]:
    """(channel, None, page, None, text): metadata, pages, and strings of annotations and forms."""
    document = Document(content)
    info = document.head(document.trailer.get("Info"))
    for key in TEXT_KEYS + IDENTITY_KEYS[:1]:
        value = document.get(info.get(key))
        if isinstance(value, Text) and decode_text(value).strip():
            yield f"meta:{key.lower()}", None, None, None, decode_text(value).strip()
    for number, page in enumerate(document.pages(), 1):
        text = _page_text(document, page)
        if text:
            yield "page", None, number, None, text
        elif ocr and (seen := ocr([s.data for s in document.xobjects(page["Resources"], "Image")]).strip()):
            yield "scan", None, number, None, seen
    for value in document.objects.values():
        head = value.head if isinstance(value, Stream) else value
        if isinstance(head, dict) and head is not info:
            for key in SHOWN_KEYS:
                if isinstance(head.get(key), Text) and decode_text(head[key]).strip():
                    yield f"note:{key}", None, None, None, decode_text(head[key]).strip()


def counts(content: bytes) -> tuple[int, int]:
    """(pages, images on them)."""
    document = Document(content)
    pages = document.pages()
    return len(pages), sum(len(document.xobjects(p["Resources"], "Image")) for p in pages)


def rewrite(content: bytes, change: Callable[[str], str]) -> bytes:
    """The file with ``change`` applied to shown text, notes and titles; authors and XMP are cleared."""
    document = Document(content)
    info = document.head(document.trailer.get("Info"))
    done: set[int] = set()

    def put(stream: Stream, data: bytes) -> None:
        stream.data = zlib.compress(data)
        stream.head = {k: v for k, v in stream.head.items() if k not in ("Filter", "DecodeParms", "Length")} | {"Filter": Name("FlateDecode")}
        done.add(id(stream))

    for page in document.pages():
        fonts, streams = document.fonts(page["Resources"]), [s for s in document.contents(page) if id(s) not in done]
        if streams:
            # A line may go on in the next part of a page's contents.
            put(streams[0], changed_stream(b"\n".join(document.decoded(s) for s in streams), fonts, change))
            for s in streams[1:]:
                put(s, b"")
        for form in document.xobjects(page["Resources"], "Form"):
            if id(form) not in done:
                put(form, changed_stream(document.decoded(form), document.fonts(form.head.get("Resources", page["Resources"])), change))
    for value in document.objects.values():
        head = value.head if isinstance(value, Stream) else value
        if not isinstance(head, dict):
            continue
        if isinstance(value, Stream) and head.get("Type") == "Metadata":
            put(value, b"")
        for key in TEXT_KEYS if head is info else SHOWN_KEYS:
            if isinstance(head.get(key), Text):
                head[key] = encode_text(change(decode_text(head[key])))
        if head is info:
            head.update({key: Text(b"") for key in IDENTITY_KEYS if key in head})
    return written(document.objects, {k: document.trailer[k] for k in ("Root", "Info") if k in document.trailer})


def written(objects: dict[int, object], trailer: dict) -> bytes:
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for number, value in sorted(objects.items()):
        places[number] = len(out)
        body = write_value(value.head | {"Length": len(value.data)}) + b"\nstream\n" + value.data + b"\nendstream" if isinstance(value, Stream) else write_value(value)
        out += b"%d 0 obj\n" % number + body + b"\nendobj\n"
    start, size = len(out), max(places, default=0) + 1
    out += b"xref\n0 %d\n" % size
    for number in range(size):
        out += b"%010d 00000 n \n" % places[number] if number in places else b"0000000000 65535 f \n"
    return bytes(out + b"trailer\n" + write_value(trailer | {"Size": size}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def simple_pdf(pages: list[list[str]], info: dict[str, str] | None = None) -> bytes:
    """A small PDF with one line for each string, for tests and exports."""
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}}
    kids = []
    for k, lines in enumerate(pages):
        shown = b"BT /F1 11 Tf 14 TL 72 760 Td " + b" ".join(write_value(Text(t.encode("cp1252", "replace"))) + b" Tj T*" for t in lines) + b" ET"
        objects[10 + 2 * k] = {"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, 595, 842], "Resources": {"Font": {"F1": Ref(3)}}, "Contents": Ref(11 + 2 * k)}
        objects[11 + 2 * k] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(shown))
        kids.append(Ref(10 + 2 * k))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    objects[4] = {k: encode_text(v) for k, v in (info or {}).items()}
    return written(objects, {"Root": Ref(1), "Info": Ref(4)})
