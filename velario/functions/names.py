"""Normalising names and telling names from noise, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from velario.functions import lexicon as lex
from velario.functions.identifiers import CIF, IBAN, NIF


def _alternation(words) -> str:
    return "|".join(re.escape(w) for w in words)


def strip_accounting_prefix(name: Column) -> Column:
    """Drop the first matching ledger word and the blanks after it."""
    pattern = f"(?iU)^(?:{_alternation(lex.ACCOUNTING_PREFIXES)}) "
    return F.when(name.rlike(pattern), F.trim(F.regexp_replace(name, pattern, ""))).otherwise(name)


def normalize_org(name: Column) -> Column:
    """Lower case without ledger word, end punctuation, first matching suffix and blanks."""
    n = F.regexp_replace(F.trim(F.lower(strip_accounting_prefix(name))), r"[,;:.]+$", "")
    n = F.regexp_replace(n, rf"[ ,](?:{_alternation(lex.SOCIETY_SUFFIXES)})$", "")
    return F.regexp_replace(n, r"(?U)\s+", "")


def normalize_person(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(name)), r"(?U)\s+", " ")


def is_stopword(text: Column) -> Column:
    return F.lower(text).isin(*lex.STOPWORDS)


def is_document_ref(text: Column) -> Column:
    """An invoice, order or receipt reference: a leading word, a code, or five digits in a row."""
    s = F.trim(text)
    first = F.regexp_replace(F.lower(F.element_at(F.split(s, r"(?U)\s+"), 1)), "^[.:#º-]+|[.:#º-]+$", "")
    return (s != "") & (first.isin(*lex.DOC_PREFIXES) | s.rlike(r"[A-Za-z]{2,}[-/][A-Za-z0-9]*(?U:\d{2,})") | s.rlike(r"(?U)\d{5,}"))


#: Shapes of formulas and cell references; fixed values.
FORMULA_SHAPES = (
    r"(?i)^\s*=",
    r"(?i)\b(?:SUMIFS|SUMIF|VLOOKUP|HLOOKUP|INDEX|MATCH|IFERROR|SUBSTITUTE|CONCATENATE|ROUND|AVERAGE)\s*\(",
    r"!\$?[A-Z]+\$?\d*(?::\$?[A-Z]+\$?\d*)?",
    r"^\$?[A-Z]{1,3}\$?\d+(?:\s*[+\-*/]\s*\$?[A-Z]{1,3}\$?\d+)+$",
    r"^\$?[A-Z]{1,3}\$?\d+$",
    r"(?i)^Agregado!",
)


def is_artefact(text: Column) -> Column:
    """Formula, cell reference, document reference or bare symbols; also texts under 2 characters."""
    s = F.trim(text)
    out = (F.length(text) < 2) | is_document_ref(s) | s.rlike(r"^[A-Z]{1,3}\d{1,4}$") | s.rlike(r"^[+\-*/=\s$()]+$")
    for shape in FORMULA_SHAPES:
        out = out | s.rlike(shape)
    return F.coalesce(out, F.lit(True))


#: Spreadsheet function names after which a cell counts as a formula; fixed values.
SHEET_FUNCTIONS = "SUMIFS|SUMIF|SUM|VLOOKUP|HLOOKUP|INDEX|MATCH|IF|IFERROR|SUBSTITUTE|CONCAT|CONCATENATE|TEXT|ROUND|AVERAGE"


def is_formula_cell(text: Column) -> Column:
    """Cells that extraction skips; identifiers are never skipped."""
    s = F.trim(text)
    identifier = s.rlike(f"(?U)^(?:{CIF}|{NIF})$") | F.replace(s, F.lit(" "), F.lit("")).rlike(f"(?U)^{IBAN}$")
    depth = F.abs(F.length(F.regexp_replace(s, "[^(]", "")) - F.length(F.regexp_replace(s, "[^)]", "")))
    looks = s.startswith("=") | s.rlike(rf"(?i)\b(?:{SHEET_FUNCTIONS})\s*\(") | s.rlike(FORMULA_SHAPES[2]) | s.rlike(r"^\$?[A-Z]{1,3}\$?\d+(?:\s*[+\-*/]\s*\$?[A-Z]{1,3}\$?\d+)?$") | (depth >= 2)
    return ~identifier & looks


def is_lone_given_name(text: Column) -> Column:
    s = F.trim(text)
    return F.lower(s).isin(*lex.GIVEN_NAMES)


def is_numeric_text(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("")).rlike(r"(?U)^\d+$")


def is_cell_name(text: Column) -> Column:
    """A cell of a name column that looks like a real name."""
    low = F.lower(text)
    identifier = text.rlike(f"(?U)^(?:{CIF}|{NIF})$") | F.replace(text, F.lit(" "), F.lit("")).rlike(f"(?U)^{IBAN}$")
    numeric = text.rlike(r"(?U)^[\d.,/\-\s€$%]+$")
    return F.coalesce((F.length(text) >= 2) & ~low.isin(*lex.GENERIC_VALUES) & ~low.isin(*lex.STOPWORDS) & ~identifier & ~numeric & ~is_artefact(text), F.lit(False))


def _has_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in dict.fromkeys(words):
        out = out | F.contains(text, F.lit(w))
    return out


def header_text(value: Column) -> Column:
    return F.lower(F.trim(value))


def is_account_head(value: Column) -> Column:
    return F.coalesce(_has_any(header_text(value), lex.ACCOUNT_HEADS), F.lit(False))


def is_description_head(value: Column) -> Column:
    return F.coalesce(_has_any(header_text(value), lex.DESCRIPTION_HEADS), F.lit(False))


def is_numeric_head(value: Column) -> Column:
    return F.coalesce(_has_any(header_text(value), lex.NUMERIC_HEADS), F.lit(False))


def name_head_kind(value: Column) -> Column:
    """Kind of names below a heading, or null when it does not head a name column."""
    h = header_text(value)
    out = F.when((h == "") | (F.length(h) > 60) | _has_any(h, lex.NAME_HEAD_EXCLUDES), F.lit(None))
    out = out.when((h == "nombre") | (h.startswith("nombre de ") & ~_has_any(h, lex.NAME_OF_WORDS)), F.lit(None))
    for kind, words in lex.NAME_HEADS:
        out = out.when(_has_any(h, words), F.lit(kind))
    return out


def classify_account(code: Column) -> Column:
    """Kind of counterparty by the first three digits of the account code; null for all others."""
    group = F.substring(F.trim(code.cast("string")), 1, 3)
    out = F.when(group.isin(*lex.PUBLIC_ACCOUNTS), F.lit(None).cast("string"))
    for kind, groups in lex.ACCOUNT_GROUPS.items():
        out = out.when(group.isin(*groups), F.lit(kind))
    return out


_EDGE = "[ ,;-]+"
_CIF_NOTE = r"(?iU)[,;\s]*[(\[]?\s*(?:CIF[:\s]*)?[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J]\s*[)\]]?"
_ADVANCE = r"(?iU)^\s*(?:Anticipo|Préstamo|Préstamo a|Crédito a|Crédito)\s+"
_BANK_NOTE = r"(?iU)\s*-\s*ES\d{2}[\d\s]*$|\s+ref[.\s][^.]*$|\s+c/c[^.]*$"


def clean_description(kind: Column, description: Column) -> Column:
    """The bare name in a ledger description."""
    text = F.regexp_replace(F.trim(description), _CIF_NOTE, "")
    text = F.regexp_replace(text, f"^{_EDGE}|{_EDGE}$", "")
    text = F.when(kind == "PERSONA", F.regexp_replace(text, _ADVANCE, "")).when(kind == "BANCO", F.regexp_replace(text, _BANK_NOTE, "")).otherwise(text)
    return F.trim(F.regexp_replace(text, r"(?iU)^\s*Servicios profesionales\s+", ""))


def account_codename(kind: Column, code: Column, mode: str = "full") -> Column:
    """[Label-code], or in mode short [Label-rest] without group digits and leading zeros."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in lex.ACCOUNT_LABELS.items() for x in kv]), kind), F.initcap(F.lower(kind)))
    code = F.trim(code)
    if mode == "full":
        return F.concat(F.lit("["), label, F.lit("-"), code, F.lit("]"))
    if mode != "short":
        raise ValueError(f"mode must be full or short, not {mode!r}")
    digits = F.regexp_replace(code, r"(?U)\D", "")
    rest = F.regexp_replace(F.substring(digits, F.lit(4), F.length(digits)), "^0+", "")
    rest = F.when(F.length(digits) <= 3, digits).otherwise(rest)
    padded = F.when(F.length(rest) < 3, F.lpad(rest, 3, "0")).otherwise(rest)
    return F.concat(F.lit("["), label, F.lit("-"), padded, F.lit("]"))


def placeholder(kind: Column, number: Column) -> Column:
    """Running placeholder of a kind; ORG counts as [Empresa-nnn], unknown kinds as [KIND-nnn]."""
    table = lex.PLACEHOLDERS | {"ORG": ("Empresa", 3)}
    n = number.cast("string")
    out = None
    for k, (label, width) in table.items():
        text = F.concat(F.lit(f"[{label}-"), F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n), F.lit("]"))
        out = F.when(kind == k, text) if out is None else out.when(kind == k, text)
    return out.otherwise(F.concat(F.lit("["), kind, F.lit("-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n), F.lit("]")))


def escape_markdown(text: Column) -> Column:
    """A backslash before each character that Markdown reads as markup."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!|>~$])", r"\\$1")


def is_project_name(text: Column) -> Column:
    return text.rlike("^[a-z0-9_-]+$")
