"""Structured identifiers: patterns, checksums and the keep rule, all as Column expressions.

Patterns run with Java's ``(?U)``, so word boundaries and classes are Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velario.functions.lexicon import ID_LABELS

#: Patterns of the identifiers; fixed values.
CIF = r"\b[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J]\b"
CIF_WIDE = r"\b[ABCDEFGHJKLMNPQRSUVW]\d{7}[0-9A-J]\b"
NIF = r"\b[XYZ]?\d{7,8}[A-HJ-NP-TV-Z]\b"
IBAN = r"\bES\d{2}(?:[ -]?\d{4}){5}\b"
ADDRESS = (
    r"\b(?:C/|Calle|Avenida|Avda\.?|Plaza|Pza\.?|Paseo|Ps\.?|Ronda|Carrer|Travesía|Carretera|Ctra\.?)[ \t]+"
    r"[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑáéíóúñ.\- ]{2,60}?(?:,[ \t]*\d+|[ \t]+\d+)(?:[A-Za-z])?"
    r"(?:[ \t]*,[ \t]*[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑáéíóúñ ]{2,40})?"
)
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PHONE = r"\b(?:\+?34[\s.-]?)?(?:6\d{2}|7[1-9]\d|9\d{2}|8\d{2})[\s.-]?\d{2,3}[\s.-]?\d{3}\b"
PATTERNS = {"CIF": CIF, "NIF": NIF, "IBAN": IBAN, "ADDRESS": ADDRESS, "EMAIL": EMAIL, "PHONE": PHONE}
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_LETTERS = "JABCDEFGHI"

#: Characters before an identifier that the keep rule looks at.
LABEL_WINDOW = 14


def find_all(text: Column, pattern: str) -> Column:
    """All non-overlapping matches, leftmost first."""
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


def _clean(value: Column) -> Column:
    return F.upper(F.trim(value))


def valid_nif(value: Column) -> Column:
    """Eight digits, or X, Y or Z and seven digits, and the letter of the number mod 23."""
    s = _clean(value)
    number = F.translate(F.regexp_replace(s, ".$", ""), "XYZ", "012")
    shaped = s.rlike(r"^(?:[XYZ]\d{7}|\d{8})[A-Z]$")
    letter = F.substring(F.lit(NIF_LETTERS), F.when(shaped, number).cast("int") % 23 + 1, F.lit(1))
    return F.when(shaped, letter == F.right(s, F.lit(1))).otherwise(False)


def _digit(s: Column, at: int) -> Column:
    return F.ascii(F.substring(s, at, 1)) - 48


def valid_cif(value: Column) -> Column:
    """A letter, seven digits and a control digit or letter; odd digits count double, digit-wise."""
    s = _clean(value)
    total = F.lit(0)
    for i in range(1, 8):
        d = _digit(s, i + 1)
        total = total + (F.when(d > 4, d * 2 - 9).otherwise(d * 2) if i % 2 else d)
    control = (F.lit(10) - total % 10) % 10
    last = F.substring(s, 9, 1)
    fits = (last == control.cast("string")) | (last == F.substring(F.lit(CIF_LETTERS), control + 1, F.lit(1)))
    return F.when(s.rlike(r"^[ABCDEFGHJKLMNPQRSUVW]\d{7}[0-9A-J]$"), fits).otherwise(False)


def valid_iban(value: Column) -> Column:
    """Spanish account numbers, mod 97; spaces and hyphens between groups are ignored."""
    s = F.regexp_replace(_clean(value), r"[\s-]", "")
    number = F.concat(F.substring(s, 5, 20), F.lit("1428"), F.substring(s, 3, 2))
    return F.when(s.rlike(r"^ES\d{22}$"), F.when(s.rlike(r"^ES\d{22}$"), number).cast("decimal(38,0)") % 97 == 1).otherwise(False)


VALIDATORS = {"CIF": valid_cif, "NIF": valid_nif, "IBAN": valid_iban}


def matches_with_context(text: Column, pattern: str, before: Column | None = None, width: int = LABEL_WINDOW) -> Column:
    """array<struct<value, context>>: each match with the ``width`` characters before it.

    Splitting at the pattern gives the gaps, and gap i ends where match i begins. ``before`` is
    what precedes the text, for instance the end of the previous fragment.
    """
    lead = F.lit("") if before is None else F.coalesce(before, F.lit(""))
    gaps, found = F.split(text, f"(?U){pattern}", -1), find_all(text, pattern)
    lengths = lambda parts: F.aggregate(parts, F.lit(0), lambda n, s: n + F.length(s))

    def one(value: Column, i: Column) -> Column:
        start = lengths(F.slice(gaps, F.lit(1), i + 1)) + lengths(F.slice(found, F.lit(1), i))
        ahead = F.concat(lead, F.substring(text, F.lit(1), start))
        return F.struct(value.alias("value"), F.right(ahead, F.lit(width)).alias("context"))

    return F.transform(found, one)


def keep_id(kind: str, value: Column, context: Column) -> Column:
    """Keep a match with a right checksum, or with one of the kind's labels just before it."""
    labelled = F.lit(False)
    for label in ID_LABELS[kind]:
        labelled = labelled | F.contains(F.lower(context), F.lit(label))
    return VALIDATORS[kind](value) | labelled


def redact_id(value: Column) -> Column:
    """Only the last characters of a cell that is a tax id or an account number."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    tax = value.rlike(f"(?U)^(?:{CIF}|{NIF})$")
    return F.when(tax, F.concat(F.lit("···"), F.right(value, F.lit(3)))).when(bare.rlike(f"(?U)^{IBAN}$"), F.concat(F.lit("ES··"), F.right(bare, F.lit(4)))).otherwise(value)
