"""Address text: normalization, parts and keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviation patterns and what they stand for, applied in this order.
ABBREVIATIONS = (
    (r"\bc/\.?", "Calle"),
    (r"\bcl\.?\b", "Calle"),
    (r"\bavda\.?", "Avenida"),
    (r"\bavd\.?", "Avenida"),
    (r"\bpl\.?\b", "Plaza"),
    (r"\bpza\.?", "Plaza"),
    (r"\bpso\.?", "Paseo"),
    (r"\bctra\.?", "Carretera"),
)

#: Way types and articles that are no part of a street key.
WAY_WORDS = (
    "calle", "cl", "c", "avenida", "avda", "avd", "av", "alameda", "aldea", "plaza", "pl", "pza", "paseo", "pso",
    "barrio", "carretera", "ctra", "gran", "via", "kalea", "etorbidea", "zumarkalea", "zumardia", "auzoa",
    "errepidea", "de", "del", "la", "las", "el", "los",
)

#: Spellings of whole street keys.
KEY_ALIASES = {
    "rekalde": "recalde",
    "errekalde": "recalde",
    "iparragirre": "iparraguirre",
    "zumalacarregui": "zumalakarregi",
}


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Casefold, decompose, drop combining marks."""
    return s.str.casefold().str.normalize("NFKD").map(
        lambda t: None if t is None else "".join(c for c in t if not unicodedata.combining(c))
    )


def normalize_address(s: Column) -> Column:
    out = nfc(s)
    for pattern, word in ABBREVIATIONS:
        out = F.regexp_replace(out, "(?iU)" + pattern, word)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def strip_floor_door(s: Column) -> Column:
    return F.trim(F.substring_index(s, ",", 1))


def street_number(s: Column) -> Column:
    """Struct (street, number); number null where the text does not end in one."""
    pattern = r"^(.+?)\s+([0-9]+[A-Za-z]?)$"
    text = F.trim(s)
    has = text.rlike(pattern)
    return F.struct(
        F.when(has, F.trim(F.regexp_extract(text, pattern, 1))).otherwise(text).alias("street"),
        F.when(has, F.regexp_extract(text, pattern, 2)).alias("number"),
    )


def street_key(s: Column) -> Column:
    words = F.split(F.regexp_replace(fold(s), r"[^a-z0-9\s-]", " "), r"[\s-]+")
    key = F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*WAY_WORDS)), " ")
    alias = F.create_map(*[F.lit(x) for pair in KEY_ALIASES.items() for x in pair])
    return F.coalesce(alias[key], key)


def casefold(s: Column) -> Column:
    """Unicode case folding: upper, then lower case, as ``ß`` and ligatures need, with the exceptions that this has.

    Dotless i folds to itself, capital sharp s like the small one, any sigma to the inner one, Cherokee to capitals. (The step between also keeps the
    optimizer from dropping the upper case.)
    """
    cherokee = lambda a, b: "".join(map(chr, range(a, b)))
    upper = F.translate(F.upper(F.translate(s, "\u0131\u1e9e", "\ue131\u00df")), "\u03a3", "\u03c3")
    back = F.translate(F.lower(upper), "\ue131" + cherokee(0xAB70, 0xABC0) + cherokee(0x13F8, 0x13FE), "\u0131" + cherokee(0x13A0, 0x13F0) + cherokee(0x13F0, 0x13F6))
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(back)


def house_number_key(s: Column) -> Column:
    return casefold(F.trim(s))


def municipality_key(s: Column) -> Column:
    return F.trim(fold(s))


def text_hash(*parts: Column) -> Column:
    """SHA-256 of trimmed case-folded parts joined by bars; null parts count as empty."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(casefold(F.trim(p)), F.lit("")) for p in parts]), "|"), 256)


def payload_hash(json: Column) -> Column:
    """SHA-256 of a JSON text in canonical form: keys in order at every depth, no spaces, characters as they are. Null if it is no JSON.

    Numbers are compared by value: 1.50 and 1.5 are one.
    """
    return F.sha2(F.to_json(F.try_parse_json(json)), 256)
