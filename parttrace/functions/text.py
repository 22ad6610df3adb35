"""Scalar functions over text: normal forms, missing values, digests, distances.

ASCII values stay in the JVM. With ``unicode`` the rest goes through an Arrow function; without, values are known to be ASCII.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ManifestError

# What strip() takes off ASCII text, and the words for a missing value.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
WHITE_CLASS = r"[\x09-\x0d\x1c-\x20]"
MISSING = ("", "na", "n/a", "null", "none")
SPLIT_WORDS = {"train": "train", "training": "train", "test": "test", "testing": "test"}


def plain_text(value: str | None) -> str | None:
    value = unicodedata.normalize("NFKC", value).strip() if value is not None else ""
    return value or None


def plain_value(value: str | None) -> str | None:
    value = plain_text(value)
    return None if value is None or value.casefold() in MISSING else value


def plain_identifier(value: str | None) -> str | None:
    value = plain_value(value)
    return None if value is None else re.sub(r"\s+", " ", value.casefold())


def plain_header(header: str) -> str:
    """A header's normal form: lower case, separators and punctuation as single underscores."""
    folded = unicodedata.normalize("NFKC", header).strip().casefold()
    name = re.sub(r"_+", "_", re.sub(r"[\W]", "_", re.sub(r"[\s\-/\\]+", "_", folded))).strip("_")
    if not name:
        raise ManifestError(f"header has no name left: {header!r}")
    return name


def _arrow(f):
    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return apply


def _either(c: Column, native: Column, exact, unicode: bool) -> Column:
    if not unicode:
        return native
    ascii_only = c.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(ascii_only, native).otherwise(_arrow(exact)(F.when(~ascii_only, c)))


def text(c: Column, unicode: bool = True) -> Column:
    """Compatibility-composed and stripped; null when nothing is left."""
    return _either(c, F.nullif(F.btrim(c, F.lit(WHITE)), F.lit("")), plain_text, unicode)


def value(c: Column, unicode: bool = True) -> Column:
    """``text``, null for the words for a missing value."""
    t = F.btrim(c, F.lit(WHITE))
    return _either(c, F.when(~F.lower(t).isin(*MISSING), t), plain_value, unicode)


def identifier(c: Column, unicode: bool = True) -> Column:
    """``value`` with case folded and white space runs as one space."""
    t = F.lower(F.btrim(c, F.lit(WHITE)))
    return _either(c, F.when(~t.isin(*MISSING), F.regexp_replace(t, f"{WHITE_CLASS}+", " ")), plain_identifier, unicode)


def split_side(c: Column, unicode: bool = True) -> Column:
    """train or test for the words that name them, else null."""
    words = F.create_map(*[F.lit(x) for pair in SPLIT_WORDS.items() for x in pair])
    return F.try_element_at(words, identifier(c, unicode))


def json_text(c: Column, unicode: bool = True) -> Column:
    """The JSON form of a string, everything but printable ASCII escaped; null as null."""
    quoted = F.concat(F.lit('"'), c, F.lit('"'))
    if unicode:
        safe = c.rlike(r'\A[\x20\x21\x23-\x5b\x5d-\x7e]*\z')
        quoted = F.when(safe, quoted).otherwise(_arrow(json.dumps)(F.when(~safe, c)))
    return F.coalesce(quoted, F.lit("null"))


def json_object(fields: dict[str, Column]) -> Column:
    """Compact JSON of already encoded values, keys sorted."""
    parts = [F.concat(F.lit(("," if k else "") + json.dumps(name) + ":"), fields[name]) for k, name in enumerate(sorted(fields))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def plain_digest(payload: object) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def hash_bits(hexadecimal: Column) -> Column:
    """16 hexadecimal digits as a 64-bit number."""
    return F.conv(hexadecimal, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def token_overlap(header: str, wanted: str) -> float:
    """Share of the wanted name's words that a header has."""
    have, want = set(header.split("_")), set(wanted.split("_"))
    return len(have & want) / len(want) if want else 0.0
