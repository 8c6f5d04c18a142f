"""Value cleaning and normalising."""

from __future__ import annotations

import unicodedata

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import NULL_WORDS, ZERO_DATES


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(at: date | datetime, dtype: str | T.DataType = "timestamp_ntz") -> Column:
    """A date or time as a literal of a column's type. It goes by its text, so no time zone of the driver comes in."""
    return F.lit(at.isoformat(sep=" ") if isinstance(at, datetime) else at.isoformat()).cast(dtype)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def placeholder_to_null(c: str | Column) -> Column:
    """Zero dates and words such as ``none`` or ``nan`` become null, any case, blanks around them ignored."""
    c = as_col(c)
    bare = F.lower(F.trim(c))
    return F.when(bare.isin(*NULL_WORDS, *ZERO_DATES), F.lit(None)).otherwise(c)


def normalise_id(c: str | Column) -> Column:
    """``"202"``, ``"202.0"`` and 202 compare equal; what is no whole number stays as text."""
    text = F.trim(as_col(c).cast("string"))
    whole = F.regexp_extract(text, r"^([+-]?\d{1,38})(?:\.0*)?$", 1).try_cast("decimal(38,0)").cast("string")
    return F.coalesce(whole, text)


def coerce_key(c: str | Column) -> Column:
    """Text to BIGINT, null when it is no whole number."""
    return F.regexp_extract(F.trim(as_col(c).cast("string")), r"^([+-]?\d+)(?:\.0*)?$", 1).try_cast("bigint")


def comparable(c: str | Column, dtype: T.DataType, null_integer_as_zero: bool = False, parse_text: bool = False) -> Column:
    """One text form for values that two systems store in different types."""
    c = as_col(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz").cast("string")  # a fraction shows without the zeros that end it
    if isinstance(dtype, T.BooleanType):
        c, dtype = c.cast("int"), T.IntegerType()
    if isinstance(dtype, T.IntegralType):
        return (F.coalesce(c, F.lit(0)) if null_integer_as_zero else c).cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.round(c, 6).cast("decimal(38,6)").cast("string")
    if isinstance(dtype, T.DecimalType):
        return F.round(c, 6).cast("decimal(38,6)").cast("string")
    if parse_text:
        return F.coalesce(c.try_cast("timestamp_ntz").cast("string"), c)
    return c


def collapse_note(c: str | Column) -> Column:
    """Whitespace runs to one blank, ``^`` to a blank, trimmed, null to the empty text."""
    text = F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"\s+", " ")
    return F.trim(F.translate(text, "^", " "))


def strip_control(c: str | Column) -> Column:
    return F.regexp_replace(as_col(c), r"\p{Cntrl}", "")


def _plain_letters() -> tuple[str, str]:
    """Every Latin letter with marks and the ASCII letter its compatibility decomposition starts with."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(marked, plain) for marked, plain in pairs if plain.isascii() and plain.isalpha()]
    return "".join(m for m, _ in kept), "".join(p for _, p in kept)


MARKED, PLAIN = _plain_letters()


def clean_term(c: str | Column) -> Column:
    """Plain lower-case ASCII for term lookup: marks dropped, letters, digits and ``% / . -`` kept."""
    def plain(text: Column) -> Column:
        # only texts with letters beyond ASCII have marks to drop
        marked = F.regexp_replace(F.translate(text, MARKED, PLAIN), r"[^\x00-\x7F]+", "")
        return F.lower(F.when(F.octet_length(text) > F.length(text), marked).otherwise(text))

    return F.trim(F.regexp_replace(let(F.coalesce(as_col(c), F.lit("")), plain), r"[^a-z0-9%/.\-]+", " "))
