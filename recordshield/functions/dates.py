"""One date ladder for every rule that reads dates from text.

Month comes before day, nothing is guessed from the current date, and a text that fits no shape gives null. Each shape is
tested by a pattern first, so a value is handed only to a format that can read it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import as_col, let
from .patterns import MONTH, NOTE_DATE, TIME_ONLY

# two-digit years above 75 lie in the last century
_LATE_YEAR = r"(?<y>7[6-9]|[89]\d)"
_MONTH, _DAY = r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"

# each step turns one written shape into yyyy-M-d and leaves every other text alone, so the steps need no branches
_SHORT_YEAR_STEPS = [
    (r"^(?<d>\d{1,2}([/.-])\d{1,2}\2)" + _LATE_YEAR + "$", "${d}19${y}"),
    (r"^(?<d>\d{1,2}([/.-])\d{1,2}\2)(?<y>\d{2})$", "${d}20${y}"),
]
_NUMERIC_STEPS = [
    (rf"^(?<m>{_MONTH})([/.-])(?<d>{_DAY})\2(?<y>\d{{4}})$", "${y}-${m}-${d}"),
    (rf"^(?<d>{_DAY})([/.-])(?<m>{_MONTH})\2(?<y>\d{{4}})$", "${y}-${m}-${d}"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"),
]
_COMPACT_STEPS = [
    (r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6"),
    (r"^(\d{4})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$", "$1-$2-$3"),
    (r"^(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(\d{4})$", "$3-$1-$2"),
    (r"^(0[1-9]|[12]\d|3[01])(0[1-9]|1[0-2])(\d{4})$", "$3-$2-$1"),
]
_ISO = rf"^\d{{4}}-{_MONTH}-{_DAY}(?:[ T]\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,9}})?)?)?$"
_NAMED_STEPS = [
    (r"(?i)^([a-z]{3})[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?[,./\s-]*(\d{4})$", "$2 $1 $3"),
    (r"(?i)^(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})$", "$1 $2 $3"),
]


def _steps(text: Column, steps: list[tuple[str, str]]) -> Column:
    for shape, target in steps:
        text = F.regexp_replace(text, shape, target)
    return text


# a time of day behind a date: 24 hours or AM/PM, a fraction, a zone (the written clock is kept, whatever its zone)
_TIMED = (
    r"(?i)^(.*\d)(?:T|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)?\s*(?:([ap])\.?m\.?)?\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?$"
)


def parse_date(c: str | Column, compact: bool = True) -> Column:
    """The ladder: TIMESTAMP_NTZ, or null when no shape fits. A time of day behind a date of any shape goes with it."""
    text = F.trim(as_col(c).cast("string"))

    def timed(t: Column) -> Column:
        hour, minute = F.regexp_extract(t, _TIMED, 2).try_cast("int"), F.regexp_extract(t, _TIMED, 3).try_cast("int")
        second = F.coalesce(F.regexp_extract(t, _TIMED, 4).try_cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))
        half = F.lower(F.regexp_extract(t, _TIMED, 5))
        known = F.when(half == "", hour < 24).otherwise(hour.between(1, 12)) & (minute < 60) & (second < 60)
        full = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
        clock = F.make_dt_interval(F.lit(0), full, minute, second)
        return F.when(known, (_parse_day(F.regexp_extract(t, _TIMED, 1), compact) + clock).cast("timestamp_ntz"))

    def read(t: Column) -> Column:
        return F.coalesce(_parse_day(t, compact), F.when(t.contains(":"), timed(t)))

    return let(text, read)


def _parse_day(t: Column, compact: bool) -> Column:
    """A written day, or an ISO day with a time."""
    numeric = _steps(t, _SHORT_YEAR_STEPS + _NUMERIC_STEPS + (_COMPACT_STEPS if compact else []))
    numeric = F.regexp_extract(numeric, _ISO, 0).try_cast("timestamp_ntz")
    named = F.try_to_date(F.initcap(F.lower(_steps(t, _NAMED_STEPS))), "d MMM yyyy").cast("timestamp_ntz")
    month = r"(?i)(?:^|\s)" + MONTH + r"(?![a-z])"
    return F.when(t.rlike(_ISO), t.try_cast("timestamp_ntz")).when(t.rlike(month), named).otherwise(numeric)


def add_days(stamp: Column, days: str | Column | int) -> Column:
    days = F.lit(days) if isinstance(days, int) else as_col(days)
    return (stamp + F.make_dt_interval(days.cast("int"))).cast("timestamp_ntz")


def shift_column(c: str | Column, days: str | Column | int, is_text: bool) -> Column:
    """A date column moved by whole days. Text keeps a bare time of day and gives null for what is no date."""
    c = as_col(c)
    if not is_text:
        return add_days(c.cast("timestamp_ntz"), days)
    moved = F.substring(add_days(parse_date(c), days).cast("string"), 1, 19)
    return F.when(F.trim(c).rlike(TIME_ONLY), F.trim(c)).otherwise(moved)


def birth_year(c: str | Column, is_text: bool = True) -> Column:
    return F.year(parse_date(c) if is_text else as_col(c)).cast("int")


def rewrite_matches(text: str | Column, pattern: str | Column, change) -> Column:
    """Every match of a pattern replaced by ``change(match)``; where that is null the match stays as written."""

    text = as_col(text)
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def rebuilt(found: Column) -> Column:
        changed = F.transform(found["m"], lambda m: F.coalesce(change(m), m))
        gaps = F.split(found["t"], pattern, -1)
        joined = F.array_join(F.zip_with(gaps, changed, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
        return F.when(F.size(found["m"]) > 0, joined).otherwise(found["t"])

    def searched(whole: Column) -> Column:
        return let(F.struct(whole.alias("t"), F.regexp_extract_all(whole, pattern, F.lit(0)).alias("m")), rebuilt)

    return let(text, searched)


def rewrite_dates(text: str | Column, change, pattern: str = NOTE_DATE) -> Column:
    return rewrite_matches(text, pattern, change)


def shift_dates_in_text(text: str | Column, days: str | Column | int, pad: str = "", pattern: str = NOTE_DATE) -> Column:
    days = F.lit(days) if isinstance(days, int) else as_col(days)

    def moved(d: Column) -> Column:
        # by text: date_format would go through the zone of the session and its missing hours
        length = F.when(d.rlike(r"\d{2}:\d{2}:\d{2}"), 19).otherwise(10)
        shown = F.substring(add_days(parse_date(d), F.coalesce(days, F.lit(0))).cast("string"), F.lit(1), length)
        return F.concat(F.lit(pad), shown, F.lit(pad))

    return rewrite_dates(text, moved, pattern)


def dob_to_year_in_text(text: str | Column, dob: str | Column) -> Column:
    """A date that equals the person's date of birth is cut to its year, any written form."""
    dob = as_col(dob)

    def year_only(d: Column) -> Column:
        same = parse_date(d).cast("date") == dob.cast("date")
        return F.when(same, F.date_format(dob.cast("date"), "yyyy"))

    return rewrite_dates(text, year_only)


def shift_split_date(day, month, year, days) -> dict[str, Column]:
    """A date kept in three columns: joined, moved, split again. Parts that were absent stay absent."""
    d, m, y = as_col(day), as_col(month), as_col(year)
    whole = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    moved = F.date_add(whole.try_cast("date"), as_col(days).cast("int"))
    return {
        "day": F.when(d.isNotNull(), F.coalesce(F.dayofmonth(moved), d.cast("int"))),
        "month": F.when(m.isNotNull(), F.coalesce(F.month(moved), m.cast("int"))),
        "year": F.when(y.isNotNull(), F.coalesce(F.year(moved), y.cast("int"))),
    }
