"""Row-level column helpers (parsing, formatting, time-of-day arithmetic).

All are compositions of built-in expressions, so they stay inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400

# Characters Python's str.strip() removes, derived from the str.isspace rule
# so text operators strip exactly what the report code strips (SQL TRIM only
# removes spaces).
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
# The same rule as a regular expression (used by the SQL oracle).
_WS_CLASS = "[" + PY_WHITESPACE + "]"  # none of these is special inside [...]
STRIP_PATTERN = "^" + _WS_CLASS + "+|" + _WS_CLASS + "+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()`` semantics: ``btrim`` with the Unicode whitespace
    set (a character scan from both ends, no regular expression)."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def _one_or_two_digits(part: Column) -> Column:
    """Text of one or two ASCII digits (no sign, no blanks) as INT, else NULL."""
    digits_only = F.translate(part, "0123456789", "") == ""
    return F.when(F.length(part).between(1, 2) & digits_only, part.cast("int"))


def lenient_time_seconds(col) -> Column:
    """'H:M:S' (one or two digits per field) -> seconds since midnight;
    malformed or out of range -> NULL.

    One split on ':' and character checks per row: no regular expression and
    no timestamp parser, so a malformed value costs no exception.
    """
    parts = F.split(_c(col), ":", -1)
    h, m, s = [_one_or_two_digits(F.try_element_at(parts, F.lit(i))) for i in (1, 2, 3)]
    ok = (F.size(parts) == 3) & (h < 24) & (m < 60) & (s < 60)
    return F.when(ok, h * 3600 + m * 60 + s).cast("int")


def strict_date(col, fmt: str = "yyyy-MM-dd") -> Column:
    """Date parse that fails the job on a malformed value (ANSI to_date)."""
    return F.to_date(_c(col), fmt)


def lenient_cast(col, dtype: str) -> Column:
    """Cast that yields NULL for values that do not parse.

    A whole number written with decimals ('1.0', as exports of a nullable id
    column have it) is a BIGINT; one with a fraction is not.
    """
    if dtype != "bigint":
        return _c(col).try_cast(dtype)
    number = _c(col).try_cast("decimal(38,10)")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def seconds_to_hms(col) -> Column:
    """Seconds since midnight -> 'HH:MM:SS' text."""
    s = _c(col)
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"),
                           ((s % 3600) / 60).cast("int"), (s % 60).cast("int"))


def null_skipping_concat(*cols) -> Column:
    """CONCAT that treats NULL as empty text (never returns NULL)."""
    return F.concat_ws("", *[_c(c) for c in cols])


def thousands(col) -> Column:
    """Integer with ',' thousands separators (Python ``f'{x:,}'`` for ints)."""
    return F.format_number(_c(col).cast("decimal(38,0)"), 0)


def fixed_digits(col, digits: int) -> Column:
    """Number printed with exactly ``digits`` decimals, no separators; NULL
    stays NULL (``format_string`` alone would print a truncated 'null')."""
    c = _c(col)
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c.cast("double")))


def dayofweek_is_weekend(date_col) -> Column:
    return F.dayofweek(_c(date_col)).isin(1, 7)


def event_time(ts_ntz_col) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP whose UTC wall clock equals the NTZ value.

    Independent of the session time zone, so daily windows built on it align
    with calendar dates of the NTZ column.
    """
    c = _c(ts_ntz_col)
    secs = (F.unix_date(F.to_date(c)).cast("bigint") * SECONDS_PER_DAY
            + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c))
    return F.timestamp_seconds(secs)
