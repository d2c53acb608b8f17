"""Dates in texts and URLs as Column expressions; nothing reads the clock: callers give `as_of`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# English months in order.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def calendar(c: Column) -> Column:
    """A YYYY-MM-DD string of a real day from 1900 to 2100, else null."""
    return F.when(c.rlike("^(19|20)\\d\\d-\\d\\d-\\d\\d$|^2100-\\d\\d-\\d\\d$"), F.try_to_date(c, "yyyy-MM-dd"))


def _made(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.when((year != "") & (month != "") & (day != ""), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))), "yyyy-MM-dd")


def _by(c: Column, pattern: str, y: int, m: int, d: int) -> Column:
    return _made(*(F.regexp_extract(c, pattern, k) for k in (y, m, d)))


def parse(c: Column, as_of: Column) -> Column:
    """The first form that gives a real day: ISO-like, Korean, English month, M.D.YYYY, D/M/YYYY; else as_of."""
    names = "|".join(m.capitalize() for m in MONTHS)
    month = F.initcap(F.regexp_extract(c, f"(?i)\\b({names})\\s+\\d{{1,2}},?\\s+\\d{{4}}", 1))
    number = F.coalesce(*(F.when(month == m.capitalize(), F.lit(str(k + 1))) for k, m in enumerate(MONTHS)), F.lit(""))
    english = _made(F.regexp_extract(c, f"(?i)\\b(?:{names})\\s+\\d{{1,2}},?\\s+(\\d{{4}})", 1), number, F.regexp_extract(c, f"(?i)\\b(?:{names})\\s+(\\d{{1,2}}),?\\s+\\d{{4}}", 1))
    return F.coalesce(
        _by(c, "(\\d{4})[-./](\\d{1,2})[-./](\\d{1,2})", 1, 2, 3), _by(c, "(\\d{4})년\\s*(\\d{1,2})월\\s*(\\d{1,2})일", 1, 2, 3), english,
        _by(c, "\\b(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})", 3, 1, 2), _by(c, "\\b(\\d{1,2})/(\\d{1,2})/(\\d{4})", 3, 2, 1), as_of,
    )


def from_url(c: Column) -> Column:
    """A day in a path: /2024/01/31/, 2024-01-31 or 20240131."""
    return F.coalesce(_by(c, "(?<!\\d)(20\\d\\d|19\\d\\d)[-/_](\\d{1,2})[-/_](\\d{1,2})(?!\\d)", 1, 2, 3), _by(c, "(?<!\\d)(20\\d\\d|19\\d\\d)(\\d\\d)(\\d\\d)(?!\\d)", 1, 2, 3))


def dateline_day(text: Column, published: Column) -> Column:
    """A dateline's month and day in the year of publication, or the year before where that lies after it."""
    m, d = F.regexp_extract(text, "(\\d{1,2})월\\s?(\\d{1,2})일", 1), F.regexp_extract(text, "(\\d{1,2})월\\s?(\\d{1,2})일", 2)
    this = _made(F.year(published).cast("string"), m, d)
    before = _made((F.year(published) - 1).cast("string"), m, d)
    return F.when(this <= published, this).otherwise(before)


def clamped(c: Column, as_of: Column) -> Column:
    return F.least(c, as_of)


def juche(c: Column) -> Column:
    """Leading dates of the form 'N(YYYY)년 M월 D일', calendar-checked."""
    return _by(c, "^\\D{0,4}\\d{1,3}\\s*\\((\\d{4})\\)년\\s*(\\d{1,2})월\\s*(\\d{1,2})일", 1, 2, 3)


def minutes(c: Column) -> Column:
    """HH:MM as minutes."""
    parts = F.split(c, ":")
    return F.try_element_at(parts, F.lit(1)).try_cast("int") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("int")


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
