"""Dates written in text: six shapes, never guessed where the order is ambiguous.

Shapes are tried in a fixed order over the whole text. A valid date claims its
place, and later shapes can't use what is claimed; an invalid one claims
nothing. `6/3/2026` names no day unless one number is over 12 or both are equal.
"""

from __future__ import annotations

import calendar
import re
from bisect import bisect
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import MONTHS
from ..regex import B0, B1
from .binding import batched

_NUMBER = {name.lower()[:n]: k + 1 for k, name in enumerate(MONTHS) for n in (3, len(name))} | {"sept": 9}
_NAMES = "|".join(sorted(_NUMBER, key=lambda n: (-len(n), n)))
FIRST_YEAR, LAST_YEAR = 1000, 2100
#: What a date in a text says: a whole day, a month of a year, a day of no year, or a pair of numbers that can be read two ways.
DAY, MONTH, NO_YEAR, UNCLEAR = "day", "month", "no year", "unclear"
HIT = "struct<start:int,raw:string,says:string,date:string,month:string,year_assumed:boolean>"
HITS = f"array<{HIT}>"


@dataclass
class Hit:
    start: int
    raw: str
    says: str
    #: yyyy-MM-dd of a whole day; yyyy-MM of a day or month of a known year.
    date: str | None = None
    month: str | None = None
    #: The year isn't written by the date but comes from the hint.
    year_assumed: bool = False

    @property
    def end(self) -> int:
        return self.start + len(self.raw)


def _year(digits: str | None) -> int | None:
    if not digits:
        return None
    value = int(digits)
    return value + (1900 if value >= 70 else 2000) if len(digits) == 2 else value


def _iso(m: re.Match, hint: int | None):
    return int(m["d"]), int(m["m"]), int(m["y"]), False


def _named(m: re.Match, hint: int | None):
    written = _year(m["y"])
    return int(m["d"]), _NUMBER[m["m"].lower()], written or hint, written is None and hint is not None


def _month_year(m: re.Match, hint: int | None):
    return None, _NUMBER[m["m"].lower()], int(m["y"]), False


def _pair(m: re.Match, hint: int | None):
    a, b = int(m["a"]), int(m["b"])
    if a != b and max(a, b) <= 12:
        return None, None, _year(m["y"]), False
    return (a, b, _year(m["y"]), False) if a > 12 else (b, a, _year(m["y"]), False)


def _numeric_month(m: re.Match, hint: int | None):
    return None, int(m["m"]), int(m["y"]), False


_DIGIT = re.compile(r"[0-9]")
#: The shapes of dates and the order in which they are tried decide the result.
_SHAPES = [
    (re.compile(r"\b(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})\b", re.A), _iso),
    (re.compile(rf"\b(?P<d>\d{{1,2}})(?:st|nd|rd|th)?\s+(?P<m>{_NAMES})\.?,?\s*(?P<y>\d{{4}})?(?!\d)", re.A | re.I), _named),
    (re.compile(rf"\b(?P<m>{_NAMES})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?(?!\d)(?:,?\s*(?P<y>\d{{4}}))?", re.A | re.I), _named),
    (re.compile(rf"\b(?P<m>{_NAMES})\.?,?\s+(?P<y>\d{{4}})\b", re.A | re.I), _month_year),
    (re.compile(r"\b(?P<a>\d{1,2})[/.](?P<b>\d{1,2})[/.](?P<y>\d{2,4})\b", re.A), _pair),
    (re.compile(r"\b(?P<m>0?[1-9]|1[0-2])/(?P<y>\d{4})\b", re.A), _numeric_month),
]


def _hit(start: int, raw: str, day: int | None, month: int | None, year: int | None, assumed: bool) -> Hit:
    if month is None:
        return Hit(start, raw, UNCLEAR)
    of_year = f"{year:04d}-{month:02d}" if year else None
    if day is None:
        return Hit(start, raw, MONTH, month=of_year)
    if year is None:
        return Hit(start, raw, NO_YEAR)
    return Hit(start, raw, DAY, f"{of_year}-{day:02d}", of_year, assumed)


def find_dates(text: str | None, hint: int | None = None) -> list[Hit]:
    """All dates of a text in reading order; hint: the year of those that name none."""
    hits: list[tuple[int, int, Hit]] = []  # apart from each other, in reading order
    if not _DIGIT.search(text or ""):
        return []  # every shape has digits
    for pattern, read in _SHAPES:
        for m in pattern.finditer(text or ""):
            day, month, year, inferred = read(m, hint)
            ambiguous = read is _pair and month is None
            if not ambiguous and not (month and 1 <= month <= 12):
                continue
            if year is not None and not FIRST_YEAR <= year <= LAST_YEAR:
                continue
            if day is not None and not 1 <= day <= calendar.monthrange(year or 2000, month)[1]:
                continue
            at = bisect(hits, m.start(), key=lambda x: x[0])
            if (at and hits[at - 1][1] > m.start()) or (at < len(hits) and hits[at][0] < m.end()):
                continue
            hits.insert(at, (m.start(), m.end(), _hit(m.start(), m[0].strip(), day, month, year, inferred)))
    return [h for *_, h in hits]


@batched(HITS)
def date_hits(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [asdict(h) for h in find_dates(t)])


@batched(HITS)
def date_hits_with_year(text: pd.Series, hint: pd.Series) -> pd.Series:
    return pd.Series([[asdict(h) for h in find_dates(t, None if pd.isna(y) else int(y))] for t, y in zip(text, hint, strict=True)])


_JOIN = re.compile(r"\s*(?:–|—|-|to|until|through|thru)\s*", re.I)
_RUNNING = re.compile(r"\s*(?:–|—|-|to|until|through)\s*(?:present|current|now|today|ongoing|date)\b", re.I | re.A)


def period_of(text: str | None, hits: list[Hit]) -> tuple[str | None, bool]:
    """(end month, still running) of the first period that consecutive dates or a word such as `present` state."""
    text = text or ""
    for a, b in zip(hits, hits[1:], strict=False):
        if a.month and b.month and _JOIN.fullmatch(text, a.end, b.start):
            return b.month, False
    return None, any(_RUNNING.match(text, h.end) for h in hits)


ENTRY_FIELDS = ["date", "date_raw", "inferred", "ambiguous", "month_only", "month", "end_month", "open_ended"]


def dates_of_entry(text: str | None, hint: int | None = None) -> dict:
    """The date fields of an entry: its first complete date, else its first month or ambiguous one."""
    hits = find_dates(text, hint)
    best = next((h for h in hits if h.says == DAY), None) or next((h for h in hits if h.says in (MONTH, UNCLEAR)), None)
    says = best.says if best else None
    month = best.month if says == DAY else next((h.month for h in hits if h.month), None)
    end, running = period_of(text, hits)
    return {
        "date": best and best.date, "date_raw": best and best.raw, "inferred": bool(best and best.year_assumed), "ambiguous": says == UNCLEAR,
        "month_only": says == MONTH, "month": month, "end_month": end, "open_ended": end is None and running,
    }


# ---- in SQL -------------------------------------------------------------------

_LONG = "january|jan|march|mar|may|july|jul|august|aug|october|oct|december|dec"
_SHORT = "april|apr|june|jun|september|sept|sep|november|nov"
_NAMED_DAY = "|".join([rf"(?:0?[1-9]|[12][0-9]|3[01])(?:st|nd|rd|th)?\s+(?:{_LONG})", rf"(?:0?[1-9]|[12][0-9]|30)(?:st|nd|rd|th)?\s+(?:{_SHORT})", r"(?:0?[1-9]|[12][0-9])(?:st|nd|rd|th)?\s+(?:february|feb)"])
#: A line that holds a date of any shape (leap days of other years count as well).
HAS_DATE = "(?i)" + "|".join([
    rf"{B0}[12][0-9]{{3}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]){B1}",
    rf"{B0}(?:{_NAMED_DAY})(?:[^a-z0-9_]|$)",
    rf"{B0}(?:{_NAMES})\.?\s+(?:0?[1-9]|[12][0-9]|3[01])(?:st|nd|rd|th)?(?:[^0-9]|$)",
    rf"{B0}(?:{_NAMES})\.?,?\s+[12][0-9]{{3}}{B1}",
    rf"{B0}[0-3]?[0-9][/.][0-3]?[0-9][/.](?:[12][0-9]{{3}}|[0-9]{{2}}){B1}",
    rf"{B0}(?:0?[1-9]|1[0-2])/[12][0-9]{{3}}{B1}",
])


def has_date(line: Column) -> Column:
    return line.rlike(HAS_DATE)


def month_number(name: Column) -> Column:
    """1 to 12 for a month's name or abbreviation in any case, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for n in sorted(_NUMBER) for x in (n, _NUMBER[n])]), F.lower(name))


def valid_date(year: Column, month: Column, day: Column) -> Column:
    """A date column, null where the calendar has no such day or the year is out of range."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year.between(FIRST_YEAR, LAST_YEAR), F.try_to_date(text, "yyyy-MM-dd"))


def display_date(day: Column) -> Column:
    """A day as readers see it: 6 March 2026."""
    return F.date_format(day, "d MMMM yyyy")


def month_label(day: Column) -> Column:
    """A month as axes show it: Mar 26."""
    return F.date_format(day, "MMM yy")


def month_key(day: Column) -> Column:
    """A month as it is grouped by: 2026-03."""
    return F.date_format(day, "yyyy-MM")


def assumed_year(named: Column, given: Column) -> Column:
    """Whether dates without a year take one that the reader gave: the document names none."""
    return named.isNull() & given.isNotNull()


def month_ordinal(month: Column) -> Column:
    """Months since year 0 of 'yyyy-MM'."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def month_of_ordinal(n: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(n / 12).cast("int"), F.pmod(n, F.lit(12)) + 1)
