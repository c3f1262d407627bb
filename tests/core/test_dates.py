from __future__ import annotations

import pytest

from folioscan.functions.dates import dates_of_entry, find_dates


@pytest.mark.parametrize(("text", "want"), [
    ("on 2026-03-06.", ["2026-03-06"]), ("6 March 2026", ["2026-03-06"]), ("6th of", []), ("06 Mar. 2026 and March 7th, 2026", ["2026-03-06", "2026-03-07"]),
    ("25/03/2026", ["2026-03-25"]), ("06/03/2026", [None]), ("3.3.26", ["2026-03-03"]), ("3/3/71", ["1971-03-03"]), ("2026-02-30", []), ("31 February 2026", [None]), ("in 1999", []),
    ("March 2026", [None]), ("09/2026", [None]), ("13/2026", []), ("2026-13-01", []), ("may 5 apples", [None]), ("29 Feb 2024", ["2024-02-29"]), ("29 Feb 2023", [None]),
])
def test_shapes(text, want):
    assert [h.date for h in find_dates(text)] == want


def test_flags():
    (pair,) = find_dates("06/03/2026")
    assert pair.says == "unclear" and pair.month is None and pair.date is None
    (month,) = find_dates("31 February 2026")
    assert month.says == "month" and month.month == "2026-02" and month.raw == "February 2026"
    (hinted,) = find_dates("6 March", 2025)
    assert hinted.date == "2025-03-06" and hinted.year_assumed
    (bare,) = find_dates("6 March")
    assert bare.date is None and bare.month is None and bare.says == "no year" and not bare.year_assumed


def test_periods():
    running = dates_of_entry("July 2021 to Present")
    assert running["month"] == "2021-07" and running["open_ended"] and running["end_month"] is None
    closed = dates_of_entry("March 2018 – June 2021")
    assert (closed["month"], closed["end_month"], closed["open_ended"]) == ("2018-03", "2021-06", False)
    apart = dates_of_entry("March 2018, then June 2021")
    assert apart["end_month"] is None and not apart["open_ended"]
