"""Dates: parsing, staleness, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for days, and for what is asked of a day.
RELATIVE_DAYS = {"그저께": -2, "어제": -1, "오늘": 0, "내일": 1, "모레": 2, "글피": 3}
ROLL_OVER_DAYS = 180


def instant(text: Column) -> Column:
    """A timestamp of ISO text; without an offset it is UTC (the session's zone must be UTC)."""
    return F.try_to_timestamp(text)


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3_600_000_000.0)


def weekday_from_sunday(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(day) - 1


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date of numbers as text; null where there is none such."""
    shown = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(shown, "yyyy-MM-dd")


def flexible_date(text: Column, year: Column | int) -> Column:
    """Y-m-d with hyphens, dots or slashes, or m/d of ``year``; anything else is null."""
    t = F.trim(text)
    full, short = r"^(\d{4})\s*[-./]\s*(\d{1,2})\s*[-./]\s*(\d{1,2})\.?$", r"^(\d{1,2})\s*[-./]\s*(\d{1,2})\.?$"
    this = F.lit(year) if isinstance(year, int) else year
    return F.when(F.regexp_like(t, F.lit(full)), _date(*(F.regexp_extract(t, full, k) for k in (1, 2, 3)))).when(
        F.regexp_like(t, F.lit(short)), _date(this.cast("string"), *(F.regexp_extract(t, short, k) for k in (1, 2)))
    )


def date_in(text: Column) -> Column:
    """The first date in a text."""
    pattern = r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})"
    return F.when(F.regexp_like(text, F.lit(pattern)), _date(*(F.regexp_extract(text, pattern, k) for k in (1, 2, 3))))


#: Fixed value: a deadline in a title, after a tilde or before "until"; the leftmost of both forms counts.
DEADLINE = r"~\s*(\d{1,2})\s*[./]\s*(\d{1,2})|(\d{1,2})\s*[./]\s*(\d{1,2})\s*(?:\([월화수목금토일]\))?\s*까지"


def title_deadline(title: Column, published: Column) -> Column:
    """The deadline a title names: of the year of publication, or the next if that lies more than
    half a year back."""
    part = lambda k: F.nullif(F.regexp_extract(title, DEADLINE, k), F.lit(""))
    month, day = (F.coalesce(part(k), part(k + 2)) for k in (1, 2))
    named = F.when(month.isNotNull(), _date(F.year(published).cast("string"), month, day))
    rolled = _date((F.year(published) + 1).cast("string"), month, day)
    return F.when(F.datediff(published, named) > ROLL_OVER_DAYS, rolled).otherwise(named)


def date_range(text: Column, year: Column | int) -> Column:
    """start and end of a range or a single date (end null) as a struct."""
    parts = F.split(text, "~", 2)
    start = flexible_date(F.element_at(parts, 1), year)
    end = F.when(F.size(parts) > 1, flexible_date(F.try_element_at(parts, F.lit(2)), year))
    return F.struct(start.alias("start"), end.alias("end"))


def relative_day(text: Column, today: Column) -> Column:
    """The day a message names by a word; null if it names none."""
    out = F.lit(None).cast("date")
    for word, offset in reversed(RELATIVE_DAYS.items()):
        out = F.when(F.contains(text, F.lit(word)), F.date_add(today, offset)).otherwise(out)
    return out


def day_label(start: Column, end: Column, today: Column) -> Column:
    """running, today, tomorrow, D-n or past."""
    last = F.coalesce(end, start)
    away = F.datediff(start, today)
    return (
        F.when(last < today, "past")
        .when(away == 0, "today")
        .when(away < 0, "running")
        .when(away == 1, "tomorrow")
        .otherwise(F.concat(F.lit("D-"), away.cast("string")))
    )


def period_text(start: Column, end: Column, today: Column) -> Column:
    """A period with its year only where that is not the current one."""
    shown = lambda d: F.when(F.year(d) == F.year(today), F.date_format(d, "M/d")).otherwise(F.date_format(d, "yyyy/M/d"))
    return F.when(end.isNull() | (end == start), shown(start)).otherwise(F.concat(shown(start), F.lit(" ~ "), shown(end)))


def meal_of_hour(ts: Column) -> Column:
    """The meal a question at this hour is about: until 9 breakfast, until 14 lunch, then dinner."""
    hour = F.hour(ts)
    return F.when(hour < 9, "breakfast").when(hour < 14, "lunch").otherwise("dinner")


def asked_days(text: Column, default: int = 14) -> Column:
    """How many days ahead a message asks about: a number of days within 1 to 90, a month, or the default."""
    number = F.regexp_extract(text, r"(\d{1,6})\s*일", 1)
    return F.when(number != "", F.least(F.greatest(F.expr("1"), number.try_cast("int")), F.lit(90))).when(
        F.regexp_like(text, F.lit("한\\s?달|이번\\s?달|이달")), 30
    ).otherwise(default)


def agreed_week_start(*signals: Column) -> Column:
    """The week start that independent signals agree on; null if they differ or none is known."""
    known = F.array_distinct(F.array_compact(F.array(*signals)))
    return F.when(F.size(known) == 1, F.try_element_at(known, F.lit(1)))
