"""Calendar functions as column expressions: dates, holidays, business days.

A date serial ("rdate") counts days from 0001-01-01 = 1. Weekday numbers named
``k`` run from Sunday = 0. Nothing here joins or shuffles: holidays are
arithmetic on the year, so every function fuses into the surrounding stage.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.plans.scale import lookup_join, materialise

# Weekday names for Spark's next_day, Sunday = 0.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
# Fixed value: the serial of 1970-01-01.
RDATE_OF_EPOCH = 719163


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _int(value: Column | int | str) -> Column:
    return F.lit(value) if isinstance(value, int) else _col(value)


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("date")


# -- parts -----------------------------------------------------------------


def dateparts(c: Column | str) -> dict[str, Column]:
    """year, month, day, dayofweek (Monday = 0)."""
    d = _col(c)
    return {"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "dayofweek": F.weekday(d)}


def timeparts(c: Column | str, pattern: str = "HH:mm:ss") -> dict[str, Column]:
    """hour, minute, second of a time written as text; unreadable text gives nulls."""
    t = F.try_to_timestamp(_col(c), F.lit(pattern))
    return {"hour": F.hour(t), "minute": F.minute(t), "second": F.second(t)}


def bizday(c: Column | str, parity: bool = False) -> dict[str, Column]:
    """Date parts plus business day of the month and of the week."""
    d = _col(c).cast("date")
    return {**dateparts(d), "bizdaymonth": biz_day_month(d), "bizdayweek": biz_day_week(d, parity)}


# -- serials and plain date arithmetic ---------------------------------------


def to_rdate(d: Column | str) -> Column:
    return F.datediff(_col(d), _epoch()) + RDATE_OF_EPOCH


def gdate_to_rdate(year: Column | int, month: Column | int, day: Column | int) -> Column:
    return to_rdate(F.make_date(_int(year), _int(month), _int(day)))


def rdate_to_date(r: Column | str) -> Column:
    return F.date_add(_epoch(), (_col(r) - RDATE_OF_EPOCH).cast("int"))


def rdate_to_gdate(r: Column | str) -> dict[str, Column]:
    d = rdate_to_date(r)
    return {"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d)}


def rdate_to_gyear(r: Column | str) -> Column:
    return F.year(rdate_to_date(r))


def day_of_week(d: Column | str) -> Column:
    """Sunday = 0."""
    return F.dayofweek(_col(d)) - 1


def day_of_year(d: Column | str) -> Column:
    return F.dayofyear(_col(d))


def days_left_in_year(d: Column | str) -> Column:
    return F.datediff(F.make_date(F.year(_col(d)), F.lit(12), F.lit(31)), _col(d))


def subtract_dates(first: Column | str, second: Column | str) -> Column:
    """Days from the first date to the second."""
    return F.datediff(_col(second), _col(first))


def subtract_days(d: Column | str, n: int | Column) -> Column:
    return F.date_sub(_col(d), n)


def leap_year(year: Column | str) -> Column:
    y = _col(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def valid_date(text: Column | str) -> Column:
    """True for text of the form year-month-day that names a real date."""
    return F.coalesce(F.try_to_date(_col(text), "yyyy-M-d").isNotNull(), F.lit(False))


# -- k-days ---------------------------------------------------------------


def kday_on_before(d: Column | str, k: int) -> Column:
    return F.next_day(F.date_sub(_col(d), 7), DAY_NAMES[k])


def kday_on_after(d: Column | str, k: int) -> Column:
    return F.next_day(F.date_sub(_col(d), 1), DAY_NAMES[k])


def kday_before(d: Column | str, k: int) -> Column:
    return F.next_day(F.date_sub(_col(d), 8), DAY_NAMES[k])


def kday_after(d: Column | str, k: int) -> Column:
    return F.next_day(_col(d), DAY_NAMES[k])


def kday_nearest(d: Column | str, k: int) -> Column:
    return F.next_day(F.date_sub(_col(d), 4), DAY_NAMES[k])


def nth_kday(n: int, k: int, d: Column | str) -> Column:
    """The n-th weekday ``k`` counted forward (n > 0) or backward from a date, that date included."""
    anchor = kday_before(d, k) if n > 0 else kday_after(d, k)
    return F.date_add(anchor, 7 * n)


def first_kday(k: int, d: Column | str) -> Column:
    return nth_kday(1, k, d)


def last_kday(k: int, d: Column | str) -> Column:
    return nth_kday(-1, k, d)


def nth_kday_of_month(d: Column | str) -> Column:
    """Which occurrence of its weekday in the month a date is (1..5)."""
    return F.ceil(F.dayofmonth(_col(d)) / 7).cast("int")


def monthly_events(n: int, k: int, year: Column | str, day: int = 1) -> Column:
    """Array of the twelve n-th weekdays ``k`` of a year, e.g. third Fridays."""
    y = _col(year)
    return F.array(*[nth_kday(n, k, F.make_date(y, F.lit(m), F.lit(day))) for m in range(1, 13)])


def expand_dates(start: Column | str, end: Column | str | None = None) -> Column:
    """Array of all days from start to end; a missing end stands for the single day."""
    s = _col(start).cast("date")
    e = s if end is None else F.coalesce(_col(end).cast("date"), s)
    return F.when(e >= s, F.sequence(s, e)).otherwise(F.array().cast("array<date>"))


# -- holidays -------------------------------------------------------------


def easter(year: Column | str) -> Column:
    """Gregorian Easter: the Sunday after the paschal full moon."""
    y = _col(year)
    golden = F.pmod(y, F.lit(19))
    century = F.floor(y / 100) + 1
    raw = F.pmod(
        14 + 11 * golden - F.floor(3 * century / 4) + F.floor((5 + 8 * century) / 25), F.lit(30)
    )
    late = (raw == 0) | ((raw == 1) & (golden > 10))
    epact = raw + F.when(late, 1).otherwise(0)
    moon = F.date_sub(F.make_date(y, F.lit(4), F.lit(19)), epact.cast("int"))
    return kday_after(moon, 0)


def _fixed(y: Column, month: int, day: int, saturday: int = 0, sunday: int = 0) -> Column:
    """A fixed date, moved by the given days when it falls on a weekend day."""
    d = F.make_date(y, F.lit(month), F.lit(day))
    if not saturday and not sunday:
        return d
    move = F.when(F.dayofweek(d) == 7, saturday).when(F.dayofweek(d) == 1, sunday).otherwise(0)
    return F.date_add(d, move)


def _nth(y: Column, month: int, n: int, k: int) -> Column:
    return nth_kday(n, k, F.make_date(y, F.lit(month), F.lit(1)))


def holidays(year: Column | str, observed: bool = True) -> dict[str, Column]:
    """The seventeen holidays of a year, by name; ``observed`` moves weekend dates."""
    y = _col(year)
    shift = 1 if observed else 0
    return {
        "New Year's Day": _fixed(y, 1, 1, sunday=shift),
        "MLK Day": _nth(y, 1, 3, 1),
        "Valentine's Day": _fixed(y, 2, 14),
        "President's Day": _nth(y, 2, 3, 1),
        "St. Patrick's Day": _fixed(y, 3, 17),
        "Good Friday": F.date_sub(easter(y), 2),
        "Easter": easter(y),
        "Cinco de Mayo": _fixed(y, 5, 5),
        "Mother's Day": _nth(y, 5, 2, 0),
        "Memorial Day": kday_on_before(F.make_date(y, F.lit(5), F.lit(31)), 1),
        "Father's Day": _nth(y, 6, 3, 0),
        "Independence Day": _fixed(y, 7, 4, saturday=-shift, sunday=shift),
        "Labor Day": _nth(y, 9, 1, 1),
        "Halloween": _fixed(y, 10, 31),
        "Veteran's Day": _fixed(y, 11, 11, sunday=shift),
        "Thanksgiving": _nth(y, 11, 4, 4),
        "Christmas": _fixed(y, 12, 25, saturday=-shift, sunday=shift),
    }


def holiday_names() -> list[str]:
    return list(holidays(F.lit(2000)))


def holiday_table(years: DataFrame, year: str = "year", observed: bool = True) -> DataFrame:
    """One row (year, name, holiday) per year and holiday."""
    items = [
        F.struct(F.lit(n).alias("name"), d.alias("holiday")) for n, d in holidays(year, observed).items()
    ]
    rows = years.select(year, F.explode(F.array(*items)).alias("_h"))
    return rows.select(year, "_h.name", "_h.holiday")


def holiday_name(d: Column | str, observed: bool = True) -> Column:
    """Name of the holiday on a date, or null."""
    d = _col(d).cast("date")
    return F.coalesce(*[F.when(d == h, F.lit(n)) for n, h in holidays(F.year(d), observed).items()])


def holiday_dates(year: Column | str, observed: bool = True) -> Column:
    """Array of the holiday dates of a year."""
    return F.array(*holidays(year, observed).values())


def _count_holidays(d: Column, start: Column, end: Column, weekdays_only: bool) -> Column:
    """Holidays of the year of ``d`` from start to end, both included."""

    def inside(h: Column) -> Column:
        hit = (h >= start) & (h <= end)
        return hit & (F.weekday(h) < 5) if weekdays_only else hit

    return F.size(F.filter(holiday_dates(F.year(d)), inside))


def biz_day_month(d: Column | str) -> Column:
    """Weekdays from the first of the month to the date, less the weekday holidays among them."""
    d = _col(d).cast("date")
    first = F.trunc(d, "MM")
    lead, n = F.weekday(first), F.dayofmonth(d)
    rest = n % 7
    tail = F.least(F.greatest(5 - lead, F.lit(0)), rest) + F.greatest(rest - (7 - lead), F.lit(0))
    weekdays = F.floor(n / 7) * 5 + tail
    return (weekdays - _count_holidays(d, first, d, True)).cast("int")


def biz_day_week(d: Column | str, parity: bool = False) -> Column:
    """Business days of the week up to and including the date; 0 on weekends.

    ``parity=True`` leaves out the weekday index, so the value only counts the
    holidays from Monday to the day before, as a number at or below zero.
    """
    d = _col(d).cast("date")
    monday = kday_on_before(d, 1)
    missed = _count_holidays(d, monday, F.date_sub(d, 1), False)
    value = -missed if parity else F.weekday(d) + 1 - missed
    return F.when(F.weekday(d) < 5, value).when(d.isNotNull(), 0)


def nth_bizday(n: int, year: Column | str, month: Column | str) -> Column:
    """Date of the n-th business day of a month, counting on past its end if need be.

    Five weekdays come with every seven days and a year holds seventeen
    holidays, so the days looked at always contain the answer.
    """
    y, m = _col(year), _col(month)
    first = F.make_date(y, m, F.lit(1))
    days = F.sequence(first, F.date_add(first, 7 * (n // 5 + 1) + 28))
    closed = holiday_dates(y)
    open_days = F.filter(days, lambda x: (F.weekday(x) < 5) & ~F.array_contains(closed, x))
    return F.get(open_days, F.lit(n - 1))


def next_holiday(d: Column | str, years_ahead: int = 1) -> Column:
    """First holiday strictly after a date, within its year and the given number of later years."""
    d = _col(d).cast("date")
    years = F.transform(F.sequence(F.lit(0), F.lit(years_ahead)), lambda a: holiday_dates(F.year(d) + a))
    return F.array_min(F.filter(F.flatten(years), lambda h: h > d))


def previous_holiday(d: Column | str, years_back: int = 1) -> Column:
    """Last holiday strictly before a date, within its year and the given number of earlier years."""
    d = _col(d).cast("date")
    years = F.transform(F.sequence(F.lit(0), F.lit(years_back)), lambda a: holiday_dates(F.year(d) - a))
    return F.array_max(F.filter(F.flatten(years), lambda h: h < d))


def by_day(df: DataFrame, date: str, parts: Callable[[Column], Mapping[str, Column]]) -> DataFrame:
    """Add day-level columns, worked out once per distinct day instead of once per row.

    ``parts`` maps the day to named expressions (``bizday``, say). The table of
    days is bounded by the calendar and joined back by day.
    """
    keyed = df.withColumn("_day", F.col(date).cast("date"))
    days = materialise(keyed.select("_day").distinct())
    table = days.select("_day", *[v.alias(k) for k, v in parts(F.col("_day")).items()])
    return lookup_join(keyed, table, "_day").drop("_day")


def with_nearest_events(
    df: DataFrame,
    date: str,
    events: DataFrame,
    event: str,
    before: str = "previous_event",
    after: str = "next_event",
) -> DataFrame:
    """Add the last event strictly before and the first strictly after each row's date.

    Both tables are reduced to their distinct days first. There are at most
    3.7 million days in Spark's date range whatever the number of rows, so the
    running look-up over all days is bounded; its result is joined back by day.
    """
    wanted = df.select(F.col(date).cast("date").alias("_day"), F.lit(None).cast("date").alias("_event"))
    known = events.select(F.col(event).cast("date").alias("_day"), F.col(event).cast("date").alias("_event"))
    days = wanted.union(known).filter("_day is not null").groupBy("_day").agg(F.max("_event").alias("_event"))
    past = W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    coming = W.orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1)
    table = days.select(
        "_day",
        F.last("_event", ignorenulls=True).over(past).alias(before),
        F.last("_event", ignorenulls=True).over(coming).alias(after),
    )
    table = materialise(table)
    keyed = df.withColumn("_day", F.col(date).cast("date"))
    return lookup_join(keyed, table, "_day").drop("_day")
