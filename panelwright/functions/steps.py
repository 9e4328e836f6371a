"""The step a date stands for on the axis of its unit, and the way back.

Units are year, quarter, month and day. Steps of years and plain numbers are the number itself,
quarters and months are counted from year 0, days from 1970-01-01.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR, QUARTER, MONTH, DAY = "year", "quarter", "month", "day"
#: From coarse to fine.
UNITS = (YEAR, QUARTER, MONTH, DAY)
#: ISO 8601 durations of the observation periods that name a unit.
DURATIONS = {"P1Y": YEAR, "P3M": QUARTER, "P1M": MONTH, "P1D": DAY}

_NUMBER = "^-?[0-9]{1,6}$"
_QUARTER = "^([0-9]{4})-?[Qq]([1-4])$"
_MONTH = "^([0-9]{4})-([0-9]{2})$"
_DAY = "^([0-9]{4})-?([0-9]{2})-?([0-9]{2})$"
#: A mean year, for the calendar year of a day.
_YEAR_DAYS = 365.2425


def date_unit(date: Column) -> Column:
    """The unit a date is written in; null where it is none of the known forms.

    The length decides before any pattern is tried.
    """
    size = F.length(date)
    return (
        F.when((size <= 7) & date.rlike(_NUMBER), YEAR)
        .when(size.isin(6, 7) & date.rlike(_QUARTER), QUARTER)
        .when((size == 7) & F.regexp_extract(date, _MONTH, 2).try_cast("int").between(1, 12), MONTH)
        .when(size.isin(8, 10) & _day(date).isNotNull(), DAY)
    )


def _part(date: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(date, pattern, i).try_cast("int")


def _day(date: Column) -> Column:
    plain = F.concat_ws("-", *[F.regexp_extract(date, _DAY, i) for i in (1, 2, 3)])
    return F.unix_date(plain.try_cast("date"))


def declared_unit(observation_period: Column) -> Column:
    """The unit an observation period such as ``P1M`` names; null for others."""
    out = F.lit(None).cast("string")
    for text, unit in DURATIONS.items():
        out = F.when(observation_period == text, unit).otherwise(out)
    return out


def _rank(unit: Column) -> Column:
    return F.array_position(F.array(*[F.lit(u) for u in UNITS]), unit)


def unit_of(date: Column, observation_period: Column | None = None) -> Column:
    """The unit of a date: the declared one, unless the date is too coarse for it."""
    own = date_unit(date)
    if observation_period is None:
        return own
    declared = declared_unit(observation_period)
    return F.when(own.isNotNull() & (_rank(declared) <= _rank(own)), declared).otherwise(own)


def step_of(date: Column, unit: Column | None = None) -> Column:
    """The step of a date on the axis of ``unit``, by default its own. A date finer than the unit
    stands for the step it lies in, one that is coarser for none."""
    own = date_unit(date)
    unit = own if unit is None else unit
    day = _day(date)
    month = F.when(own == MONTH, _part(date, _MONTH, 1) * 12 + _part(date, _MONTH, 2) - 1).when(
        own == DAY, F.year(F.date_from_unix_date(day)) * 12 + F.month(F.date_from_unix_date(day)) - 1
    )
    quarter = F.when(own == QUARTER, _part(date, _QUARTER, 1) * 4 + _part(date, _QUARTER, 2) - 1).otherwise(
        F.floor(month / 3).cast("int")
    )
    year = F.when(own == YEAR, date.try_cast("int")).otherwise(F.floor(quarter / 4).cast("int"))
    return F.when(unit == YEAR, year).when(unit == QUARTER, quarter).when(unit == MONTH, month).when((unit == DAY) & (own == DAY), day)


def date_of(step: Column, unit: Column) -> Column:
    """How a step is written: ``2020``, ``2020-Q1``, ``2020-05`` or ``2020-05-01``."""
    four = lambda y: F.lpad(y.cast("int").cast("string"), 4, "0")
    return (
        F.when(unit == YEAR, step.cast("string"))
        .when(unit == QUARTER, F.concat(four(F.floor(step / 4)), F.lit("-Q"), (step % 4 + 1).cast("string")))
        .when(unit == MONTH, F.concat(four(F.floor(step / 12)), F.lit("-"), F.lpad((step % 12 + 1).cast("string"), 2, "0")))
        .when(unit == DAY, F.date_from_unix_date(step.cast("int")).cast("string"))
    )


def calendar_year(step: Column, unit: Column) -> Column:
    """The calendar year of a step, with its fraction; of days by the mean length of a year."""
    return (
        F.when(unit == QUARTER, step / 4)
        .when(unit == MONTH, step / 12)
        .when(unit == DAY, 1970 + step / _YEAR_DAYS)
        .otherwise(step.cast("double"))
    )


def last_step(year: Column, unit: Column) -> Column:
    """The last step of a calendar year."""
    return (
        F.when(unit == QUARTER, year * 4 + 3)
        .when(unit == MONTH, year * 12 + 11)
        .when(unit == DAY, F.unix_date(F.make_date(year, F.lit(12), F.lit(31))))
        .otherwise(year)
    )
