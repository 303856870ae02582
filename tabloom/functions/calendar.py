"""Calendar and holiday columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The holidays of 2024 used as named flags.
HOLIDAYS_2024 = {
    "republic_day": "2024-01-26",
    "holi": "2024-03-25",
    "eid_ul_fitr": "2024-04-11",
    "ram_navami": "2024-04-17",
    "independence_day": "2024-08-15",
    "janmashtami": "2024-08-26",
    "dussehra": "2024-10-12",
    "diwali": "2024-10-31",
    "christmas": "2024-12-25",
}

# Holidays that fall on the same day every year.
RECURRING_HOLIDAYS = {"republic_day": "01-26", "independence_day": "08-15", "christmas": "12-25"}

# Holidays that move, unknown for future dates.
MOVABLE_HOLIDAYS = ("holi", "diwali")

# Calendar and holiday columns that are known for any future date.
PREDICTABLE = (
    "year", "month", "day_of_week", "is_weekend", "is_month_start", "is_month_end",
    "is_quarter_start", "is_quarter_end", "quarter", "is_republic_day", "is_holi", "is_diwali",
    "is_independence_day", "is_christmas",
)


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def _quarter_end(d: Column) -> Column:
    return F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)


def calendar_columns(d: Column) -> dict[str, Column]:
    """year … quarter with Monday = 0."""
    return {
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d),
        "day_of_week": F.weekday(d), "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d), "quarter": F.quarter(d),
    }


def period_columns(d: Column) -> dict[str, Column]:
    """weekend and period-boundary flags."""
    day = F.to_date(d)
    year_end = F.date_sub(F.add_months(F.trunc(day, "year"), 12), 1)
    return {
        "is_weekend": _flag(F.weekday(d) >= 5),
        "is_month_start": _flag(F.dayofmonth(d) == 1),
        "is_month_end": _flag(day == F.last_day(day)),
        "is_quarter_start": _flag(day == F.trunc(day, "quarter")),
        "is_quarter_end": _flag(day == _quarter_end(day)),
        "is_year_start": _flag(F.dayofyear(d) == 1),
        "is_year_end": _flag(day == year_end),
    }


def cyclic_columns(d: Column) -> dict[str, Column]:
    """sine and cosine of month, day and weekday."""
    out = {}
    for name, value, period in (("month", F.month(d), 12), ("day", F.dayofmonth(d), 31),
                                ("dow", F.weekday(d), 7)):
        angle = 2 * F.pi() * value / F.lit(float(period))
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def elapsed_columns(d: Column) -> dict[str, Column]:
    """days since the start of the year and of the month."""
    return {
        "days_since_year_start": F.dayofyear(d) - 1,
        "days_since_month_start": F.dayofmonth(d) - 1,
    }


def holiday_columns(d: Column, holidays: dict[str, str] = HOLIDAYS_2024) -> dict[str, Column]:
    """one flag per named date."""
    return {f"is_{n}": _flag(F.to_date(d) == F.to_date(F.lit(s))) for n, s in holidays.items()}


def proximity_columns(d: Column, name: str = "diwali", date: str = HOLIDAYS_2024["diwali"],
                      days: tuple[int, ...] = (1, 2, 3)) -> dict[str, Column]:
    """flags for the days before and after one holiday."""
    out = {}
    for k in days:
        out[f"days_before_{name}_{k}"] = _flag(F.to_date(d) == F.date_sub(F.to_date(F.lit(date)), k))
        out[f"days_after_{name}_{k}"] = _flag(F.to_date(d) == F.date_add(F.to_date(F.lit(date)), k))
    return out


def recurring_columns(d: Column) -> dict[str, Column]:
    """fixed month-day holidays, with movable ones at 0."""
    out = {f"is_{n}": _flag(F.date_format(d, "MM-dd") == md) for n, md in RECURRING_HOLIDAYS.items()}
    out.update({f"is_{n}": F.lit(0) for n in MOVABLE_HOLIDAYS})
    return out


def is_holiday(d: Column, dates: list[str]) -> Column:
    """F8: membership in a list of dates."""
    return _flag(F.to_date(d).isin([F.to_date(F.lit(s)) for s in dates]))


def predictable_columns(d: Column, future: bool = False) -> dict[str, Column]:
    """The covariates that can be computed for dates that have not happened yet."""
    pool = {**calendar_columns(d), **period_columns(d),
            **(recurring_columns(d) if future else holiday_columns(d))}
    return {k: pool[k] for k in PREDICTABLE}


def add(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)
