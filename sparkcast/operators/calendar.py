"""Calendar features, special days and the distance to holidays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcast.operators.chunks import tick, windowed

# No holiday, no holiday near, days around a holiday, days with an own counter.
NO_HOLIDAY = "no"
FAR = 99
EVENT_LAGS = (-7, -6, -5, -4, -3, -2, -1, 0, 1, 2, 3)
SPECIAL_DAYS = ("Valentine", "MothersDay", "Karfreitag")


def holiday_or_no(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(NO_HOLIDAY))


def add_date_parts(df: DataFrame, time: str = "ds") -> DataFrame:
    day = F.col(time)
    return df.withColumns({
        "cal_date_day_of_month": F.dayofmonth(day),
        "cal_date_weekday": F.weekday(day),
        "cal_date_month": F.month(day),
        "cal_date_quarter": F.quarter(day),
    })


def add_working_day(df: DataFrame, time: str = "ds", holiday: str = "public_holiday") -> DataFrame:
    """Neither a Sunday nor a holiday; special days added later do not count."""
    return df.withColumn("cal_date_workingday",
                         (F.weekday(time) != 6) & (holiday_or_no(holiday) == NO_HOLIDAY))


def add_special_days(df: DataFrame, time: str = "ds", holiday: str = "public_holiday") -> DataFrame:
    """Valentine's day and, on the second Sunday in May, mother's day replace the holiday name."""
    day, month = F.dayofmonth(time), F.month(time)
    return df.withColumn(holiday, F.when((month == 2) & (day == 14), "Valentine")
                         .when((month == 5) & day.between(8, 14) & (F.weekday(time) == 6), "MothersDay")
                         .otherwise(holiday_or_no(holiday)))


def add_holiday_counters(df: DataFrame, keys: Sequence[str], time: str = "ds", holiday: str = "public_holiday",
                         event_lags: Sequence[int] = EVENT_LAGS,
                         special_days: Sequence[str] = SPECIAL_DAYS) -> DataFrame:
    """Signed days to the holiday whose surroundings cover the day, the latest one if several do.

    A gap-free range of lags is one RANGE frame; other lags mark their days one by one.
    """
    names = {"cal_PublicHoliday_Counter": F.col(holiday) != NO_HOLIDAY}
    names.update({f"cal_{d}_Counter": F.col(holiday) == d for d in special_days})
    now = F.unix_date(time)
    lags = sorted(set(event_lags))
    if lags == list(range(lags[0], lags[-1] + 1)):
        low, high = -lags[-1], -lags[0]

        def build(make):
            near = make().rangeBetween(low, high)
            return {n: F.coalesce(F.max(F.when(c, now)).over(near) - now, F.lit(FAR)).cast("int")
                    for n, c in names.items()}

        out = windowed(df, keys, tick(time), build, back=max(-low, 0), ahead=max(high, 0))
    else:
        hits = (df.filter(F.col(holiday) != NO_HOLIDAY)
                .select(*keys, now.alias("_day"), F.col(holiday),
                        F.explode(F.array(*[F.lit(x) for x in lags])).alias("_lag"))
                .groupBy(*keys, F.date_add(F.date_from_unix_date("_day"), F.col("_lag")).alias(time))
                .agg(*[F.max(F.when(c, F.col("_day"))).alias(f"_{n}") for n, c in names.items()]))
        out = df.join(hits, [*keys, time], "left").withColumns(
            {n: F.coalesce(F.col(f"_{n}") - now, F.lit(FAR)).cast("int") for n in names}
        ).drop(*[f"_{n}" for n in names])
    return out.drop(holiday)


def add_calendar_features(df: DataFrame, keys: Sequence[str], time: str = "ds", holiday: str = "public_holiday",
                          event_lags: Sequence[int] = EVENT_LAGS,
                          special_days: Sequence[str] = SPECIAL_DAYS) -> DataFrame:
    return (df.transform(add_date_parts, time)
            .transform(add_working_day, time, holiday)
            .transform(add_special_days, time, holiday)
            .transform(add_holiday_counters, keys, time, holiday, event_lags, special_days))
