"""Whole feature sets and prepared train and test sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkcast.plans import prepare
from sparkcast.session import scratch_folder
from sparkcast.sources import results, series
from sparkcast.sources.series import RunParameters, SeriesConfig
from workload.frames import DAILY, HOLIDAYS, K, SALES, daily, rounded, sales, with_holidays
from workload.preparation import CALENDAR_SQL, COUNTERS
from workload.registry import query
from workload.windows import EXACT_STAT_COLUMNS, STAT_COLUMNS, W

SCHOOL = {"school_holiday": ["no", "osterferien", "sommerferien"]}


@query("src_csv", f"WITH {SALES} SELECT * FROM sales")
def src_csv(spark, sf):
    """Daily sales written as decimal-comma text and read back."""
    path = f"{scratch_folder(spark)}/series-{uuid.uuid4().hex}"
    rows = sales(spark, sf).select(F.date_format("ds", "dd.MM.yyyy").alias("Date"), "series_id", "revenue", "n_orders")
    results.format_results(rows, 2).write.csv(path, sep=";", header=True)
    return series.read_series_csv(spark, path, keys=K)


def filled_holidays(spark, sf):
    rows = daily(spark, sf).fillna(0.0)
    return with_holidays(rows)


ALL_FEATURES = HOLIDAYS + f""", {COUNTERS},
filled AS (SELECT series_id, ds, coalesce(revenue, 0) AS revenue, coalesce(n_orders, 0) AS n_orders FROM daily),
stats AS (SELECT *, {STAT_COLUMNS} FROM filled),
calendar AS (
  SELECT hol.series_id, hol.ds, {CALENDAR_SQL.replace('(ds)', '(hol.ds)')},
         NOT (isodow(hol.ds) = 7 OR public_holiday <> 'no') AS cal_date_workingday, school_holiday,
         near.* EXCLUDE (series_id, ds)
  FROM hol JOIN near ON hol.series_id = near.series_id AND hol.ds = near.ds)"""


@query("add_features", f"""WITH {ALL_FEATURES}
  SELECT calendar.*, stats.* EXCLUDE (series_id, ds) FROM calendar JOIN stats
    ON calendar.series_id = stats.series_id AND calendar.ds = stats.ds""")
def add_features(spark, sf):
    return rounded(prepare.add_features(filled_holidays(spark, sf), K, ["revenue", "n_orders"], 28,
                                        non_seasonal=["n_orders"]))


@query("imputed_split", f"""WITH {DAILY}, num AS (
  SELECT *, row_number() OVER {W} - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM daily),
  folds AS (SELECT *, CAST(unnest(range(CAST(ceil(n / 1095.0) AS BIGINT))) AS INT) AS fold FROM num),
  sp AS (SELECT *, CAST(730 + 365 * fold AS BIGINT) AS n_train,
         CASE WHEN t < 730 + 365 * fold THEN 'train' ELSE 'test' END AS split FROM folds WHERE t < 1095 + 365 * fold),
  m AS (SELECT series_id, fold, quantile_cont(revenue, 0.5) AS mr, quantile_cont(n_orders, 0.5) AS mo
        FROM sp WHERE split = 'train' GROUP BY 1, 2)
  SELECT series_id, ds, t, fold, n_train, split, round(coalesce(revenue, mr), 4) AS revenue,
         round(coalesce(n_orders, mo), 4) AS n_orders FROM sp JOIN m USING (series_id, fold)""")
def imputed_split(spark, sf):
    config = SeriesConfig("revenue", "shop", 365)
    params = RunParameters.of(config, 0)
    return rounded(prepare.imputed_split(daily(spark, sf), K, ["revenue", "n_orders"], params, "median"))


STATS = [f"stat_{f}_lag{i}" for f in ("revenue", "n_orders") for i in range(1, 8)]
STATS += [f"stat_revenue_seaslag{i}" for i in range(1, 8)]
STATS += [f"stat_{f}_rolling_{s}7" for f in ("revenue", "n_orders") for s in ("mean", "median", "max")]
STATS += [f"stat_revenue_rolling_seasonal_{s}7" for s in ("mean", "median", "max")]
STATS += [f"stat_revenue_weekday_rolling_{s}4" for s in ("mean", "median", "max")]
CALS = ["cal_date_day_of_month", "cal_date_weekday", "cal_date_month", "cal_date_quarter", "cal_date_workingday",
        "cal_PublicHoliday_Counter", "cal_Valentine_Counter", "cal_MothersDay_Counter", "cal_Karfreitag_Counter"]

FILLED = f"""numbered AS (
  SELECT *, row_number() OVER {W} - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM daily),
means AS (SELECT series_id, avg(revenue) AS mr, avg(n_orders) AS mo FROM numbered WHERE t < floor(n * 0.8::DOUBLE) GROUP BY 1),
filled AS (SELECT series_id, ds, t, n, coalesce(revenue, mr) AS revenue, coalesce(n_orders, mo) AS n_orders
  FROM numbered JOIN means USING (series_id))"""

ONE_HOT = ", ".join(f"CAST(school_holiday = '{v}' AS DOUBLE) AS school_holiday_{v}" for v in SCHOOL["school_holiday"])


def digits_of(c):
    """Enough digits for exact values, few enough for sums taken in another order."""
    return 6 if "n_orders" in c else 4 if "weekday_rolling" in c else 3


def second_fill(c):
    gap = f"count(*) FILTER (WHERE split = 'train' AND {c} IS NULL) OVER (PARTITION BY s.series_id) > 0"
    mean = f"avg({c}) FILTER (WHERE split = 'train') OVER (PARTITION BY s.series_id)"
    return f"round(coalesce({c}, CASE WHEN {gap} THEN {mean} END), {digits_of(c)}) AS {c}"


SHOP = SeriesConfig("revenue", "shop", 28, ("revenue", "n_orders"), ("revenue",), non_seasonal=("n_orders",))


@query("prepare_dataset", f"""WITH {HOLIDAYS}, {COUNTERS}, {FILLED},
  stats AS (SELECT *, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS n_train,
            CASE WHEN t < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split, {EXACT_STAT_COLUMNS} FROM filled)
  SELECT s.series_id, s.ds, 0 AS fold, t, n_train, split, round(s.revenue, 3) AS revenue, round(s.n_orders, 6) AS n_orders,
         day(s.ds)::DOUBLE AS cal_date_day_of_month, (isodow(s.ds) - 1)::DOUBLE AS cal_date_weekday,
         month(s.ds)::DOUBLE AS cal_date_month, quarter(s.ds)::DOUBLE AS cal_date_quarter,
         (NOT (isodow(s.ds) = 7 OR public_holiday <> 'no'))::DOUBLE AS cal_date_workingday,
         {", ".join(f'"{c}"::DOUBLE AS "{c}"' for c in CALS[5:])}, {ONE_HOT}, {", ".join(second_fill(c) for c in STATS)}
  FROM stats s JOIN near ON near.series_id = s.series_id AND near.ds = s.ds
  JOIN hol ON hol.series_id = s.series_id AND hol.ds = s.ds""".replace("0.8::DOUBLE", "0.75::DOUBLE"))
def prepare_dataset(spark, sf):
    out = prepare.prepare_dataset(with_holidays(daily(spark, sf)), K, SHOP, RunParameters.of(SHOP, 0.75), "mean",
                                  "full", SCHOOL)
    return rounded(out, {c: digits_of(c) for c in out.columns})


WEEKLY_SHOP = SeriesConfig("revenue", "shop", 364, ("revenue", "n_orders"), ("revenue",), resample_weekly=True,
                           non_seasonal=("n_orders",))


@query("prepare_weekly", f"""WITH {HOLIDAYS}, {COUNTERS}, {FILLED}, weeks AS (
  SELECT f.series_id, CAST(f.ds + CAST(7 - isodow(f.ds) AS INT) AS DATE) AS ds, sum(f.revenue) AS revenue,
         avg(f.n_orders) AS n_orders, avg(day(f.ds)) AS cal_date_day_of_month, avg(month(f.ds)) AS cal_date_month,
         avg(quarter(f.ds)) AS cal_date_quarter,
         avg(CASE WHEN isodow(f.ds) = 7 OR public_holiday <> 'no' THEN 0.0::DOUBLE ELSE 1 END) AS cal_date_workingday,
         {", ".join(f'avg("{c}") AS "{c}"' for c in CALS[5:])},
         {", ".join(f"avg(CASE WHEN school_holiday = '{v}' THEN 1.0::DOUBLE ELSE 0 END) AS school_holiday_{v}" for v in SCHOOL["school_holiday"])}
  FROM filled f JOIN near ON near.series_id = f.series_id AND near.ds = f.ds
  JOIN hol ON hol.series_id = f.series_id AND hol.ds = f.ds GROUP BY 1, 2),
  wnum AS (SELECT *, row_number() OVER {W} - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM weeks)
  SELECT series_id, ds, 0 AS fold, t, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS n_train,
         CASE WHEN t < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split,
         {", ".join(f'round("{c}", 3) AS "{c}"' for c in ["revenue", "n_orders", "cal_date_day_of_month", "cal_date_month",
            "cal_date_quarter", "cal_date_workingday", *CALS[5:], *[f"school_holiday_{v}" for v in SCHOOL["school_holiday"]]])}
  FROM wnum""")
def prepare_weekly(spark, sf):
    out = prepare.prepare_dataset(with_holidays(daily(spark, sf)), K, WEEKLY_SHOP, RunParameters.of(WEEKLY_SHOP, 0.8),
                                  "mean", "cal", SCHOOL)
    return rounded(out, 3)


@query("prepare_weekly_folds")
def prepare_weekly_folds(spark, sf):
    """Expanding folds, weekly rows, statistical features after resampling, components."""
    out = prepare.prepare_dataset(with_holidays(daily(spark, sf)), K, WEEKLY_SHOP, RunParameters.of(WEEKLY_SHOP, 0),
                                  "mean", "stat", {**SCHOOL, "public_holiday": ["no", "Karfreitag"]}, "pca")
    return rounded(out, 3)

