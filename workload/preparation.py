"""Sources, clean-up, calendar and one-hot queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sparkcast.operators import calendar, clean
from sparkcast.sources import results, series
from workload.frames import (DAILY, HOLIDAYS, HOURLY, K, SALES, SCHOOL_SQL, SUPPLY, daily, hourly, rounded, sales, stored_supply,
                             supply, table, with_holidays)
from workload.registry import query

BREAK = dt.date(2000, 6, 1)


@query("parse_dates", """
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ds, CAST(o_orderdate AS DATE) AS ds_iso,
         CAST(NULL AS DATE) AS ds_bad FROM orders""")
def parse_dates(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("dotted"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("bad"))
    return rows.select("o_orderkey", series.parse_date(F.col("dotted")).alias("ds"),
                       series.parse_date(F.col("iso")).alias("ds_iso"), series.parse_date(F.col("bad")).alias("ds_bad"))


@query("parse_numbers", """
  SELECT l_orderkey, l_linenumber, l_extendedprice AS price, CAST(l_returnflag = 'R' AS DOUBLE) AS flag FROM lineitem""")
def parse_numbers(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.regexp_replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), r"\.", ",").alias("price"),
        F.when(F.col("l_returnflag") == "R", "True").otherwise("False").alias("flag"))
    return rows.select("l_orderkey", "l_linenumber", series.parse_number(F.col("price")).alias("price"),
                       series.parse_number(F.col("flag")).alias("flag"))


@query("regularize_daily", f"WITH {DAILY} SELECT * FROM daily")
def regularize_daily(spark, sf):
    return daily(spark, sf)


@query("regularize_hourly", f"""WITH {HOURLY}, hours AS (
  SELECT series_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 HOUR)) AS ds FROM hourly GROUP BY 1)
  SELECT hours.series_id, hours.ds, n_events, value FROM hours LEFT JOIN hourly USING (series_id, ds)""")
def regularize_hourly(spark, sf):
    return clean.regularize(hourly(spark, sf), K, freq="H")


@query("set_dtypes", """
  SELECT CAST(o_orderdate AS DATE) AS ds, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
         CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice FROM orders""")
def set_dtypes(spark, sf):
    rows = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("ds"), "o_orderkey", "o_orderstatus",
                                             "o_custkey", "o_totalprice")
    return series.set_types(rows, ["o_orderkey", "o_orderstatus"])


@query("load_datasets", f"""WITH {DAILY}
  SELECT 'shop' AS dataset, * FROM daily UNION ALL
  SELECT 'shop_before_break' AS dataset, * FROM daily WHERE ds < DATE '2000-06-01'""")
def load_datasets(spark, sf):
    return series.load_datasets(daily(spark, sf), "shop", BREAK)


@query("format_results", f"""WITH {SALES}
  SELECT series_id, CAST(count(*) AS BIGINT) AS n, replace(printf('%.10f', max(n_orders)), '.', ',') AS peak,
         replace(printf('%.10f', round(avg(revenue), 2)), '.', ',') AS mean_revenue FROM sales GROUP BY 1""")
def format_results(spark, sf):
    report = sales(spark, sf).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("n_orders").alias("peak"), F.round(F.avg("revenue"), 2).alias("mean_revenue"))
    return results.format_results(report)


@query("drop_columns", f"WITH {DAILY} SELECT series_id, ds, n_orders FROM daily")
def drop_columns(spark, sf):
    return clean.drop_columns(daily(spark, sf), ["revenue"])


@query("drop_rows_by_dates", f"""WITH {DAILY}
  SELECT * FROM daily WHERE ds < DATE '1998-03-01' OR ds > DATE '1998-05-31'""")
def drop_rows_by_dates(spark, sf):
    return clean.drop_rows_by_dates(daily(spark, sf), dt.date(1998, 3, 1), dt.date(1998, 5, 31))


@query("before_break", f"WITH {DAILY} SELECT * FROM daily WHERE ds < DATE '2000-06-01'")
def before_break(spark, sf):
    return series.before_break(daily(spark, sf), BREAK)


@query("condense_columns", f"""WITH {DAILY}
  SELECT series_id, ds, round(revenue + n_orders, 4) AS total FROM daily""")
def condense_columns(spark, sf):
    return rounded(clean.condense(daily(spark, sf), ["revenue", "n_orders"], "total"))


@query("drop_null_target", f"WITH {DAILY} SELECT * FROM daily WHERE revenue IS NOT NULL")
def drop_null_target(spark, sf):
    return clean.drop_null_target(daily(spark, sf), "revenue")


@query("drop_nontarget", f"WITH {SUPPLY} SELECT series_id, ds, qty FROM supply")
def drop_nontarget(spark, sf):
    return clean.drop_other_targets(supply(spark, sf), ["qty", "price"], "qty")


@query("drop_dummy", f"""WITH {SUPPLY}
  SELECT series_id, ds, qty AS actual, lag(qty) OVER (PARTITION BY series_id ORDER BY ds) AS prediction
  FROM supply QUALIFY prediction IS NOT NULL""")
def drop_dummy(spark, sf):
    from sparkcast.operators import baselines
    from sparkcast.operators.chunks import with_ordinal

    rows = with_ordinal(stored_supply(spark, sf), K).drop("n_rows")
    sentinel = baselines.random_walk(rows, K, "qty").withColumn("prediction", F.coalesce("prediction", F.lit(-9999.0)))
    return (clean.drop_unpredicted(sentinel, dummy=-9999.0)
            .select("series_id", "ds", F.col("qty").alias("actual"), "prediction"))


@query("null_check", f"""WITH {DAILY}, n AS (
  SELECT series_id, 'revenue' AS "column", count(*) - count(revenue) AS n_null FROM daily GROUP BY 1 UNION ALL
  SELECT series_id, 'n_orders', count(*) - count(n_orders) FROM daily GROUP BY 1)
  SELECT series_id, "column", CAST(n_null AS BIGINT) AS n_null, n_null > 0 AS has_null FROM n""")
def null_check(spark, sf):
    return clean.null_counts(daily(spark, sf), K, ["revenue", "n_orders"])


@query("nan_zero", f"""WITH {DAILY} SELECT series_id, ds, coalesce(revenue, 0) AS revenue FROM daily""")
def nan_zero(spark, sf):
    rows = daily(spark, sf).withColumn("revenue", F.coalesce("revenue", F.lit(float("nan"))))
    return rows.select("series_id", "ds", clean.zero_if_missing(F.col("revenue")).alias("revenue"))


@query("reset_index", f"""WITH {SUPPLY}
  SELECT series_id, qty, price, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS t FROM supply""")
def reset_index(spark, sf):
    return clean.reset_index(stored_supply(spark, sf), K)


@query("duplicate_columns", """
  SELECT 'b' AS "column" FROM lineitem HAVING bool_and(l_tax IS NOT DISTINCT FROM l_tax)
  UNION SELECT 'e' FROM lineitem
  HAVING bool_and(CASE WHEN l_discount > 0.05 THEN l_quantity END
                  IS NOT DISTINCT FROM CASE WHEN NOT l_discount <= 0.05 THEN l_quantity END)""")
def duplicate_columns(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        F.col("l_tax").alias("a"), F.col("l_tax").alias("b"), F.col("l_discount").alias("c"),
        F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("d"),
        F.when(~(F.col("l_discount") <= 0.05), F.col("l_quantity")).alias("e"),
        F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("g"))
    return clean.duplicate_columns(wide)


@query("drop_null_features", f"WITH {DAILY} SELECT series_id, ds, month(ds)::DOUBLE AS m FROM daily")
def drop_null_features(spark, sf):
    rows = daily(spark, sf).withColumn("m", F.month("ds").cast("double"))
    return clean.drop_null_features(rows, ["revenue", "n_orders", "m"])


@query("align_actual_pred", f"""WITH {SUPPLY}
  SELECT series_id, ds, qty AS actual, old AS prediction, round(qty - old, 4) AS error
  FROM (SELECT *, max(qty) OVER w AS old, count(*) OVER w AS n FROM supply
        WINDOW w AS (PARTITION BY series_id ORDER BY ds RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 7 DAYS PRECEDING))
  WHERE n > 0""")
def align_actual_pred(spark, sf):
    rows = supply(spark, sf)
    actual = rows.select("series_id", "ds", F.col("qty").alias("actual"))
    week_old = rows.select("series_id", F.date_add("ds", 7).alias("ds"), F.col("qty").alias("prediction"))
    return rounded(clean.align(actual, week_old, K).withColumn("error", F.col("actual") - F.col("prediction")))


@query("train_test_union", f"""WITH {SALES}
  SELECT *, CASE WHEN ds < DATE '2000-06-01' THEN 'train' ELSE 'test' END AS split FROM sales""")
def train_test_union(spark, sf):
    rows = sales(spark, sf)
    return clean.union_train_test(rows.filter(F.col("ds") < F.lit(BREAK)), rows.filter(F.col("ds") >= F.lit(BREAK)))


@query("long_series", f"""WITH {DAILY}
  SELECT series_id, ds, 'revenue' AS "column", revenue AS value FROM daily WHERE revenue IS NOT NULL UNION ALL
  SELECT series_id, ds, 'n_orders', n_orders FROM daily WHERE n_orders IS NOT NULL""")
def long_series(spark, sf):
    return clean.long_series(daily(spark, sf), K, ["revenue", "n_orders"])


@query("one_hot", f"""WITH {HOLIDAYS}
  SELECT series_id, ds, CAST(school_holiday = 'no' AS INT) AS school_holiday_no,
         CAST(school_holiday = 'osterferien' AS INT) AS school_holiday_osterferien,
         CAST(school_holiday = 'sommerferien' AS INT) AS school_holiday_sommerferien FROM hol""")
def one_hot(spark, sf):
    rows = with_holidays(daily(spark, sf)).select("series_id", "ds", "school_holiday")
    return clean.one_hot(rows, clean.categories_of(rows, ["school_holiday"]))


@query("resample_weekly", f"""WITH {DAILY}
  SELECT series_id, CAST(ds + CAST(7 - isodow(ds) AS INT) AS DATE) AS ds, coalesce(sum(revenue), 0) AS revenue,
         round(avg(n_orders), 6) AS n_orders
  FROM daily GROUP BY series_id, CAST(ds + CAST(7 - isodow(ds) AS INT) AS DATE) HAVING avg(n_orders) IS NOT NULL""".replace(
    "coalesce(sum(revenue), 0)", "round(coalesce(sum(revenue), 0), 2)"))
def resample_weekly(spark, sf):
    return rounded(clean.resample_weekly(daily(spark, sf), K, ["revenue"]), {"revenue": 2, "n_orders": 6})


CALENDAR_SQL = """day(ds)::INT AS cal_date_day_of_month, (isodow(ds) - 1)::INT AS cal_date_weekday,
  month(ds)::INT AS cal_date_month, quarter(ds)::INT AS cal_date_quarter"""

SPECIAL_SQL = """CASE WHEN strftime(ds, '%m-%d') = '02-14' THEN 'Valentine'
  WHEN month(ds) = 5 AND isodow(ds) = 7 AND (day(ds) - 1) // 7 = 1 THEN 'MothersDay' ELSE public_holiday END"""

COUNTERS = f"""special AS (SELECT series_id, ds, {SPECIAL_SQL} AS holiday FROM hol),
near AS (
  SELECT d.series_id, d.ds,
         CAST(coalesce(max(h.ds) - d.ds, 99) AS INT) AS "cal_PublicHoliday_Counter",
         CAST(coalesce(max(CASE WHEN h.holiday = 'Valentine' THEN h.ds END) - d.ds, 99) AS INT) AS "cal_Valentine_Counter",
         CAST(coalesce(max(CASE WHEN h.holiday = 'MothersDay' THEN h.ds END) - d.ds, 99) AS INT) AS "cal_MothersDay_Counter",
         CAST(coalesce(max(CASE WHEN h.holiday = 'Karfreitag' THEN h.ds END) - d.ds, 99) AS INT) AS "cal_Karfreitag_Counter"
  FROM special d LEFT JOIN special h
    ON h.series_id = d.series_id AND h.holiday <> 'no' AND h.ds BETWEEN d.ds - 3 AND d.ds + 7
  GROUP BY 1, 2)"""


@query("calendar_features", f"WITH {SUPPLY} SELECT series_id, ds, {CALENDAR_SQL} FROM supply")
def calendar_features(spark, sf):
    return calendar.add_date_parts(supply(spark, sf).select("series_id", "ds"))


@query("working_day", f"""WITH {HOLIDAYS}
  SELECT series_id, ds, NOT (isodow(ds) = 7 OR public_holiday <> 'no') AS cal_date_workingday FROM hol""")
def working_day(spark, sf):
    return calendar.add_working_day(with_holidays(daily(spark, sf))).select("series_id", "ds", "cal_date_workingday")


@query("special_days", f"WITH {HOLIDAYS} SELECT series_id, ds, {SPECIAL_SQL} AS public_holiday FROM hol")
def special_days(spark, sf):
    return calendar.add_special_days(with_holidays(daily(spark, sf))).select("series_id", "ds", "public_holiday")


@query("holiday_counters", f"""WITH {HOLIDAYS}, {COUNTERS} SELECT * FROM near""")
def holiday_counters(spark, sf):
    rows = with_holidays(daily(spark, sf)).select("series_id", "ds", "public_holiday")
    return calendar.add_holiday_counters(calendar.add_special_days(rows), K)


@query("holiday_counters_sparse_lags", f"""WITH {HOLIDAYS},
  special AS (SELECT series_id, ds, {SPECIAL_SQL} AS holiday FROM hol)
  SELECT d.series_id, d.ds, CAST(coalesce(max(h.ds) - d.ds, 99) AS INT) AS "cal_PublicHoliday_Counter"
  FROM special d LEFT JOIN special h
    ON h.series_id = d.series_id AND h.holiday <> 'no' AND d.ds - h.ds IN (-14, -7, 0, 2)
  GROUP BY 1, 2""")
def holiday_counters_sparse_lags(spark, sf):
    rows = with_holidays(daily(spark, sf)).select("series_id", "ds", "public_holiday")
    return calendar.add_holiday_counters(calendar.add_special_days(rows), K, event_lags=(-14, -7, 0, 2), special_days=())


@query("calendar_features_all", f"""WITH {HOLIDAYS}, {COUNTERS}
  SELECT hol.series_id, hol.ds, {CALENDAR_SQL.replace('(ds)', '(hol.ds)')},
         NOT (isodow(hol.ds) = 7 OR public_holiday <> 'no') AS cal_date_workingday, school_holiday,
         near.* EXCLUDE (series_id, ds)
  FROM hol JOIN near ON hol.series_id = near.series_id AND hol.ds = near.ds""")
def calendar_features_all(spark, sf):
    rows = with_holidays(daily(spark, sf)).select("series_id", "ds", "public_holiday", "school_holiday")
    return calendar.add_calendar_features(rows, K)
