"""Series built from the driver tables, as Spark frames and as SQL common table expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcast.operators.clean import regularize
from sparkcast.session import cut_lineage

K = ["series_id"]

# Dates of Good Friday.
GOOD_FRIDAYS = ("1995-04-14", "1996-04-05", "1997-03-28", "1998-04-10",
                "1999-04-02", "2000-04-21", "2001-04-13")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Daily revenue and orders per market segment; days without an order have no row."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (orders.join(customers, orders.o_custkey == customers.c_custkey)
            .groupBy(F.col("c_mktsegment").alias("series_id"), F.to_date("o_orderdate").alias("ds"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"),
                 F.count(F.lit(1)).cast("double").alias("n_orders")))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """One row per day; the orders are read once and only their daily sums are used further."""
    return regularize(cut_lineage(sales(spark, sf)), K)


def supply(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped quantity and price per supplier and day, irregular, one series per supplier."""
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_suppkey").cast("string").alias("series_id"), F.to_date("l_shipdate").alias("ds"))
            .agg(F.round(F.sum("l_quantity"), 2).alias("qty"),
                 F.round(F.sum("l_extendedprice"), 2).alias("price")))


def stored_supply(spark: SparkSession, sf: str) -> DataFrame:
    """The supply series as a table, for queries that read it several times."""
    return cut_lineage(supply(spark, sf))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Events and summed value per event type and hour, irregular."""
    return (table(spark, sf, "events")
            .groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ds"))
            .agg(F.count(F.lit(1)).cast("double").alias("n_events"),
                 F.round(F.sum("value"), 4).alias("value")))


def status_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Daily revenue per segment split by order status: columns with gaps on different days."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")

    def part(status: str) -> Column:
        return F.round(F.sum(F.when(F.col("o_orderstatus") == status, F.col("o_totalprice"))) / 1000.0, 5)

    rows = (orders.join(customers, orders.o_custkey == customers.c_custkey)
            .groupBy(F.col("c_mktsegment").alias("series_id"), F.to_date("o_orderdate").alias("ds"))
            .agg(part("F").alias("rev_f"), part("O").alias("rev_o"), part("P").alias("rev_p")))
    return regularize(cut_lineage(rows), K)


def holiday_name() -> Column:
    day, month = F.dayofmonth("ds"), F.month("ds")
    return (F.when(F.col("ds").isin(*[dt.date.fromisoformat(d) for d in GOOD_FRIDAYS]), "Karfreitag")
            .when((month == 1) & (day == 1), "Neujahr").when((month == 5) & (day == 1), "Erster Mai")
            .when((month == 12) & day.isin(25, 26), "Weihnachten").otherwise("no"))


def school_holiday_name() -> Column:
    return (F.when(F.month("ds") == 8, "sommerferien")
            .when((F.month("ds") == 4) & (F.dayofmonth("ds") <= 14), "osterferien").otherwise("no"))


def with_holidays(df: DataFrame) -> DataFrame:
    return df.withColumns({"public_holiday": holiday_name(), "school_holiday": school_holiday_name()})


_FRIDAYS = ", ".join(f"DATE '{d}'" for d in GOOD_FRIDAYS)

SALES = """sales AS (
  SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS ds,
         round(sum(o_totalprice), 2) AS revenue, CAST(count(*) AS DOUBLE) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

DAILY = SALES + """, days AS (
  SELECT series_id, CAST(unnest(generate_series(CAST(min(ds) AS TIMESTAMP), CAST(max(ds) AS TIMESTAMP),
         INTERVAL 1 DAY)) AS DATE) AS ds FROM sales GROUP BY series_id),
daily AS (SELECT days.series_id, days.ds, revenue, n_orders FROM days LEFT JOIN sales USING (series_id, ds))"""

SUPPLY = """supply AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS ds,
         round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price
  FROM lineitem GROUP BY 1, 2)"""

HOURLY = """hourly AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ds, CAST(count(*) AS DOUBLE) AS n_events,
         round(sum(value), 4) AS value FROM events GROUP BY 1, 2)"""

STATUS = """srows AS (
  SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS ds,
         round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / 1000.0, 5) AS rev_f,
         round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) / 1000.0, 5) AS rev_o,
         round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) / 1000.0, 5) AS rev_p
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
sdays AS (
  SELECT series_id, CAST(unnest(generate_series(CAST(min(ds) AS TIMESTAMP), CAST(max(ds) AS TIMESTAMP),
         INTERVAL 1 DAY)) AS DATE) AS ds FROM srows GROUP BY series_id),
status AS (SELECT sdays.series_id, sdays.ds, rev_f, rev_o, rev_p FROM sdays LEFT JOIN srows USING (series_id, ds))"""

HOLIDAY_SQL = f"""CASE WHEN ds IN ({_FRIDAYS}) THEN 'Karfreitag'
  WHEN month(ds) = 1 AND day(ds) = 1 THEN 'Neujahr' WHEN month(ds) = 5 AND day(ds) = 1 THEN 'Erster Mai'
  WHEN month(ds) = 12 AND day(ds) IN (25, 26) THEN 'Weihnachten' ELSE 'no' END"""

SCHOOL_SQL = """CASE WHEN month(ds) = 8 THEN 'sommerferien'
  WHEN month(ds) = 4 AND day(ds) <= 14 THEN 'osterferien' ELSE 'no' END"""

HOLIDAYS = DAILY + f""", hol AS (
  SELECT *, {HOLIDAY_SQL} AS public_holiday, {SCHOOL_SQL} AS school_holiday FROM daily)"""


def rounded(df: DataFrame, digits: int | dict[str, int] = 4) -> DataFrame:
    """Doubles rounded for comparison; a dictionary names the columns."""
    def one(field):
        n = digits.get(field.name) if isinstance(digits, dict) else digits
        if field.dataType.simpleString() == "double" and n is not None:
            return F.round(F.col(field.name), n).alias(field.name)
        return F.col(field.name)

    return df.select(*[one(f) for f in df.schema.fields])
