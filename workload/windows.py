"""Lag, rolling, sequence, split and baseline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcast.operators import baselines, lags, metrics, split
from sparkcast.operators.chunks import tick, with_ordinal
from sparkcast.operators.clean import resample_weekly
from sparkcast.operators.impute import impute_simple
from sparkcast.session import cut_lineage
from workload.frames import DAILY, K, SUPPLY, daily, rounded, stored_supply, supply
from workload.registry import query

W = "(PARTITION BY series_id ORDER BY ds)"


def day():
    return tick("ds")



def lag_sql(columns, lag_list, name, shift=0):
    return ", ".join(f"lag({c}, {i + shift}) OVER {W} AS stat_{c}_{name}{i}" for c in columns for i in lag_list)


def stats_sql(c, label, width, last=1, part="series_id"):
    frame = f"(PARTITION BY {part} ORDER BY ds ROWS BETWEEN {last + width - 1} PRECEDING AND {last} PRECEDING)"
    full = f"CASE WHEN count({c}) OVER {frame} = {width} THEN"
    return (f"round({full} avg({c}) OVER {frame} END, 4) AS stat_{c}_{label}_mean{width}, "
            f"round({full} quantile_cont({c}, 0.5) OVER {frame} END, 4) AS stat_{c}_{label}_median{width}, "
            f"round({full} max({c}) OVER {frame} END, 4) AS stat_{c}_{label}_max{width}")


BOTH = ("revenue", "n_orders")


@query("lag_features", f"WITH {DAILY} SELECT *, {lag_sql(BOTH, range(1, 8), 'lag')} FROM daily")
def lag_features(spark, sf):
    return lags.add_blocks(daily(spark, sf), K, day(), [lags.lag_block(BOTH, lags.LAGS)])


@query("seasonal_lag_features", f"WITH {DAILY} SELECT *, {lag_sql(BOTH, range(1, 8), 'seaslag', 364)} FROM daily")
def seasonal_lag_features(spark, sf):
    return lags.add_blocks(daily(spark, sf), K, day(), [lags.seasonal_lag_block(BOTH, lags.LAGS, 365)])


@query("rolling_stats", f"""WITH {DAILY}
  SELECT *, {stats_sql('revenue', 'rolling', 7)}, {stats_sql('n_orders', 'rolling', 3)} FROM daily""")
def rolling_stats(spark, sf):
    return rounded(lags.add_blocks(daily(spark, sf), K, day(), [
        lags.rolling_block(["revenue"], 7), lags.rolling_block(["n_orders"], 3)]))


@query("rolling_seasonal_stats", f"""WITH {DAILY}
  SELECT *, {stats_sql('revenue', 'rolling_seasonal', 4, 366)} FROM daily""")
def rolling_seasonal_stats(spark, sf):
    return rounded(lags.add_blocks(daily(spark, sf), K, day(), [
        lags.rolling_seasonal_block(["revenue"], 4, 365), lags.rolling_seasonal_block(["n_orders"], 4, 4)]))


@query("rolling_weekday_stats", f"""WITH {DAILY}
  SELECT *, {stats_sql('revenue', 'weekday_rolling', 4, 1, 'series_id, isodow(ds)')} FROM daily""")
def rolling_weekday_stats(spark, sf):
    return rounded(lags.add_blocks(daily(spark, sf), K, day(), [lags.rolling_weekday_block(["revenue"], 4)]))


def stat_columns(stats=stats_sql):
    return ", ".join([
        lag_sql(BOTH, range(1, 8), "lag"), lag_sql(["revenue"], range(1, 8), "seaslag", 27),
        stats("revenue", "rolling", 7), stats("n_orders", "rolling", 7), stats("revenue", "rolling_seasonal", 7, 29),
        stats("revenue", "weekday_rolling", 4, 1, "series_id, isodow(ds)")])


STAT_COLUMNS = stat_columns()
# for further computation: not rounded
EXACT_STAT_COLUMNS = stat_columns(lambda *args: stats_sql(*args).replace(" END, 4) AS", " END, 12) AS"))


@query("stat_features_all", f"""WITH {DAILY}, filled AS (
  SELECT series_id, ds, coalesce(revenue, 0) AS revenue, coalesce(n_orders, 0) AS n_orders FROM daily)
  SELECT *, {STAT_COLUMNS} FROM filled""")
def stat_features_all(spark, sf):
    rows = daily(spark, sf).fillna(0.0)
    return rounded(lags.add_statistical_features(rows, K, day(), BOTH, season=28, non_seasonal=["n_orders"]))


WEEK_COLUMNS = ", ".join([
    lag_sql(BOTH, (1, 4), "lag"), lag_sql(BOTH, (1, 4), "seaslag", 51),
    *[stats_sql(c, "rolling", w) for c in BOTH for w in (4, 2)],
    *[stats_sql(c, "rolling_seasonal", w, 53) for c in BOTH for w in (4, 2)]])


@query("weekly_features", f"""WITH {DAILY}, weekly AS (
  SELECT series_id, CAST(ds + CAST(7 - isodow(ds) AS INT) AS DATE) AS ds, round(sum(revenue), 2) AS revenue,
         round(avg(n_orders), 6) AS n_orders
  FROM daily GROUP BY 1, 2 HAVING avg(n_orders) IS NOT NULL),
  numbered AS (SELECT *, row_number() OVER {W} - 1 AS t FROM weekly)
  SELECT *, {WEEK_COLUMNS} FROM numbered""")
def weekly_features(spark, sf):
    weekly = rounded(resample_weekly(daily(spark, sf), K, ["revenue"]), {"revenue": 2, "n_orders": 6})
    rows = with_ordinal(weekly, K, total=None, freq="W")
    out = lags.add_statistical_features(rows, K, "t", BOTH, season=52, lags=(1, 4), width=4, width_seasonal=4,
                                        weekday_stats=False, extra_widths=(2,))
    return rounded(out, {c: 4 for c in out.columns if "rolling" in c})


@query("sequence_windows", f"""WITH {SUPPLY}, n AS (
  SELECT series_id, ds, qty AS label, list([qty, price]) OVER (
    PARTITION BY series_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS seq FROM supply)
  SELECT series_id, ds, label, len(seq)::INT AS steps, array_to_string(list_transform(seq, lambda r:
         CAST(CAST(r[1] AS INT) AS VARCHAR) || ':' || CAST(CAST(round(r[2] * 100) AS BIGINT) AS VARCHAR)), ' ') AS seq
  FROM n WHERE len(seq) = 7""")
def sequence_windows(spark, sf):
    rows = with_ordinal(stored_supply(spark, sf), K)
    out = lags.sequence_windows(rows, K, "t", ["qty", "price"], "qty", 7)
    text = F.array_join(F.transform("seq", lambda r: F.concat_ws(
        ":", r[0].cast("int").cast("string"), F.round(r[1] * 100).cast("bigint").cast("string"))), " ")
    return out.select("series_id", "ds", "label", F.size("seq").alias("steps"), text.alias("seq"))


@query("differencing", f"""WITH {DAILY}, f AS (SELECT series_id, ds, coalesce(revenue, 0) AS y FROM daily),
  a AS (SELECT *, y - lag(y) OVER {W} AS d1 FROM f),
  b AS (SELECT *, d1 - lag(d1) OVER {W} AS d2 FROM a)
  SELECT series_id, ds, y, round(d2 - lag(d2, 7) OVER {W}, 2) AS y_diff FROM b""")
def differencing(spark, sf):
    rows = daily(spark, sf).select("series_id", "ds", F.coalesce("revenue", F.lit(0.0)).alias("y"))
    return rounded(lags.difference(rows, K, day(), "y", d=2, seasonal_d=1, season=7), {"y_diff": 2})


# splits ---------------------------------------------------------------------------------------------

NUMBERED = SUPPLY + f""", numbered AS (
  SELECT *, row_number() OVER {W} - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM supply)"""

SPLIT80 = NUMBERED + """, cut AS (
  SELECT series_id, ds, qty, price, t, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS n_train FROM numbered),
split80 AS (SELECT *, 0 AS fold, CASE WHEN t < n_train THEN 'train' ELSE 'test' END AS split FROM cut)"""


def supply_split(spark, sf):
    return split.split(stored_supply(spark, sf), K, 0.8)


@query("train_test_split", f"WITH {SPLIT80} SELECT * FROM split80")
def train_test_split(spark, sf):
    return supply_split(spark, sf)


FOLDS = NUMBERED + """, folds AS (
  SELECT series_id, ds, qty, t, CAST(unnest(range(CAST(ceil(n / 130.0) AS BIGINT))) AS INT) AS fold FROM numbered),
bounds AS (SELECT *, CAST(100 + 30 * fold AS BIGINT) AS n_train FROM folds),
tsfolds AS (SELECT *, CASE WHEN t < n_train THEN 'train' ELSE 'test' END AS split FROM bounds WHERE t < n_train + 30)"""


@query("tssplit", f"WITH {FOLDS} SELECT * FROM tsfolds")
def tssplit(spark, sf):
    return split.split(stored_supply(spark, sf).drop("price"), K, None, 100, 30)


CV = NUMBERED + """, blocks AS (
  SELECT series_id, ds, qty, t, n, n // 4 AS size, CAST(unnest([0, 1, 2]) AS INT) AS fold FROM numbered WHERE n >= 80),
cv AS (
  SELECT series_id, ds, qty, t, fold, CAST(n - (3 - fold) * size AS BIGINT) AS n_train,
         CASE WHEN t < n - (3 - fold) * size THEN 'train' ELSE 'test' END AS split
  FROM blocks WHERE t < n - (2 - fold) * size)"""


@query("cv_timeseries", f"WITH {CV} SELECT * FROM cv")
def cv_timeseries(spark, sf):
    return split.timeseries_cv(stored_supply(spark, sf).drop("price"), K)


SHUFFLED = NUMBERED + """, draws AS (
  SELECT series_id, ds, qty, t, CAST(unnest(range(5)) AS INT) AS fold, n FROM numbered WHERE n >= 80),
shuffled AS (
  SELECT series_id, ds, qty, t, fold, CASE WHEN row_number() OVER (PARTITION BY series_id, fold
           ORDER BY md5(t || '/' || fold || '/0'), t) > ceil(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM draws)"""


@query("cv_shuffle", f"WITH {SHUFFLED} SELECT * FROM shuffled")
def cv_shuffle(spark, sf):
    return split.shuffle_cv(stored_supply(spark, sf).drop("price"), K)


@query("cv_shuffle_sizes", f"""WITH {NUMBERED}
  SELECT series_id, CAST(f AS INT) AS fold, CAST(n - CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) AS BIGINT) AS n_train,
         CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) AS n_test
  FROM (SELECT DISTINCT series_id, n FROM numbered WHERE n >= 80), range(5) r(f)""")
def cv_shuffle_sizes(spark, sf):
    return cv_shuffle(spark, sf).groupBy("series_id", "fold").agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))


@query("valid_split", f"""WITH {SPLIT80}, tr AS (
  SELECT series_id, ds, qty, fold, t, count(*) OVER (PARTITION BY series_id) AS n FROM split80 WHERE split = 'train')
  SELECT series_id, ds, qty, fold, t, CASE WHEN t < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'valid' END AS split FROM tr""")
def valid_split(spark, sf):
    return split.validation_cut(supply_split(spark, sf).drop("price"), K)


@query("last_season", f"WITH {SPLIT80} SELECT * FROM split80 WHERE t >= n_train - 28 AND t < n_train")
def last_season(spark, sf):
    return split.last_season(supply_split(spark, sf), 28)


# baselines ------------------------------------------------------------------------------------------

BASE = ["series_id", "ds", "split", "qty", "prediction"]


@query("baseline_rw", f"""WITH {SPLIT80}
  SELECT series_id, ds, split, qty, lag(qty) OVER {W} AS prediction FROM split80""")
def baseline_rw(spark, sf):
    return baselines.random_walk(supply_split(spark, sf), K, "qty").select(BASE)


@query("baseline_seas_rw", f"""WITH {SPLIT80}
  SELECT series_id, ds, split, qty, lag(qty, 7) OVER {W} AS prediction FROM split80""")
def baseline_seas_rw(spark, sf):
    return baselines.random_walk(supply_split(spark, sf), K, "qty", 7).select(BASE)


@query("baseline_naive_fixed", f"""WITH {SPLIT80}
  SELECT series_id, ds, split, qty, CASE WHEN split = 'test' THEN
           max(CASE WHEN t = n_train - 1 THEN qty END) OVER (PARTITION BY series_id) ELSE lag(qty) OVER {W} END AS prediction
  FROM split80""")
def baseline_naive_fixed(spark, sf):
    return baselines.naive_fixed(supply_split(spark, sf), K, "qty").select(BASE)


@query("baseline_seas_naive_fixed", f"""WITH {SPLIT80}, season AS (
  SELECT series_id, list(qty ORDER BY t) AS last FROM split80 WHERE t >= n_train - 28 AND t < n_train GROUP BY series_id),
  before AS (SELECT *, lag(qty, 28) OVER {W} AS earlier FROM split80)
  SELECT b.series_id, b.ds, b.split, b.qty,
         CASE WHEN b.split = 'test' THEN last[(b.t - b.n_train) % 28 + 1] ELSE earlier END AS prediction
  FROM before b LEFT JOIN season USING (series_id)""")
def baseline_seas_naive_fixed(spark, sf):
    return baselines.seasonal_naive_fixed(supply_split(spark, sf), K, "qty", 28).select(BASE)


@query("baseline_ha", f"""WITH {SPLIT80}
  SELECT series_id, ds, split, qty,
         round(avg(CASE WHEN split = 'train' THEN qty END) OVER (PARTITION BY series_id), 4) AS prediction FROM split80""")
def baseline_ha(spark, sf):
    out = baselines.historical_average(supply_split(spark, sf), K, "qty", one_step=False, name="prediction")
    return rounded(out).select(BASE)


@query("baseline_ha_osa", f"""WITH {SPLIT80}
  SELECT series_id, ds, split, qty, round(CASE WHEN split = 'train'
           THEN avg(CASE WHEN split = 'train' THEN qty END) OVER (PARTITION BY series_id)
           ELSE avg(qty) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         END, 4) AS prediction FROM split80""")
def baseline_ha_osa(spark, sf):
    out = baselines.historical_average(supply_split(spark, sf), K, "qty", name="prediction")
    return rounded(out).select(BASE)


# metrics --------------------------------------------------------------------------------------------

PAIRS = SPLIT80 + f""", wide AS (
  SELECT series_id, ds, split, qty AS actual, lag(qty) OVER {W} AS "RW", lag(qty, 7) OVER {W} AS "seasRW",
         CASE WHEN split = 'train' THEN avg(CASE WHEN split = 'train' THEN qty END) OVER (PARTITION BY series_id)
           ELSE avg(qty) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         END AS "HA" FROM split80),
pairs AS (
  SELECT series_id, ds, split, actual, 'RW' AS model, "RW" AS prediction FROM wide UNION ALL
  SELECT series_id, ds, split, actual, 'seasRW', "seasRW" FROM wide UNION ALL
  SELECT series_id, ds, split, actual, 'HA', "HA" FROM wide)"""

RMSE = "sqrt(avg((prediction - actual) ** 2))"
MAPE = "100 * avg(abs((actual - prediction) / (actual + 0.1::DOUBLE)))"
SMAPE = ("100.0::DOUBLE / count(*) * coalesce(sum(abs(prediction - actual) / nullif((abs(actual) + abs(prediction)) / 2, 0)), 0)")
SCORES = PAIRS + f""", scores AS (
  SELECT series_id, split, model, {RMSE} AS rmse, {MAPE} AS mape, {SMAPE} AS smape, count(*) AS n_scored
  FROM pairs WHERE prediction IS NOT NULL GROUP BY 1, 2, 3)"""


def baseline_pairs(spark, sf, rows=None):
    wide = baselines.one_step_baselines(rows if rows is not None else supply_split(spark, sf), K, "qty", 7)
    return baselines.long_predictions(wide, K, "qty", ["RW", "seasRW", "HA"])


for _metric in metrics.METRICS:
    @query(f"metric_{_metric}", f"""WITH {SCORES}
      SELECT series_id, split, model, round({_metric}, 6) AS {_metric}, n_scored FROM scores""")
    def one_metric(spark, sf, _metric=_metric):
        out = metrics.score(baseline_pairs(spark, sf), ["series_id", "split", "model"], metrics=[_metric])
        return rounded(out, 6)


@query("eval_metrics", f"""WITH {SCORES}
  SELECT series_id, split, model, round(rmse, 6) AS rmse, round(mape, 6) AS mape, round(smape, 6) AS smape, n_scored
  FROM scores""")
def eval_metrics(spark, sf):
    return rounded(metrics.score(baseline_pairs(spark, sf), ["series_id", "split", "model"]), 6)


FOLD_SCORES = """, fold_pairs AS (
  SELECT *, qty AS actual, lag(qty, 7) OVER (PARTITION BY series_id, fold ORDER BY t) AS prediction FROM {source}),
fold_scores AS (
  SELECT series_id, fold, """ + f"{RMSE} AS rmse, {MAPE} AS mape, {SMAPE} AS smape" + """
  FROM fold_pairs WHERE split = 'test' AND prediction IS NOT NULL GROUP BY 1, 2)"""


def fold_scores(rows):
    keys = [*K, "fold"]
    pairs = baselines.random_walk(rows, keys, "qty", 7).withColumn("actual", F.col("qty"))
    return metrics.score(pairs.filter(F.col("split") == "test"), keys)


@query("fold_mean", f"""WITH {FOLDS}{FOLD_SCORES.format(source='tsfolds')}
  SELECT series_id, round(avg(rmse), 6) AS rmse, round(avg(mape), 6) AS mape, round(avg(smape), 6) AS smape
  FROM fold_scores GROUP BY 1""")
def fold_mean(spark, sf):
    rows = split.test_folds(stored_supply(spark, sf), K, 100, 30)
    pairs = baselines.random_walk(rows, K, "qty", 7).withColumn("actual", F.col("qty"))
    scores = metrics.score(pairs.filter(F.col("fold").isNotNull()), [*K, "fold"])
    return rounded(metrics.mean_over_folds(scores, K), 6)


CV_COLUMNS = ", ".join(
    f"round(avg({m}), 6) AS ts_cv_{m}_mean, round(stddev_pop({m}), 6) AS ts_cv_{m}_std, "
    + ", ".join(f"round(max({m}) FILTER (WHERE fold = {i}), 6) AS ts_cv_{m}_{i}" for i in range(3))
    for m in metrics.METRICS)


@query("cv_summary", f"""WITH {CV}{FOLD_SCORES.format(source='cv')}
  SELECT series_id, {CV_COLUMNS} FROM fold_scores GROUP BY 1""")
def cv_summary(spark, sf):
    return rounded(metrics.cv_summary(fold_scores(cv_timeseries(spark, sf)), K, 3), 6)


@query("interval_coverage", f"""WITH {PAIRS}, err AS (
  SELECT series_id, model, stddev_pop(actual - prediction) AS sd FROM pairs WHERE split = 'train' GROUP BY 1, 2)
  SELECT series_id, model, round(avg(CASE WHEN abs(actual - prediction) <= 2 * sd THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage,
         count(*) AS n_scored
  FROM pairs JOIN err USING (series_id, model) WHERE split = 'test' AND prediction IS NOT NULL GROUP BY 1, 2""")
def interval_coverage(spark, sf):
    pairs = baseline_pairs(spark, sf)
    spread = pairs.filter(F.col("split") == "train").groupBy("series_id", "model").agg(
        F.stddev_pop(F.col("actual") - F.col("prediction")).alias("sd"))
    test = pairs.filter(F.col("split") == "test").join(spread, ["series_id", "model"])
    return rounded(metrics.interval_coverage(metrics.with_interval(test, F.lit(2.0) * F.col("sd")), ["series_id", "model"]), 6)


@query("best_runs", f"""WITH {SCORES}, runs AS (
  SELECT series_id AS dataset, row_number() OVER (PARTITION BY series_id ORDER BY model) AS run, rmse, mape, smape
  FROM scores WHERE split = 'test'),
  long AS (
    SELECT dataset, run, 'rmse' AS metric, round(rmse, 6) AS value FROM runs UNION ALL
    SELECT dataset, run, 'mape', round(mape, 6) FROM runs UNION ALL SELECT dataset, run, 'smape', round(smape, 6) FROM runs)
  SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY dataset, metric ORDER BY value NULLS LAST, run) = 1""")
def best_runs(spark, sf):
    scores = eval_metrics(spark, sf).filter(F.col("split") == "test")
    number = F.when(F.col("model") == "HA", 1).when(F.col("model") == "RW", 2).otherwise(3).cast("bigint")
    runs = scores.select(F.col("series_id").alias("dataset"), number.alias("run"), *metrics.METRICS)
    return metrics.best_runs(runs, metrics.METRICS)


FLAG = DAILY + f""", num AS (
  SELECT *, row_number() OVER {W} - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM daily),
sp AS (SELECT *, CASE WHEN t < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM num),
fil AS (
  SELECT series_id, ds, split, coalesce(revenue, avg(CASE WHEN split = 'train' THEN revenue END)
         OVER (PARTITION BY series_id)) AS y FROM sp),
wide AS (
  SELECT series_id, ds, split, y AS actual, lag(y) OVER {W} AS "RW", lag(y, 7) OVER {W} AS "seasRW",
         CASE WHEN split = 'train' THEN avg(CASE WHEN split = 'train' THEN y END) OVER (PARTITION BY series_id)
           ELSE avg(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         END AS "HA" FROM fil),
pairs AS (
  SELECT series_id, ds, split, actual, 'RW' AS model, "RW" AS prediction FROM wide UNION ALL
  SELECT series_id, ds, split, actual, 'seasRW', "seasRW" FROM wide UNION ALL
  SELECT series_id, ds, split, actual, 'HA', "HA" FROM wide),
scores AS (
  SELECT series_id, split, model, {RMSE} AS rmse, {MAPE} AS mape, {SMAPE} AS smape, count(*) AS n_scored
  FROM pairs WHERE prediction IS NOT NULL GROUP BY 1, 2, 3)"""


@query("evaluate_baselines", f"""WITH {FLAG}
  SELECT series_id, split, model, round(rmse, 4) AS rmse, round(mape, 6) AS mape, round(smape, 6) AS smape, n_scored
  FROM scores""")
def evaluate_baselines(spark, sf):
    rows = split.split(daily(spark, sf).select("series_id", "ds", F.col("revenue").alias("qty")), K, 0.8)
    filled = cut_lineage(impute_simple(rows, K, ["qty"]))
    scores = metrics.score(baseline_pairs(spark, sf, filled), ["series_id", "split", "model"])
    return rounded(scores, {"rmse": 4, "mape": 6, "smape": 6})
