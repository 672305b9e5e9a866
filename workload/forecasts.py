"""Model, evaluation and dataset-preparation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sparkcast.models import arima, evaluate, gp, linear, smoothing, trees
from sparkcast.operators import lags, metrics
from sparkcast.operators.split import split
from sparkcast.plans import experiment
from sparkcast.sources.series import RunParameters, SeriesConfig
from workload.frames import DAILY, K, daily, rounded, with_holidays
from workload.registry import query
from workload.windows import MAPE, RMSE, SMAPE, W, day

FEATURES = ["x1", "x7", "x14", "trend", "sunday"]


def model_rows(spark, sf):
    """Revenue in millions, its lags, a trend and a Sunday flag, split 80 to 20."""
    rows = daily(spark, sf).select("series_id", "ds", (F.coalesce("revenue", F.lit(0.0)) / 1e6).alias("y"))
    rows = lags.add_blocks(rows, K, day(), [(lambda make: {
        f"x{i}": F.lag("y", i).over(make()) for i in (1, 7, 14)}, 14)])
    rows = rows.withColumns({"trend": (F.unix_date("ds") - 9131) / 1000.0, "sunday": (F.weekday("ds") == 6).cast("double")})
    return split(rows, K, 0.8)


ROWS = DAILY + f""", base AS (
  SELECT series_id, ds, coalesce(revenue, 0) / 1e6 AS y, row_number() OVER {W} - 1 AS t,
         count(*) OVER (PARTITION BY series_id) AS n FROM daily),
mrows AS (
  SELECT series_id, ds, y, t, lag(y, 7) OVER {W} AS x7, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS n_train,
         CASE WHEN t < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM base)"""

FIT = """count(*) AS n, avg(x7) AS mx, avg(y) AS my, sum(x7 * x7) - count(*) * avg(x7) * avg(x7) AS sxx,
         sum(x7 * y) - count(*) * avg(x7) * avg(y) AS sxy"""


def one_config(method="ridge", **values):
    return [linear.LinearConfig(method, **values)]


@query("fixed_origin_ridge", f"""WITH {ROWS}, f AS (
  SELECT series_id, {FIT} FROM mrows WHERE split = 'train' AND x7 IS NOT NULL GROUP BY 1)
  SELECT series_id, ds, split, round(my + sxy / (sxx + 2.0::DOUBLE) * (x7 - mx), 6) AS prediction
  FROM mrows JOIN f USING (series_id) WHERE x7 IS NOT NULL""")
def fixed_origin_ridge(spark, sf):
    rows = model_rows(spark, sf)
    models = linear.fit(rows, K, ["x7"], "y", one_config(alpha=2.0))
    out = linear.predict(rows.filter(F.col("x7").isNotNull()), models, K, ["x7"])
    return rounded(out.select("series_id", "ds", "split", "prediction"), 6)


def shrunk_query(name, method, l1, l2):
    """Lasso and elastic net of one feature in closed form."""
    @query(name, f"""WITH {ROWS}, f AS (
      SELECT series_id, {FIT} FROM mrows WHERE split = 'train' AND x7 IS NOT NULL GROUP BY 1)
      SELECT series_id, ds, split, round(my + sign(sxy) * greatest(abs(sxy) / n - {l1}::DOUBLE, 0)
             / (sxx / n + {l2}::DOUBLE) * (x7 - mx), 6) AS prediction
      FROM mrows JOIN f USING (series_id) WHERE x7 IS NOT NULL""")
    def run(spark, sf):
        rows = model_rows(spark, sf)
        models = linear.fit(rows, K, ["x7"], "y", one_config(method, alpha=0.004, l1_ratio=0.25))
        out = linear.predict(rows.filter(F.col("x7").isNotNull()), models, K, ["x7"])
        return rounded(out.select("series_id", "ds", "split", "prediction"), 6)


shrunk_query("fixed_origin_lasso", "lasso", 0.004, 0.0)
shrunk_query("fixed_origin_elasticnet", "elasticnet", 0.001, 0.003)


ROLLED = ROWS + """, run AS (
  SELECT series_id, ds, split, t, y, x7, count(x7) OVER w AS n, sum(x7) OVER w AS sx,
         sum(CASE WHEN x7 IS NOT NULL THEN y END) OVER w AS sy, sum(x7 * x7) OVER w AS sx2, sum(x7 * y) OVER w AS sxy
  FROM mrows WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rolled AS (
  SELECT series_id, ds, split, t, y, sy / n + (sxy - sx * sy / n) / (sx2 - sx * sx / n + 2.0::DOUBLE) * (x7 - sx / n) AS prediction
  FROM run WHERE split = 'test')"""


@query("rolling_origin_ridge", f"WITH {ROLLED} SELECT series_id, ds, round(prediction, 6) AS prediction FROM rolled")
def rolling_origin_ridge(spark, sf):
    out = linear.rolling_origin(model_rows(spark, sf), K, ["x7"], "y", one_config(alpha=2.0))
    return rounded(out.select("series_id", "ds", "prediction"), 6)


def linear_query(name, configs, interval=None):
    @query(name)
    def run(spark, sf):
        rows = model_rows(spark, sf)
        out = linear.rolling_origin(rows, K, FEATURES, "y", configs, interval)
        return rounded(out, 5)


linear_query("ridge_forecast", linear.grid_of("ridge", {"alpha": [0.1, 10.0], "normalize": [False, True]}))
linear_query("lasso_forecast", linear.grid_of("lasso", {"alpha": [0.001, 0.01]}))
linear_query("elasticnet_forecast", linear.grid_of("elasticnet", {"alpha": [0.01], "l1_ratio": [0.1, 0.9]}))


@query("bayesridge_forecast")
def bayesridge_forecast(spark, sf):
    rows = model_rows(spark, sf)
    models = linear.fit(rows, K, FEATURES, "y", one_config("bayesridge"))
    return rounded(linear.predict(rows, models, K, FEATURES, interval=1.0).drop("n_train"), 5)


@query("ard_forecast")
def ard_forecast(spark, sf):
    out = linear.rolling_origin(model_rows(spark, sf), K, FEATURES, "y", one_config("ard"), interval=1.0)
    return rounded(out, 4)


@query("interval_coverage_model")
def interval_coverage_model(spark, sf):
    rows = model_rows(spark, sf)
    models = linear.fit(rows, K, FEATURES, "y", one_config("bayesridge"))
    scored = linear.predict(rows.filter(F.col("split") == "test"), models, K, FEATURES, interval=1.0)
    return rounded(metrics.interval_coverage(scored, K, "y"), 6)


SES = ROWS + """, ses AS (
  SELECT series_id, t, y, y AS level, y AS prediction FROM mrows WHERE t = 0 UNION ALL
  SELECT m.series_id, m.t, m.y, 0.3::DOUBLE * m.y + 0.7::DOUBLE * s.level, s.level
  FROM ses s JOIN mrows m ON m.series_id = s.series_id AND m.t = s.t + 1)"""


@query("ses_forecast", f"""WITH RECURSIVE {SES}
  SELECT series_id, t, round(y, 6) AS y, round(prediction, 6) AS prediction FROM ses""")
def ses_forecast(spark, sf):
    rows = model_rows(spark, sf)
    out = smoothing.smoothing_forecast(rows, K, "y", smoothing.SmoothingConfig(), np.array([0.3, 0.0, 0.0, 1.0]))
    return rounded(out.select("series_id", "t", "y", "prediction"), 6)


@query("holt_winters_fixed", f"""WITH RECURSIVE {ROWS}, head AS (
  SELECT series_id, avg(y) FILTER (WHERE t < 7) AS level, (avg(y) FILTER (WHERE t >= 7) - avg(y) FILTER (WHERE t < 7)) / 7 AS trend,
         list(y ORDER BY t) FILTER (WHERE t < 7) AS ys FROM mrows WHERE t < 14 GROUP BY 1),
hw AS (
  SELECT series_id, CAST(-1 AS BIGINT) AS t, level, trend, list_transform(ys, lambda v: v - level) AS season,
         CAST(NULL AS DOUBLE) AS prediction FROM head UNION ALL
  SELECT series_id, t, 0.3::DOUBLE * (y - s) + 0.7::DOUBLE * (level + trend),
         0.1::DOUBLE * (0.3::DOUBLE * (y - s) + 0.7::DOUBLE * (level + trend) - level) + 0.9::DOUBLE * trend,
         list_concat(list_concat(season[1:place - 1], [0.2::DOUBLE * (y - level - trend) + 0.8::DOUBLE * s]), season[place + 1:7]),
         level + trend + s
  FROM (SELECT m.series_id, m.t, m.y, h.level, h.trend, h.season, CAST(m.t % 7 AS INT) + 1 AS place,
               h.season[CAST(m.t % 7 AS INT) + 1] AS s
        FROM hw h JOIN mrows m ON m.series_id = h.series_id AND m.t = h.t + 1))
SELECT series_id, t, round(prediction, 6) AS prediction FROM hw WHERE t >= 0""")
def holt_winters_fixed(spark, sf):
    rows = model_rows(spark, sf)
    cfg = smoothing.SmoothingConfig("add", False, "add", 7)
    out = smoothing.smoothing_forecast(rows, K, "y", cfg, np.array([0.3, 0.1, 0.2, 1.0]))
    return rounded(out.select("series_id", "t", "prediction"), 6)


@query("holt_winters_forecast")
def holt_winters_forecast(spark, sf):
    cfg = smoothing.SmoothingConfig("add", True, "add", 7, remove_bias=True)
    out = smoothing.smoothing_forecast(model_rows(spark, sf), K, "y", cfg)
    return rounded(out.select("series_id", "ds", "split", "y", "prediction"), 5)


@query("holt_winters_multiplicative_log")
def holt_winters_multiplicative_log(spark, sf):
    rows = model_rows(spark, sf)
    mul = smoothing.smoothing_forecast(rows, K, "y", smoothing.SmoothingConfig(None, False, "mul", 7), one_step=False)
    log = smoothing.smoothing_forecast(rows, K, "y", smoothing.SmoothingConfig("add", False, "add", 7, transf="log"))
    ids = ["series_id", "ds", "split", "y"]
    return rounded(mul.select(*ids, F.lit("mul").alias("model"), "prediction").unionByName(
        log.select(*ids, F.lit("log").alias("model"), "prediction")), 5)


@query("ar1_forecast", f"""WITH {ROWS}, l AS (SELECT *, lag(y) OVER {W} AS x FROM mrows), f AS (
  SELECT series_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b,
         (regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) AS v
  FROM l WHERE split = 'train' AND x IS NOT NULL GROUP BY 1)
  SELECT series_id, ds, round(my + b * (x - mx), 6) AS prediction,
         round(my + b * (x - mx) - 1.959963984540054::DOUBLE * sqrt(v), 6) AS lower_conf,
         round(my + b * (x - mx) + 1.959963984540054::DOUBLE * sqrt(v), 6) AS upper_conf FROM l JOIN f USING (series_id)""")
def ar1_forecast(spark, sf):
    out = arima.arima_forecast(model_rows(spark, sf), K, "y", arima.ArimaConfig(p=1))
    return rounded(out.select("series_id", "ds", "prediction", "lower_conf", "upper_conf"), 6)


@query("seasonal_difference_forecast", f"""WITH {ROWS}, w AS (SELECT *, y - lag(y, 7) OVER {W} AS w FROM mrows),
  f AS (SELECT series_id, avg(w) AS c FROM w WHERE split = 'train' GROUP BY 1)
  SELECT series_id, ds, round(lag(y, 7) OVER (PARTITION BY series_id ORDER BY ds) + c, 6) AS prediction FROM w JOIN f USING (series_id)""")
def seasonal_difference_forecast(spark, sf):
    """A seasonal random walk with drift: orders (0, 0, 0)(0, 1, 0)."""
    out = arima.arima_forecast(model_rows(spark, sf), K, "y", arima.ArimaConfig(p=0, seasonal_d=1, season=7))
    return rounded(out.select("series_id", "ds", "prediction"), 6)


@query("arx_forecast")
def arx_forecast(spark, sf):
    out = arima.arima_forecast(model_rows(spark, sf), K, "y", arima.ArimaConfig(p=3, d=1), ["sunday"])
    return rounded(out.select("series_id", "ds", "split", "y", "prediction", "lower_conf", "upper_conf"), 5)


@query("sarimax_forecast")
def sarimax_forecast(spark, sf):
    cfg = arima.ArimaConfig(p=2, d=0, q=1, seasonal_p=1, seasonal_d=1, seasonal_q=1, season=7)
    out = arima.arima_forecast(model_rows(spark, sf), K, "y", cfg, ["sunday"])
    return rounded(out.select("series_id", "ds", "split", "y", "prediction", "lower_conf", "upper_conf"), 5)


@query("sarimax_fixed_origin")
def sarimax_fixed_origin(spark, sf):
    cfg = arima.ArimaConfig(p=1, d=0, q=1, seasonal_p=1, season=7)
    out = arima.arima_forecast(model_rows(spark, sf), K, "y", cfg, one_step=False)
    return rounded(out.select("series_id", "ds", "split", "y", "prediction", "lower_conf", "upper_conf"), 5)


@query("gbt_forecast")
def gbt_forecast(spark, sf):
    rows = model_rows(spark, sf)
    model = trees.fit_trees(rows, K, FEATURES, "y", trees.TreeConfig(n_estimators=5))
    out = trees.predict_trees(rows, model, K, FEATURES, "y")
    return rounded(out.select("series_id", "ds", "split", "y", "prediction"), 5)


@query("feature_importance")
def feature_importance(spark, sf):
    rows = model_rows(spark, sf)
    model = trees.fit_trees(rows, K, FEATURES, "y", trees.TreeConfig(n_estimators=5))
    return rounded(trees.feature_importance(spark, model, FEATURES), 5)


@query("gpr_forecast")
def gpr_forecast(spark, sf):
    kernels = [gp.GpConfig(k, noise=0.5, length=2.0) for k in ("se", "matern52 + white", "se * rq + poly")]
    out = gp.gp_forecast(model_rows(spark, sf), K, ["x1", "x7", "trend"], "y", kernels)
    return rounded(out.select("series_id", "ds", "split", "y", "kernel", "prediction", "lower_conf", "upper_conf"), 4)


# evaluation -----------------------------------------------------------------------------------------

def error_sql(source, by):
    return f"""SELECT {by}, split, {RMSE} AS rmse, {MAPE} AS mape, {SMAPE} AS smape
      FROM {source} WHERE prediction IS NOT NULL GROUP BY ALL"""


EVAL = ROLLED + f""", f AS (
  SELECT series_id, {FIT} FROM mrows WHERE split = 'train' AND x7 IS NOT NULL GROUP BY 1),
own AS (
  SELECT series_id, split, y AS actual, my + sxy / (sxx + 2.0::DOUBLE) * (x7 - mx) AS prediction, '' AS model
  FROM mrows JOIN f USING (series_id) WHERE split = 'train' AND x7 IS NOT NULL UNION ALL
  SELECT series_id, split, y, prediction, '' FROM rolled),
wide AS (
  SELECT series_id, split, y AS actual, lag(y) OVER {W} AS rw, lag(y, 7) OVER {W} AS seas,
         CASE WHEN split = 'train' THEN avg(CASE WHEN split = 'train' THEN y END) OVER (PARTITION BY series_id)
           ELSE avg(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS ha
  FROM mrows),
every AS (
  SELECT * FROM own UNION ALL SELECT series_id, split, actual, rw, '_RW' FROM wide UNION ALL
  SELECT series_id, split, actual, seas, '_seasRW' FROM wide UNION ALL SELECT series_id, split, actual, ha, '_HA' FROM wide),
err AS ({error_sql('every', 'series_id, model')})"""

def board_sql(models):
    return ", ".join(
        f"round(max({m}) FILTER (WHERE model = '{k}' AND split = '{s.lower()}'), 4) AS \"{shown}_{s}{k}\""
        for k in models for s in ("Train", "Test") for m, shown in (("rmse", "RMSE"), ("mape", "MAPE"), ("smape", "sMAPE")))


@query("evaluate_models", f"WITH {EVAL} SELECT series_id, {board_sql(["", "_RW", "_seasRW", "_HA"])} FROM err GROUP BY 1")
def evaluate_models(spark, sf):
    out = experiment.run_linear(model_rows(spark, sf), K, ["x7"], "y", 7, one_config(alpha=2.0))
    return rounded(out.drop("dataset", "cfg_id", "status"))


@query("leaderboard", f"""WITH {EVAL}
  SELECT series_id, {board_sql(["_RW", "_seasRW", "_HA"])} FROM err GROUP BY 1""")
def leaderboard(spark, sf):
    pairs = evaluate.baseline_predictions(model_rows(spark, sf), K, "y", 7)
    return rounded(evaluate.leaderboard(evaluate.evaluate(pairs, K), K, evaluate.BASELINES))


@query("run_status", f"""WITH {DAILY}, s AS (SELECT DISTINCT series_id FROM daily)
  SELECT series_id AS dataset, series_id, 0 AS cfg_id, true AS has_errors FROM s UNION ALL
  SELECT 'Failure', series_id, 1, false FROM s""")
def run_status(spark, sf):
    configs = [linear.LinearConfig("ridge", cfg_id=0), linear.LinearConfig("unheard of", cfg_id=1)]
    out = experiment.run_linear(model_rows(spark, sf), K, ["x7"], "y", 7, configs)
    return out.select("dataset", "series_id", "cfg_id", F.col("RMSE_Test").isNotNull().alias("has_errors"))


@query("run_status_mixed", f"""WITH {DAILY}, s AS (SELECT DISTINCT series_id FROM daily), low AS (SELECT min(series_id) AS least FROM s)
  SELECT CASE WHEN series_id = least THEN 'Failure' ELSE series_id END AS dataset, series_id, series_id <> least AS has_errors
  FROM s, low""")
def run_status_mixed(spark, sf):
    """One series has two equal features and no penalty; the others, solved beside it, keep their results."""
    rows = model_rows(spark, sf)
    least = rows.agg(F.min("series_id").alias("least"))
    rows = rows.join(least).withColumn("twin", F.when(F.col("series_id") == F.col("least"), F.col("x7")).otherwise(F.col("x1")))
    out = experiment.run_linear(rows, K, ["x7", "twin"], "y", 7, [linear.LinearConfig("ridge", alpha=0.0)])
    return out.select("dataset", "series_id", F.col("RMSE_Test").isNotNull().alias("has_errors"))


@query("cv_scores")
def cv_scores(spark, sf):
    train = model_rows(spark, sf).filter(F.col("split") == "train")
    return rounded(experiment.cross_validate(train, K, FEATURES, "y", linear.LinearConfig("ridge")), 5)


@query("cv_scores_shuffled")
def cv_scores_shuffled(spark, sf):
    train = model_rows(spark, sf).filter(F.col("split") == "train")
    return rounded(experiment.cross_validate(train, K, FEATURES, "y", linear.LinearConfig("ridge"), shuffled=True), 5)


# cross-validation of one feature ---------------------------------------------------------------------

CV_ROWS = ROWS + """, tr AS (
  SELECT series_id, ds, y, x7, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS t,
         count(*) OVER (PARTITION BY series_id) AS n FROM mrows WHERE split = 'train'),
blocks AS (SELECT *, n // 4 AS size, CAST(unnest([0, 1, 2]) AS INT) AS fold FROM tr WHERE n >= 80),
cvrows AS (SELECT *, CASE WHEN t < n - (3 - fold) * size THEN 'train' ELSE 'test' END AS split
  FROM blocks WHERE t < n - (2 - fold) * size),
f AS (SELECT series_id, fold, """ + FIT + """ FROM cvrows WHERE split = 'train' AND x7 IS NOT NULL GROUP BY 1, 2),
cvp AS (SELECT series_id, fold, split, y AS actual, my + sxy / (sxx + 1.0::DOUBLE) * (x7 - mx) AS prediction
  FROM cvrows JOIN f USING (series_id, fold) WHERE split = 'test' AND x7 IS NOT NULL),
fold_err AS (""" + error_sql("cvp", "series_id, fold") + ")"


@query("cv_scores_fixed", f"""WITH {CV_ROWS} SELECT series_id, {", ".join(
    f"round(avg({m}), 5) AS ts_cv_{m}_mean, round(stddev_pop({m}), 5) AS ts_cv_{m}_std, "
    + ", ".join(f"round(max({m}) FILTER (WHERE fold = {i}), 5) AS ts_cv_{m}_{i}" for i in range(3))
    for m in metrics.METRICS)} FROM fold_err GROUP BY 1""")
def cv_scores_fixed(spark, sf):
    train = model_rows(spark, sf).filter(F.col("split") == "train")
    return rounded(experiment.cross_validate(train, K, ["x7"], "y", linear.LinearConfig("ridge"), one_step=False), 5)


SHOP = SeriesConfig("revenue", "shop", 28, ("revenue",), ("revenue",))
SCHOOL = {"school_holiday": ["no", "osterferien", "sommerferien"]}


@query("optimization_run")
def optimization_run(spark, sf):
    """Two ways to prepare the data, two penalties, refits before every test day."""
    rows = with_holidays(daily(spark, sf))
    out = experiment.optimize_linear(rows, K, SHOP, RunParameters.of(SHOP, 0.8), linear.grid_of("ridge", {"alpha": [1.0, 100.0]}),
                                     reductions=(None, "pca"), categories=SCHOOL)
    return rounded(out, 3)


@query("smoothing_run")
def smoothing_run(spark, sf):
    """Smoothing configurations side by side, one of which cannot work."""
    rows = model_rows(spark, sf)
    runs = {i: (lambda frame, c=c: smoothing.smoothing_forecast(frame, K, "y", c)) for i, c in enumerate([
        smoothing.SmoothingConfig(), smoothing.SmoothingConfig("add", True, "add", 7)])}
    runs[2] = lambda frame: smoothing.smoothing_forecast(frame, K, "unheard_of", smoothing.SmoothingConfig())
    return rounded(experiment.run_models(rows, K, "y", 7, runs))
