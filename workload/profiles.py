"""Imputation, transform, profile and grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcast.models import pca
from sparkcast.models.linear import LinearConfig
from sparkcast.operators import grid, impute, profile, transform
from sparkcast.operators.chunks import attach
from sparkcast.operators.split import split
from workload.frames import DAILY, K, STATUS, SUPPLY, daily, rounded, sales, status_sales, stored_supply, supply
from workload.registry import query
from workload.windows import W

GAPS = ["rev_f", "rev_o", "rev_p"]

STATUS_SPLIT = STATUS + f""", snum AS (
  SELECT *, row_number() OVER {W} - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM status),
ssplit AS (SELECT series_id, ds, rev_f, rev_o, rev_p,
  CASE WHEN t < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM snum)"""


def status_split(spark, sf):
    return split(status_sales(spark, sf), K, 0.8).select("series_id", "ds", *GAPS, "split")


def fill_sql(aggregate):
    fills = ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE {c} IS NULL) > 0 THEN {aggregate.format(c=c)} END AS fill_{c}" for c in GAPS)
    out = ", ".join(f"round(coalesce({c}, fill_{c}), 6) AS {c}" for c in GAPS)
    return f"""WITH {STATUS_SPLIT}, fills AS (SELECT series_id, {fills} FROM ssplit WHERE split = 'train' GROUP BY 1)
  SELECT series_id, ds, split, {out} FROM ssplit JOIN fills USING (series_id)"""


@query("impute_mean", fill_sql("avg({c})"))
def impute_mean(spark, sf):
    return rounded(impute.impute(status_split(spark, sf), K, GAPS, "mean"), 6)


@query("impute_median", fill_sql("quantile_cont({c}, 0.5)"))
def impute_median(spark, sf):
    return rounded(impute.impute(status_split(spark, sf), K, GAPS, "median"), 6)


@query("impute_train_test", f"""WITH {DAILY}, num AS (
  SELECT *, row_number() OVER {W} - 1 AS t FROM daily),
  folds AS (SELECT *, CAST(unnest([0, 1, 2]) AS INT) AS fold FROM num),
  sp AS (SELECT *, CASE WHEN t < 730 + 365 * fold THEN 'train' ELSE 'test' END AS split
         FROM folds WHERE t < 1095 + 365 * fold),
  fills AS (SELECT series_id, fold, avg(revenue) AS fr, avg(n_orders) AS fo, count(*) - count(revenue) AS gr,
            count(*) - count(n_orders) AS go FROM sp WHERE split = 'train' GROUP BY 1, 2)
  SELECT series_id, ds, fold, split, round(CASE WHEN gr > 0 THEN coalesce(revenue, fr) ELSE revenue END, 4) AS revenue,
         round(CASE WHEN go > 0 THEN coalesce(n_orders, fo) ELSE n_orders END, 4) AS n_orders
  FROM sp JOIN fills USING (series_id, fold)""")
def impute_train_test(spark, sf):
    rows = split(daily(spark, sf), K, None, 730, 365)
    return rounded(impute.impute(rows, [*K, "fold"], ["revenue", "n_orders"], "mean").drop("t", "n_train"))


def knn_sql():
    parts = " + ".join(f"coalesce((a.{c} - b.{c}) ** 2, 0)" for c in GAPS)
    both = " + ".join(f"(a.{c} IS NOT NULL AND b.{c} IS NOT NULL)::INT" for c in GAPS)
    means = ", ".join(f"avg({c}) AS mean_{c}, count(*) - count({c}) AS gap_{c}" for c in GAPS)
    near = ", ".join(
        f"list_avg(arg_min(p.b_{c}, {{'d': p.d, 't': p.t}}, 10) FILTER (WHERE p.b_{c} IS NOT NULL)) AS near_{c}" for c in GAPS)
    out = ", ".join(f"round(coalesce(s.{c}, near_{c}, mean_{c}), 6) AS {c}" for c in GAPS)
    offers = ", ".join(f"b.{c} AS b_{c}" for c in GAPS)
    return f"""WITH {STATUS_SPLIT}, means AS (SELECT series_id, {means} FROM ssplit WHERE split = 'train' GROUP BY 1),
  p AS (SELECT a.series_id, a.ds, b.ds AS t, 3.0::DOUBLE / ({both}) * ({parts}) AS d, {offers}
        FROM ssplit a JOIN ssplit b ON a.series_id = b.series_id AND b.split = 'train' AND ({both}) > 0
        WHERE a.rev_f IS NULL OR a.rev_o IS NULL OR a.rev_p IS NULL),
  near AS (SELECT series_id, ds, {near} FROM p GROUP BY 1, 2)
  SELECT s.series_id, s.ds, s.split, {out}
  FROM ssplit s JOIN means USING (series_id) LEFT JOIN near ON near.series_id = s.series_id AND near.ds = s.ds"""


@query("impute_knn", knn_sql())
def impute_knn(spark, sf):
    return rounded(impute.impute(status_split(spark, sf), K, GAPS, "knn"), 6)


@query("impute_iterative")
def impute_iterative(spark, sf):
    return impute.impute(status_split(spark, sf), K, GAPS, "iterative")


def chained_sql(rounds):
    """Two columns, ridge of one on the other: each round learns from the values of the one before, the second column sees the first's new ones."""
    def model(name, x, y, at):
        return f"""{name} AS (SELECT series_id, avg({x}) AS mx, avg({y}) AS my,
          regr_sxy({y}, {x}) / (regr_sxx({y}, {x}) + 1.0::DOUBLE) AS w FROM {at} WHERE split = 'train' AND NOT gap_{y} GROUP BY 1)"""

    steps = []
    for i in range(rounds):
        steps += [model(f"mf{i}", "rev_o", "rev_f", f"r{i}"), model(f"mo{i}", "rev_f", "rev_o", f"r{i}"),
                  f"""h{i} AS (SELECT r.* REPLACE (CASE WHEN gap_rev_f THEN greatest(m.my + m.w * (rev_o - m.mx), 0) ELSE rev_f END AS rev_f)
          FROM r{i} r JOIN mf{i} m USING (series_id))""",
                  f"""r{i + 1} AS (SELECT h.* REPLACE (CASE WHEN gap_rev_o THEN greatest(m.my + m.w * (rev_f - m.mx), 0) ELSE rev_o END AS rev_o)
          FROM h{i} h JOIN mo{i} m USING (series_id))"""]
    return f"""WITH {STATUS_SPLIT}, means AS (
      SELECT series_id, avg(rev_f) AS f, avg(rev_o) AS o FROM ssplit WHERE split = 'train' GROUP BY 1),
    r0 AS (SELECT series_id, ds, split, coalesce(rev_f, f) AS rev_f, coalesce(rev_o, o) AS rev_o, rev_f IS NULL AS gap_rev_f, rev_o IS NULL AS gap_rev_o
      FROM ssplit JOIN means USING (series_id)), {", ".join(steps)}
    SELECT series_id, ds, split, round(rev_f, 6) AS rev_f, round(rev_o, 6) AS rev_o FROM r{rounds}"""


@query("impute_iterative_ridge", chained_sql(3))
def impute_iterative_ridge(spark, sf):
    """Three rounds of chained ridge regression of two columns on each other."""
    rows = status_split(spark, sf).select("series_id", "ds", "split", "rev_f", "rev_o")
    found = impute.impute(rows, K, ["rev_f", "rev_o"], "iterative", rounds=3, tolerance=0.0, model=LinearConfig("ridge", alpha=1.0))
    return rounded(found.select("series_id", "ds", "split", "rev_f", "rev_o"), 6)


@query("impute_features", f"""WITH {DAILY}, num AS (
  SELECT series_id, ds, coalesce(revenue, 0) AS y, row_number() OVER {W} - 1 AS t,
         count(*) OVER (PARTITION BY series_id) AS n FROM daily),
  lagged AS (SELECT *, lag(y, 1) OVER {W} AS stat_y_lag1, lag(y, 7) OVER {W} AS stat_y_lag7,
             CASE WHEN t < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM num),
  m AS (SELECT series_id, avg(stat_y_lag1) AS m1, avg(stat_y_lag7) AS m7 FROM lagged WHERE split = 'train' GROUP BY 1)
  SELECT series_id, ds, y, split, round(coalesce(stat_y_lag1, m1), 4) AS stat_y_lag1,
         round(coalesce(stat_y_lag7, m7), 4) AS stat_y_lag7 FROM lagged JOIN m USING (series_id)""")
def impute_features(spark, sf):
    from sparkcast.operators import lags
    from workload.windows import day

    rows = daily(spark, sf).select("series_id", "ds", F.coalesce("revenue", F.lit(0.0)).alias("y"))
    rows = lags.add_blocks(rows, K, day(), [lags.lag_block(["y"], (1, 7))])
    made = ["stat_y_lag1", "stat_y_lag7"]
    return rounded(impute.impute(split(rows, K, 0.8), K, made, "mean").drop("t", "n_train", "fold"))


# transforms -----------------------------------------------------------------------------------------

TRAIN = SUPPLY + f""", num AS (
  SELECT *, row_number() OVER {W} - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM supply),
sp AS (SELECT series_id, ds, qty, price, CASE WHEN t < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM num)"""


def supply_train(spark, sf):
    return split(stored_supply(spark, sf), K, 0.8).select("series_id", "ds", "qty", "price", "split")


@query("standardize", f"""WITH {TRAIN}, s AS (
  SELECT series_id, avg(qty) AS mq, stddev_pop(qty) AS sq, avg(price) AS mp, stddev_pop(price) AS sp
  FROM sp WHERE split = 'train' GROUP BY 1)
  SELECT series_id, ds, split, round((qty - mq) / CASE WHEN sq = 0 THEN 1 ELSE sq END, 6) AS qty,
         round((price - mp) / CASE WHEN s.sp = 0 THEN 1 ELSE s.sp END, 6) AS price FROM sp JOIN s USING (series_id)""")
def standardize(spark, sf):
    return rounded(transform.standardize(supply_train(spark, sf), K, ["qty", "price"]), 6)


@query("log_transform", f"""WITH {DAILY}, f AS (
  SELECT series_id, ds, CASE WHEN series_id < 'C' THEN coalesce(n_orders, 0) ELSE coalesce(n_orders, 1) END AS y FROM daily),
  z AS (SELECT series_id, min(y) = 0 AS zeros FROM f GROUP BY 1)
  SELECT series_id, ds, round(y, 6) AS y, round(CASE WHEN zeros THEN ln(y + 1) ELSE ln(y) END, 6) AS transformed
  FROM f JOIN z USING (series_id)""")
def log_transform(spark, sf):
    fill = F.when(F.col("series_id") < "C", 0.0).otherwise(1.0)
    rows = daily(spark, sf).select("series_id", "ds", F.coalesce("n_orders", fill).alias("y"))
    out = transform.log_transform(rows, K, "y", keep_statistics=True)
    return rounded(out.select("series_id", "ds", F.col("y").alias("transformed"),
                              transform.log_inverse(F.col("y"), F.col("_zeros")).alias("y")), 6)


GRID = [-1.0, -0.5, 0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0]


@query("power_transform", f"""WITH {TRAIN}, g AS (SELECT unnest({GRID})::DOUBLE AS power),
  x AS (SELECT series_id, power, qty, CASE WHEN power = 0 THEN ln(qty + 1)
        ELSE ((qty + 1) ** power - 1) / power END AS z, split, ds FROM sp, g),
  ll AS (SELECT series_id, power, -count(*) / 2.0 * ln(var_pop(z)) + (power - 1) * sum(ln(qty + 1)) AS l
         FROM x WHERE split = 'train' GROUP BY 1, 2),
  best AS (SELECT series_id, arg_max(power, l) AS power FROM ll GROUP BY 1),
  tr AS (SELECT x.* FROM x JOIN best USING (series_id, power)),
  s AS (SELECT series_id, avg(z) AS m, stddev_pop(z) AS sd FROM tr WHERE split = 'train' GROUP BY 1)
  SELECT series_id, ds, power, round(qty, 6) AS qty, round((z - m) / sd, 5) AS transformed FROM tr JOIN s USING (series_id)""")
def power_transform(spark, sf):
    rows = supply_train(spark, sf).drop("price")
    grid_values = F.array(*[F.lit(v) for v in GRID])
    likelihoods = transform.power_likelihoods(rows, K, "qty", grid_values)
    best = likelihoods.groupBy(*K).agg(F.max(F.struct("log_likelihood", "power")).getField("power").alias("power"))
    out = transform.power_transform(rows, K, "qty", lambdas=best, keep_statistics=True)
    back = transform.backward(out.withColumn("back", F.col("qty")), "qty", "pw", ["back"])
    return rounded(back.select("series_id", "ds", "power", F.col("back").alias("qty"), F.col("qty").alias("transformed")),
                   {"qty": 6, "transformed": 5})


@query("power_lambda_search", f"""WITH {TRAIN}, coarse AS (SELECT -2.0::DOUBLE + i * 0.25::DOUBLE AS power FROM range(25) r(i)),
  first AS (
    SELECT series_id, power, -count(*) / 2.0 * ln(var_pop(CASE WHEN abs(power) < 1e-12 THEN ln(qty + 1)
           ELSE ((qty + 1) ** power - 1) / power END)) + (power - 1) * sum(ln(qty + 1)) AS l
    FROM sp, coarse WHERE split = 'train' GROUP BY 1, 2),
  best AS (SELECT series_id, arg_max(power, l) AS around FROM first GROUP BY 1),
  second AS (
    SELECT series_id, around + i * 0.025::DOUBLE AS power, -count(*) / 2.0 * ln(var_pop(
           CASE WHEN abs(around + i * 0.025::DOUBLE) < 1e-12 THEN ln(qty + 1)
           ELSE ((qty + 1) ** (around + i * 0.025::DOUBLE) - 1) / (around + i * 0.025::DOUBLE) END))
           + (around + i * 0.025::DOUBLE - 1) * sum(ln(qty + 1)) AS l
    FROM sp JOIN best USING (series_id), range(-10, 11) r(i) WHERE split = 'train' GROUP BY series_id, around, i)
  SELECT series_id, round(arg_max(power, l), 6) AS power FROM second GROUP BY 1""")
def power_lambda_search(spark, sf):
    return rounded(transform.power_lambda(supply_train(spark, sf), K, "qty"), 6)


# profiles -------------------------------------------------------------------------------------------

PAIR = ("qty", "price")


@query("corr_matrix", f"""WITH {SUPPLY}
  SELECT series_id, a, b, round(r, 6) AS r FROM (
    SELECT series_id, 'qty' AS a, 'qty' AS b, corr(qty, qty) AS r FROM supply GROUP BY 1 UNION ALL
    SELECT series_id, 'qty', 'price', corr(qty, price) FROM supply GROUP BY 1 UNION ALL
    SELECT series_id, 'price', 'qty', corr(price, qty) FROM supply GROUP BY 1 UNION ALL
    SELECT series_id, 'price', 'price', corr(price, price) FROM supply GROUP BY 1)""")
def corr_matrix(spark, sf):
    return rounded(profile.correlation_matrix(supply(spark, sf), K, PAIR), 6)


LONG = SUPPLY + """, long AS (
  SELECT series_id, 'qty' AS "column", qty AS value FROM supply UNION ALL SELECT series_id, 'price', price FROM supply)"""


@query("histogram", f"""WITH {LONG}, r AS (
  SELECT series_id, "column", min(value) AS lo, max(value) AS hi FROM long GROUP BY 1, 2),
  e AS (SELECT series_id, "column", CAST(i AS INT) AS bin, lo + i * (hi - lo) / 10 AS lower,
        CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * (hi - lo) / 10 END AS upper FROM r, range(10) s(i))
  SELECT e.series_id, e."column", bin, round(lower, 4) AS lower, round(upper, 4) AS upper,
         count(value) AS n
  FROM e LEFT JOIN long l ON l.series_id = e.series_id AND l."column" = e."column"
    AND value >= lower AND (value < upper OR (bin = 9 AND value <= upper))
  GROUP BY ALL""")
def histogram(spark, sf):
    return rounded(profile.histogram(stored_supply(spark, sf), K, PAIR))


@query("box_stats", f"""WITH {LONG}, q AS (
  SELECT series_id, "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1, 2)
  SELECT series_id, "column", round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
         round(least(q1, min(value) FILTER (WHERE value >= q1 - 1.5::DOUBLE * (q3 - q1))), 4) AS whisker_low,
         round(greatest(q3, max(value) FILTER (WHERE value <= q3 + 1.5::DOUBLE * (q3 - q1))), 4) AS whisker_high,
         count(*) FILTER (WHERE value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)) AS n_outliers
  FROM long JOIN q USING (series_id, "column") GROUP BY series_id, "column", q1, median, q3""".replace(
    "round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3",
    "round(q.q1, 4) AS q1, round(q.median, 4) AS median, round(q.q3, 4) AS q3").replace(
    "GROUP BY series_id, \"column\", q1, median, q3", "GROUP BY series_id, \"column\", q.q1, q.median, q.q3"))
def box_stats(spark, sf):
    return rounded(profile.box_statistics(stored_supply(spark, sf), K, PAIR))


@query("autocorrelation", f"""WITH {SUPPLY}, c AS (
  SELECT series_id, row_number() OVER {W} AS t, qty - avg(qty) OVER (PARTITION BY series_id) AS x FROM supply),
  v AS (SELECT series_id, sum(x * x) AS c0, count(*) AS n FROM c GROUP BY 1),
  l AS (SELECT a.series_id, h AS lag, sum(a.x * b.x) AS ch
        FROM c a CROSS JOIN range(1, 41) r(h) JOIN c b ON b.series_id = a.series_id AND b.t = a.t + h GROUP BY 1, 2)
  SELECT series_id, CAST(lag AS INT) AS lag, round(ch / c0, 6) AS r, round(1.959963984540054::DOUBLE / sqrt(n), 6) AS band95,
         round(2.5758293035489004::DOUBLE / sqrt(n), 6) AS band99 FROM l JOIN v USING (series_id)""")
def autocorrelation(spark, sf):
    return rounded(profile.autocorrelation(stored_supply(spark, sf), K, "qty", 40), 6)


@query("pca_features")
def pca_features(spark, sf):
    from sparkcast.operators import lags
    from workload.windows import day

    rows = daily(spark, sf).select("series_id", "ds", F.coalesce("revenue", F.lit(0.0)).alias("y"))
    rows = lags.add_blocks(rows, K, day(), [lags.lag_block(["y"], lags.LAGS), lags.rolling_block(["y"], 7)])
    features = [c for c in rows.columns if c.startswith("stat_")]
    filled = impute.impute(split(rows, K, 0.8), K, features, "mean")
    return pca.pca_transform(filled, K, features)


@query("pca_two_features", f"""WITH {TRAIN}, s AS (
  SELECT series_id, avg(qty) AS mq, stddev_pop(qty) AS sq, avg(price) AS mp, stddev_pop(price) AS spr, corr(qty, price) AS r
  FROM sp WHERE split = 'train' GROUP BY 1)
  SELECT series_id, ds, split, CASE WHEN (1 + abs(r)) / 2 > 0.95::DOUBLE THEN 1 ELSE 2 END AS n_components,
         round(((qty - mq) / sq + (price - mp) / spr) / sqrt(2.0::DOUBLE), 5) AS "PC0" FROM sp JOIN s USING (series_id)""")
def pca_two_features(spark, sf):
    """Two positively related features have the components sum and difference."""
    out = pca.pca_transform(supply_train(spark, sf), K, ["qty", "price"])
    return rounded(out.drop("PC1"), 5)


# grids ----------------------------------------------------------------------------------------------

# A small grid of runs, in list order.
RUN_GRID = {
    "imputation": ["mean", "iterative", "knn"],
    "featureset": ["full", "cal", "stat", "none"],
    "dim_reduction": ["None", "pca"],
    "alpha": [0.01, 0.1, 1.0],
}

DATASETS = SUPPLY + ", datasets AS (SELECT DISTINCT series_id AS dataset FROM supply)"
GRID_SQL = DATASETS + """, runs AS (
  SELECT dataset, i.v AS imputation, f.v AS featureset, d.v AS dim_reduction, a.v::DOUBLE AS alpha,
         ((i.k * 4 + f.k) * 2 + d.k) * 3 + a.k AS cfg_id
  FROM datasets, (VALUES (0, 'mean'), (1, 'iterative'), (2, 'knn')) i(k, v),
       (VALUES (0, 'full'), (1, 'cal'), (2, 'stat'), (3, 'none')) f(k, v),
       (VALUES (0, 'None'), (1, 'pca')) d(k, v), (VALUES (0, 0.01), (1, 0.1), (2, 1.0)) a(k, v))"""


def datasets(spark, sf):
    return supply(spark, sf).select(F.col("series_id").alias("dataset")).distinct()


@query("param_grid", f"""WITH {GRID_SQL}
  SELECT dataset, imputation, featureset, dim_reduction, alpha, CAST(cfg_id AS BIGINT) AS cfg_id FROM runs""")
def param_grid(spark, sf):
    return grid.param_grid(datasets(spark, sf), RUN_GRID)


@query("prune_grid", f"""WITH {GRID_SQL}
  SELECT dataset, imputation, featureset, dim_reduction, alpha, CAST(cfg_id AS BIGINT) AS cfg_id FROM runs
  EXCEPT SELECT dataset, imputation, featureset, dim_reduction, alpha, cfg_id FROM runs
  WHERE imputation <> 'mean' AND featureset IN ('cal', 'none')
  EXCEPT SELECT dataset, imputation, featureset, dim_reduction, alpha, cfg_id FROM runs
  WHERE dim_reduction = 'pca' AND featureset = 'none'""")
def prune_grid(spark, sf):
    return grid.prune_grid(param_grid(spark, sf), several_gappy_columns=False)


@query("sample_grid", f"""WITH {GRID_SQL}
  SELECT dataset, imputation, featureset, dim_reduction, alpha, CAST(cfg_id AS BIGINT) AS cfg_id FROM runs
  QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5(dataset || '/' || cfg_id || '/42'), cfg_id) <= 14""")
def sample_grid(spark, sf):
    return grid.sample_grid(param_grid(spark, sf), 0.2, grid.grid_size(RUN_GRID))


@query("sample_grid_sizes", f"""WITH {DATASETS}
  SELECT dataset, 14::BIGINT AS n_runs FROM datasets""")
def sample_grid_sizes(spark, sf):
    return sample_grid(spark, sf).groupBy("dataset").agg(F.countDistinct("cfg_id").alias("n_runs"))


@query("kernel_combinations", f"""WITH {DATASETS}, b AS (
  SELECT * FROM (VALUES (0, 'se'), (1, 'matern52'), (2, 'white'), (3, 'rq'), (4, 'poly'), (5, 'periodic(se)'),
    (6, 'periodic(matern52)'), (7, 'periodic(rq)')) v(i, k)),
  kernels AS (
    SELECT k AS kernel FROM b UNION ALL
    SELECT x.k || f || y.k FROM b x JOIN b y ON x.i < y.i, (VALUES (' + '), (' * ')) o(f) UNION ALL
    SELECT unnest([x.k || ' + ' || y.k || ' + ' || z.k, x.k || ' * ' || y.k || ' * ' || z.k,
                   x.k || ' * ' || y.k || ' + ' || z.k, x.k || ' + ' || y.k || ' * ' || z.k,
                   x.k || ' * ' || z.k || ' + ' || y.k])
    FROM b x JOIN b y ON x.i < y.i JOIN b z ON y.i < z.i)
  SELECT dataset, kernel FROM datasets, kernels""")
def kernel_combinations(spark, sf):
    return grid.kernel_combinations(datasets(spark, sf)).select("dataset", "kernel")
