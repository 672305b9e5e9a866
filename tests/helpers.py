import datetime as dt

import numpy as np
import pandas as pd

START = dt.date(2020, 1, 1)


def series(spark, values, key="a", start=START, column="y"):
    """A daily series from a list; None and NaN are missing."""
    rows = [(key, start + dt.timedelta(days=i), None if v is None or v != v else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"series_id string, ds date, {column} double")


def many(spark, columns, key="a", start=START):
    """A daily series with several columns from a dictionary of lists."""
    names = list(columns)
    rows = []
    for i in range(len(columns[names[0]])):
        cells = [columns[n][i] for n in names]
        rows.append((key, start + dt.timedelta(days=i), *[None if c is None or c != c else float(c) for c in cells]))
    return spark.createDataFrame(rows, "series_id string, ds date, " + ", ".join(f"{n} double" for n in names))


def collected(df, order="ds"):
    pdf = df.toPandas()
    return pdf.sort_values([c for c in ("series_id", "fold", order) if c in pdf.columns]).reset_index(drop=True)


def split_at(df, n_train):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    t = F.row_number().over(Window.partitionBy("series_id").orderBy("ds")) - 1
    return (df.withColumn("t", t.cast("long")).withColumn("n_train", F.lit(n_train).cast("long"))
            .withColumn("fold", F.lit(0))
            .withColumn("split", F.when(F.col("t") < n_train, "train").otherwise("test")))


def close(a, b, tol=1e-9):
    a, b = np.asarray(pd.Series(a), float), np.asarray(pd.Series(b), float)
    assert a.shape == b.shape
    assert np.allclose(a, b, rtol=tol, atol=tol, equal_nan=True), np.nanmax(np.abs(a - b))
