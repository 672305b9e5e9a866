"""Principal components of standardised features, fitted on the train rows of each key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcast.models.gram import gram, key_fields, unpack
from sparkcast.operators.chunks import attach


def fit_pca(df: DataFrame, keys: Sequence[str], features: Sequence[str], variance: float = 0.95) -> DataFrame:
    """Loadings per key for as many components as exceed the share of variance.

    The sign of a component makes its largest loading positive. A key with a NULL among its train
    features has no model.
    """
    train = df.filter(F.col("split") == "train")
    has_null = F.lit(False)
    for c in features:
        has_null = has_null | F.col(c).isNull()
    clean = train.groupBy(*keys).agg((F.count_if(has_null) == 0).alias("_clean"))
    grams = attach(gram(train, keys, features), clean, keys).filter("_clean").drop("_clean")
    width, d, names = len(features) + 1, len(features), list(keys)
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *key_fields(df, keys), T.StructField("mean", doubles), T.StructField("sd", doubles),
        T.StructField("n_components", T.IntegerType()), T.StructField("loadings", T.ArrayType(doubles)),
        T.StructField("explained", doubles)])

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g, rows = unpack(pdf["m"], width), []
            for i in range(len(pdf)):
                n = g[i, 0, 0]
                mean, cov = g[i, 0, 1:], g[i, 1:, 1:] / n
                sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
                sd = np.where(sd > 1e-15 * np.abs(mean), sd, 1.0)
                values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
                values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
                share = values / max(values.sum(), 1e-300)
                count = min(int(np.searchsorted(np.cumsum(share), variance, side="right")) + 1, d)
                signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
                rows.append((*pdf[names].iloc[i], mean, sd, count,
                             [list(v) for v in (vectors * signs).T[:count]], share[:count]))
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return grams.mapInPandas(fits, schema)


def pca_transform(df: DataFrame, keys: Sequence[str], features: Sequence[str], variance: float = 0.95,
                  models: DataFrame | None = None) -> DataFrame:
    """Replace the features by ``PC0..``; components a key does not need are NULL.

    Keys without a model (NULL among their train features) have NULL components throughout.
    """
    models = fit_pca(df, keys, features, variance) if models is None else models
    out = attach(df, models, keys)
    scaled = F.array(*[(F.col(c).cast("double") - F.col("mean")[i]) / F.col("sd")[i] for i, c in enumerate(features)])
    out = out.withColumn("_z", scaled)

    def component(i: int):
        products = F.zip_with("_z", F.get("loadings", F.lit(i)), lambda z, w: z * w)
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p).alias(f"PC{i}")

    kept = [c for c in df.columns if c not in features]
    return out.select(*kept, "n_components", *[component(i) for i in range(len(features))])
