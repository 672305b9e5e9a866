"""Hyper-parameter grids per dataset: product, sampling, pruning, kernel combinations.

Grid values are arguments of a run. A dataset row is expanded to its configurations by generators, so
no join is needed and the rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kernel bases by short name, and those with a periodic variant.
BASE_KERNELS = ("se", "matern52", "white", "rq", "poly")
PERIODIC_BASES = ("se", "matern52", "rq")
PAIR_FORMS = ("{a} + {b}", "{a} * {b}")
TRIPLE_FORMS = ("{a} + {b} + {c}", "{a} * {b} * {c}", "{a} * {b} + {c}", "{a} + {b} * {c}", "{a} * {c} + {b}")


def grid_size(grid: Mapping[str, Sequence]) -> int:
    size = 1
    for values in grid.values():
        size *= len(values)
    return size


def param_grid(datasets: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    """Every combination for every dataset row, numbered from 0 in the order of the lists."""
    out, number, strides = datasets, F.lit(0), 1
    for values in reversed(list(grid.values())):
        strides *= len(values)
    for name, values in grid.items():
        strides //= len(values)
        options = F.array(*[F.struct(F.lit(i * strides).alias("at"), F.lit(v).alias("value"))
                            for i, v in enumerate(values)])
        out = out.withColumn("_o", F.explode(options)).withColumn(name, F.col("_o.value"))
        out = out.withColumn(f"_at_{name}", F.col("_o.at")).drop("_o")
        number = number + F.col(f"_at_{name}")
    return out.withColumn("cfg_id", number.cast("long")).drop(*[f"_at_{n}" for n in grid])


def _useless(imputation: Column, featureset: Column) -> Column:
    return featureset.isin("cal", "none") & imputation.isin("iterative", "knn")


def prune_grid(grid: DataFrame, several_gappy_columns: bool) -> DataFrame:
    """Drop combinations that cannot differ from others.

    Multivariate imputation needs several columns with gaps; a component analysis needs features and
    complete rows.
    """
    keep = F.lit(True)
    if not several_gappy_columns:
        keep = keep & ~F.coalesce(_useless(F.col("imputation"), F.col("featureset")), F.lit(False))
    if "dim_reduction" in grid.columns:
        keep = keep & ~((F.col("dim_reduction") == "pca") & (
            (F.col("featureset") == "none") | F.col("imputation").isNull()))
    return grid.filter(keep)


def sample_grid(grid: DataFrame, share: float, size: int, seed: int = 42,
                order: Sequence[str] = ("dataset", "imputation", "featureset", "dim_reduction")) -> DataFrame:
    """``int(share * size)`` configurations per dataset, the same in every run, sorted for reuse.

    ``size`` bounds the configurations of a dataset, so ranking them per dataset is small work.
    """
    lot = F.md5(F.concat_ws("/", "dataset", "cfg_id", F.lit(seed)))
    drawn = Window.partitionBy("dataset").orderBy(lot, "cfg_id")
    return (grid.withColumn("_rank", F.row_number().over(drawn))
            .filter(F.col("_rank") <= int(share * size)).drop("_rank")
            .orderBy(*[c for c in order if c in grid.columns], "cfg_id"))


def kernel_combinations(datasets: DataFrame) -> DataFrame:
    """All kernels to try per dataset: the bases, both forms of pairs and five forms of triples."""
    bases = F.array(*[F.lit(b) for b in BASE_KERNELS], *[F.lit(f"periodic({b})") for b in PERIODIC_BASES])
    rows = datasets.withColumn("_b", bases)
    n = len(BASE_KERNELS) + len(PERIODIC_BASES)
    index = F.sequence(F.lit(0), F.lit(n - 1))

    def written(form: str, **parts: Column) -> Column:
        text = F.lit(form)
        for name, part in parts.items():
            text = F.replace(text, F.lit("{" + name + "}"), part)
        return text

    def after(i: Column) -> Column:
        return F.filter(index, lambda j: j > i)

    def pair(i: Column) -> Column:
        return F.flatten(F.transform(after(i), lambda j: F.array(*[
            written(f, a=F.col("_b")[i], b=F.col("_b")[j]) for f in PAIR_FORMS])))

    def triple(i: Column) -> Column:
        return F.flatten(F.transform(after(i), lambda j: F.flatten(F.transform(after(j), lambda k: F.array(*[
            written(f, a=F.col("_b")[i], b=F.col("_b")[j], c=F.col("_b")[k]) for f in TRIPLE_FORMS])))))

    kernels = F.concat(F.col("_b"), F.flatten(F.transform(index, pair)), F.flatten(F.transform(index, triple)))
    return rows.select(*datasets.columns, F.posexplode(kernels).alias("kernel_id", "kernel"))
