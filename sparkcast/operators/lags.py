"""Lags, rolling statistics, sequences and differences over past rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from sparkcast.operators.chunks import windowed

LAGS = (1, 2, 3, 4, 5, 6, 7)

Make = Callable[..., WindowSpec]
Block = Callable[[Make], Mapping[str, Column]]


def lag_block(features: Sequence[str], lags: Sequence[int]) -> tuple[Block, int]:
    def build(make: Make) -> dict[str, Column]:
        return {f"stat_{f}_lag{i}": F.lag(f, i).over(make()) for f in features for i in lags}

    return build, max(lags)


def seasonal_lag_block(features: Sequence[str], lags: Sequence[int], season: int) -> tuple[Block, int]:
    """Lag ``i`` of the last season is ``season + i - 1`` rows back."""
    def build(make: Make) -> dict[str, Column]:
        return {f"stat_{f}_seaslag{i}": F.lag(f, season + i - 1).over(make())
                for f in features for i in lags}

    return build, season + max(lags) - 1


def _statistics(names: str, feature: str, frame: WindowSpec, width: int) -> dict[str, Column]:
    """Mean, median and maximum of a full frame; NULL while a value is missing."""
    full = F.count(feature).over(frame) == width
    x = F.col(feature)
    return {
        names.format("mean"): F.when(full, F.avg(x).over(frame)),
        names.format("median"): F.when(full, F.percentile(x, F.lit(0.5)).over(frame)),
        names.format("max"): F.when(full, F.max(x).over(frame)),
    }


def rolling_block(features: Sequence[str], width: int) -> tuple[Block, int]:
    """The previous ``width`` rows, the current one excluded."""
    def build(make: Make) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for f in features:
            out |= _statistics(f"stat_{f}_rolling_{{}}{width}", f, make().rowsBetween(-width, -1), width)
        return out

    return build, width


def rolling_seasonal_block(features: Sequence[str], width: int, season: int) -> tuple[Block, int]:
    """``width`` rows that end one season and one row back; nothing for seasons not above the width."""
    if season <= width:
        return (lambda make: {}), 0

    def build(make: Make) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for f in features:
            frame = make().rowsBetween(-(season + width), -(season + 1))
            out |= _statistics(f"stat_{f}_rolling_seasonal_{{}}{width}", f, frame, width)
        return out

    return build, season + width


def rolling_weekday_block(features: Sequence[str], width: int, time: str = "ds") -> tuple[Block, int]:
    """The previous ``width`` rows of the same weekday of a daily series."""
    def build(make: Make) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for f in features:
            frame = make(F.weekday(time)).rowsBetween(-width, -1)
            out |= _statistics(f"stat_{f}_weekday_rolling_{{}}{width}", f, frame, width)
        return out

    return build, 7 * width


def add_blocks(df: DataFrame, keys: Sequence[str], pos: str | Column,
               blocks: Sequence[tuple[Block, int]]) -> DataFrame:
    """Compute several blocks after one common shuffle."""
    def build(make: Make) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for block, _ in blocks:
            out |= dict(block(make))
        return out

    return windowed(df, keys, pos, build, back=max(reach for _, reach in blocks))


def add_statistical_features(df: DataFrame, keys: Sequence[str], pos: str | Column, features: Sequence[str],
                             season: int, lags: Sequence[int] = LAGS, width: int = 7, width_seasonal: int = 7,
                             width_weekday: int = 4, weekday_stats: bool = True,
                             non_seasonal: Sequence[str] = (), time: str = "ds",
                             extra_widths: Sequence[int] = ()) -> DataFrame:
    """All statistical features; ``extra_widths`` adds rolling and seasonal blocks of other widths."""
    seasonal = [f for f in features if f not in non_seasonal]
    blocks = [lag_block(features, lags), seasonal_lag_block(seasonal, lags, season),
              rolling_block(features, width), rolling_seasonal_block(seasonal, width_seasonal, season)]
    if weekday_stats:
        blocks.append(rolling_weekday_block(seasonal, width_weekday, time))
    for w in extra_widths:
        blocks += [rolling_block(features, w), rolling_seasonal_block(seasonal, w, season)]
    return add_blocks(df, keys, pos, blocks)


def sequence_windows(df: DataFrame, keys: Sequence[str], pos: str | Column, columns: Sequence[str],
                     target: str, length: int) -> DataFrame:
    """The ``length`` rows before a row as ``seq``, its target as ``label``; full sequences only."""
    row = F.array(*[F.col(c).cast("double") for c in columns])

    def build(make: Make) -> dict[str, Column]:
        return {"seq": F.collect_list(row).over(make().rowsBetween(-length, -1))}

    out = windowed(df, keys, pos, build, back=length)
    return out.filter(F.size("seq") == length).withColumn("label", F.col(target).cast("double"))


def difference_weights(d: int, seasonal_d: int, season: int) -> dict[int, float]:
    """Weights by lag of ``(1 - B)^d (1 - B^season)^D``, B being the shift by one row."""
    weights = {0: 1.0}
    for step in [1] * d + [season] * seasonal_d:
        product = dict(weights)
        for lag, w in weights.items():
            product[lag + step] = product.get(lag + step, 0.0) - w
        weights = product
    return {lag: w for lag, w in sorted(weights.items()) if w}


def difference(df: DataFrame, keys: Sequence[str], pos: str | Column, column: str, d: int = 0,
               seasonal_d: int = 0, season: int = 1, name: str | None = None) -> DataFrame:
    """(Seasonal) differences of any order as one weighted sum of lags."""
    weights = difference_weights(d, seasonal_d, season)

    def build(make: Make) -> dict[str, Column]:
        terms = [(F.lag(column, lag).over(make()) if lag else F.col(column)) * F.lit(w)
                 for lag, w in weights.items()]
        return {name or f"{column}_diff": sum(terms[1:], terms[0])}

    return windowed(df, keys, pos, build, back=max(weights))


def undo_difference(diff: Column, lagged: Callable[[int], Column], d: int, seasonal_d: int, season: int) -> Column:
    """The value behind a (predicted) difference, given the earlier values."""
    for lag, w in difference_weights(d, seasonal_d, season).items():
        if lag:
            diff = diff - lagged(lag) * F.lit(w)
    return diff
