"""Recursions over ordered rows with a state handed from one stretch of a series to the next.

Stretch after stretch, all keys at once: a task never sees more than ``RELAY_ROWS`` rows of a key.
Series shorter than that, the usual case, need one round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcast.models.gram import key_fields
from sparkcast.session import cut_lineage

RELAY_ROWS = 16384

Step = Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray | None, np.ndarray]]


def relay(df: DataFrame, keys: Sequence[str], states: DataFrame, step: Step, size: int = RELAY_ROWS,
          pos: str = "t") -> tuple[DataFrame, DataFrame]:
    """Run ``step(rows, state)`` over the stretches of each key, rows ordered by ``pos``.

    ``states`` has the keys and a double array ``state``. ``step`` returns forecasts for the rows, or
    None, and the state after them. Gives the forecasts ``(keys, pos, prediction)`` and last states.
    """
    names = list(keys)
    last = df.agg(F.max(F.floor(F.col(pos) / F.lit(size)))).first()[0]
    state_type = T.ArrayType(T.DoubleType())
    schema = T.StructType([*key_fields(df, keys), T.StructField(pos, T.LongType()),
                           T.StructField("prediction", T.DoubleType()), T.StructField("state", state_type)])

    def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = [*names, pos, "prediction", "state"]
        if known.empty:
            return pd.DataFrame(columns=columns)
        key = tuple(known[names].iloc[0])
        state = np.asarray(known["state"].iloc[0], float)
        parts = []
        if len(rows):
            rows = rows.sort_values(pos)
            forecast, state = step(rows, state)
            if forecast is not None:
                out = rows[[*names, pos]].copy()
                out["prediction"], out["state"] = np.where(np.isfinite(forecast), forecast, np.nan), None
                parts.append(out)
        parts.append(pd.DataFrame([(*key, -1, np.nan, state)], columns=columns))
        return pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]

    done = []
    for i in range(int(last or 0) + 1):
        part = df.filter(F.floor(F.col(pos) / F.lit(size)) == i)
        result = part.groupBy(*names).cogroup(states.groupBy(*names)).applyInPandas(run, schema)
        result = cut_lineage(result)
        done.append(result.filter(F.col("state").isNull()).drop("state"))
        states = result.filter(F.col("state").isNotNull()).select(*names, "state")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("prediction", F.nanvl("prediction", F.lit(None).cast("double"))), states
