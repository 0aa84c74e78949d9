"""Gap filling of daily ET over a stream, with the last crop coefficient as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "kc double, us array<long>, et array<double>, et_ref array<double>"


def _known(values: pd.Series) -> list[float | None]:
    return [None if v != v else v for v in values.astype("float64").tolist()]


def _order(row: tuple) -> tuple:
    us, et, ref = row
    return us, et is not None, et or 0.0, ref is not None, ref or 0.0


def stream_fill_et(days: DataFrame, pixel: str, day: str, et: str, et_ref: str, lateness: str = "3 days") -> DataFrame:
    """fill_et over a stream: (pixel, day, et, et_ref, kc, et_filled), each row once it is final.

    day is a timestamp; rows may come in any order within `lateness`, and later ones are
    dropped. A row is final when the watermark has passed its day, since then no earlier
    day of its pixel can come; until then it waits in the pixel's state, which holds
    its open days and the last coefficient. Rows with equal days are taken in order
    of their values, gaps first. NaN counts as null. A pixel without open days keeps one
    number, and its timer is off. Days up to 1970-01-01 count as late, as every watermark begins there.
    """
    shown = T.StructType(
        [T.StructField(pixel, days.schema[pixel].dataType), T.StructField("us", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("et", "et_ref", "kc", "et_filled"))]
    )

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kc, open_days = None, []
        if state.exists:
            kc, *lists = state.get
            open_days = list(zip(*lists, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                open_days += zip(frame["us"].tolist(), _known(frame["et"]), _known(frame["et_ref"]), strict=True)
        open_days.sort(key=_order)
        passed = state.getCurrentWatermarkMs() * 1000
        final = [row for row in open_days if row[0] < passed]
        out = []
        for us, value, ref in final:
            usable = ref is not None and ref >= 0
            if usable and ref > 0 and value is not None:
                kc = value / ref
            filled = value if value is not None else kc * ref if usable and kc is not None else None
            out.append((key[0], us, value, ref, kc, filled))
        waiting = open_days[len(final) :]
        state.update((kc, *([row[i] for row in waiting] for i in range(3))))
        if waiting:
            state.setTimeoutTimestamp(-(-waiting[0][0] // 1000))
        if out:
            yield pd.DataFrame(out, columns=shown.names).astype({c: "float64" for c in shown.names[2:]})

    rows = days.select(F.col(pixel), F.col(day).alias("at"), F.col(et).cast("double").alias("et"), F.col(et_ref).cast("double").alias("et_ref"))
    keyed = rows.withColumn("us", F.unix_micros("at")).withWatermark("at", lateness).groupBy(pixel)
    filled = keyed.applyInPandasWithState(step, shown, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return filled.select(pixel, F.timestamp_micros("us").alias(day), "et", "et_ref", "kc", "et_filled")
