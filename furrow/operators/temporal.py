"""Temporal joins, interpolation, calendar columns and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window_join(composites: DataFrame, daily: DataFrame, comp_date: str, day: str, k: int = 4) -> DataFrame:
    """Each composite with the daily rows within k days of it, in its calendar year.

    A composite of 6 April reaches one day further back. The day range is exploded, so
    that the join is an equi-join and not a nested loop.
    """
    c = F.col(comp_date)
    back = F.when((F.month(c) == 4) & (F.dayofmonth(c) == 6), k + 1).otherwise(k)
    spread = composites.withColumn("_d", F.explode(F.sequence(F.date_sub(c, back), F.date_add(c, k)))).filter(F.year("_d") == F.year(c))
    return spread.join(daily, F.col("_d") == daily[day]).drop("_d")


def interp_hourly(obs: DataFrame, hourly: DataFrame, ts: str, hour: str, values: list[str], keys: list[str] = [], mode: str = "floor") -> DataFrame:
    """Values of an hourly table at minute precision, linear between the two hours around ts.

    mode floor: from the hour before or at ts to the next one; rows without both drop.
    mode ceil: the same, but an exact hour needs that hour only.
    """
    t = F.col(ts)
    base = F.date_trunc("hour", t)
    share = F.minute(t) / F.lit(60.0)
    nxt = base + F.expr("INTERVAL 1 HOUR")
    if mode == "ceil":
        exact = (F.minute(t) == 0) & (F.second(t) == 0)
        nxt = F.when(exact, base).otherwise(nxt)
    left = obs.withColumns({"_h0": base, "_h1": nxt})
    for i in (0, 1):
        side = hourly.select(*keys, F.col(hour).alias(f"_h{i}"), *(F.col(v).alias(f"_{v}{i}") for v in values))
        left = left.join(side, [*keys, f"_h{i}"])
    out = left.withColumns({v: F.col(f"_{v}0") - (F.col(f"_{v}0") - F.col(f"_{v}1")) * share for v in values})
    return out.select(*obs.columns, *values)


def per_day_counts(df: DataFrame, ts: str, keys: list[str] = []) -> DataFrame:
    """Rows per day, with the running end of each day and its start.

    The running sum is over days, not rows: one row a day reaches the window.
    """
    days = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    run = W.partitionBy(*(keys or [F.lit(1)])).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return days.withColumn("day_end", F.sum("n").over(run)).withColumn("day_start", F.col("day_end") - F.col("n"))


def with_acq_time(df: DataFrame, ts: str) -> DataFrame:
    """unix_s (0 where there is none), hhmm as an integer, and the timestamp again from unix_s."""
    unix = F.coalesce(F.unix_timestamp(F.col(ts).cast("timestamp")), F.lit(0))
    return df.withColumns({"unix_s": unix, "hhmm": F.hour(ts) * 100 + F.minute(ts), "acquired": F.timestamp_seconds(F.nullif(unix, F.lit(0)))})


def daily_radiation(df: DataFrame, ts: str, flux: str, keys: list[str] = []) -> DataFrame:
    """Mean flux of a day over 24 hours and its energy; hours without any flux are skipped."""
    lit = df.filter(F.coalesce(F.col(flux), F.lit(0.0)) != 0)
    return lit.groupBy(*keys, F.to_date(ts).alias("day")).agg((F.sum(flux) / 24).alias("mean_flux"), (F.sum(flux) * 3600).alias("energy"))


def flux_from_accumulated(joules: Column) -> Column:
    """J/m2 accumulated over an hour as W/m2; 0 counts as missing."""
    return F.nullif(joules, F.lit(0.0)) / 3600


def with_calendar(df: DataFrame, ts: str) -> DataFrame:
    leap = F.dayofmonth(F.last_day(F.make_date(F.year(ts), F.lit(2), F.lit(1)))) == 29
    return df.withColumns(
        {
            "doy": F.dayofyear(ts),
            "is_leap": leap,
            "month_name": F.date_format(ts, "MMMM"),
            "month_days": F.dayofmonth(F.last_day(ts)),
            "year_days": F.when(leap, 366).otherwise(365),
        }
    )


def fill_et(df: DataFrame, pixel: str, day: str, et: str, et_ref: str) -> DataFrame:
    """ET gaps from the last crop coefficient: kc = ET / ET_ref where ET is valid, else kc * ET_ref.

    Rows whose ET_ref is missing or negative neither set a coefficient nor are filled.
    """
    usable = F.coalesce(F.col(et_ref) >= 0, F.lit(False))
    fresh = F.when(usable & (F.col(et_ref) > 0) & F.col(et).isNotNull(), F.col(et) / F.col(et_ref))
    w = W.partitionBy(pixel).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    kc = F.last(fresh, ignorenulls=True).over(w)
    return df.withColumn("kc", kc).withColumn("et_filled", F.when(F.col(et).isNotNull(), F.col(et)).when(usable, F.col("kc") * F.col(et_ref)))


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add each column that df lacks."""
    return df.withColumns({c: e for c, e in defaults.items() if c not in df.columns})
