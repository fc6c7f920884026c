"""Expected rest of a month: working days of the planta, days with consumption, and the mean size of the past."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.functions.numbers import ratio
from caudal.operators.nowcast import alive_before
from caudal.operators.panel import SERIES, Panel

# Fixed values.
LOOKBACK_DAYS = 365
SHRINK = 10.0


def _span(panel: Panel, mi: int, day: int, lookback: int) -> tuple[dt.date, dt.date, dt.date]:
    """First day looked at, first day of the month and last day seen."""
    year, month = divmod(mi + panel.first_ym, 12)
    start = dt.date(year, month + 1, 1)
    cut = start + dt.timedelta(days=day - 1)
    oldest_year, oldest_month = divmod(panel.first_ym, 12)
    low = max(cut - dt.timedelta(days=lookback - 1), dt.date(oldest_year, oldest_month + 1, 1))
    return low, start, cut


def _daily(df: DataFrame, low: dt.date, cut: dt.date) -> DataFrame:
    rows = df.where((F.col("fecha") >= F.lit(low)) & (F.col("fecha") <= F.lit(cut)))
    return rows.groupBy(*SERIES, "fecha").agg(F.sum("consumo").alias("consumo"))


def planta_working_days(df: DataFrame, low: dt.date, cut: dt.date) -> DataFrame:
    """(planta, fecha) of the days on which the planta consumed anything."""
    rows = df.where((F.col("fecha") >= F.lit(low)) & (F.col("fecha") <= F.lit(cut)))
    return rows.groupBy("planta", "fecha").agg(F.sum("consumo").alias("total")).where(F.col("total") > 0).select("planta", "fecha")


def working_day_profile(df: DataFrame, panel: Panel, mi: int, day: int, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """(planta, dia, share): share of each weekday (Monday = 0) on which the planta consumed anything before the cutoff."""
    low, _, cut = _span(panel, mi, day, lookback)
    spark = df.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(low), F.lit(cut))).alias("fecha")).select("fecha", F.weekday("fecha").alias("dia"))
    weekdays = calendar.groupBy("dia").agg(F.count(F.lit(1)).alias("dias"))
    works = planta_working_days(df, low, cut).groupBy("planta", F.weekday("fecha").alias("dia")).agg(F.count(F.lit(1)).alias("trabajados"))
    grid = panel.plantas().select("planta", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dia"))
    table = grid.join(F.broadcast(weekdays), "dia", "left").join(works, ["planta", "dia"], "left")
    return table.select("planta", "dia", F.coalesce(ratio(F.coalesce("trabajados", F.lit(0)), F.col("dias")), F.lit(0.0)).alias("share"))


def consumption_share(df: DataFrame, panel: Panel, mi: int, day: int, lookback: int = LOOKBACK_DAYS, shrink: float = SHRINK) -> DataFrame:
    """(planta, sku, q, sizes): probability of consuming on a working day of the planta, and the positive daily values
    of the look-back (at most one per day)."""
    low, start, cut = _span(panel, mi, day, lookback)
    positive = F.col("consumo") > 0
    seen = F.col("fecha") >= F.lit(start)
    own = _daily(df, low, cut).groupBy(*SERIES).agg(
        F.count_if(positive).alias("consume"), F.count_if(positive & seen).alias("consume_mes"), F.collect_list(F.when(positive, F.struct("fecha", "consumo"))).alias("dias")
    )
    works = planta_working_days(df, low, cut).groupBy("planta").agg(F.count(F.lit(1)).alias("trabaja"), F.count_if(seen).alias("trabaja_mes"))
    # A series that appears only after the cutoff month has no known month: leave it out, or the future would leak in.
    known = panel.known().where(F.col("mi") <= mi).select(*SERIES).distinct()
    base = known.join(own, SERIES, "left").join(panel.planta_side(works), "planta", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    long_run = n("consume") / F.greatest(n("trabaja"), F.lit(1))
    q = (n("consume_mes") + shrink * long_run) / F.greatest(n("trabaja_mes") + F.lit(shrink), F.lit(1e-9))
    sizes = F.transform(F.array_sort(F.coalesce("dias", F.array().cast("array<struct<fecha:date,consumo:double>>"))), lambda x: x["consumo"])
    return base.select(*SERIES, F.greatest(F.least(q, F.lit(1.0)), F.lit(0.0)).alias("q"), sizes.alias("sizes"))


def _days_ahead(panel: Panel, mi: int, day: int) -> DataFrame:
    """The remaining days of the month as one array per planta is built from this table of days."""
    _, _, cut = _span(panel, mi, day, 1)
    year, month = divmod(mi + 1 + panel.first_ym, 12)
    end = dt.date(year, month + 1, 1) - dt.timedelta(days=1)
    if mi == panel.data_last_mi:
        end = min(end, panel.calendar_end)
    days = F.sequence(F.lit(cut + dt.timedelta(days=1)), F.lit(end)) if end > cut else F.array().cast("array<date>")
    return panel.monthly.sparkSession.range(1).select(F.explode(days).alias("fecha")).select("fecha", F.weekday("fecha").alias("dia"))


def _inputs(df: DataFrame, panel: Panel, mi: int, day: int, lookback: int, shrink: float) -> DataFrame:
    """Series alive the month before with q, sizes and the remaining days of their planta [(fecha, share)]."""
    ahead = _days_ahead(panel, mi, day).join(working_day_profile(df, panel, mi, day, lookback), "dia")
    plan = ahead.groupBy("planta").agg(F.array_sort(F.collect_list(F.struct("fecha", "share"))).alias("plan"))
    share = consumption_share(df, panel, mi, day, lookback, shrink)
    alive = alive_before(panel, mi, mi).select(*SERIES)
    return alive.join(share, SERIES).join(panel.planta_side(plan), "planta", "left")


def expected_rest(df: DataFrame, panel: Panel, mi: int, day: int, lookback: int = LOOKBACK_DAYS, shrink: float = SHRINK) -> DataFrame:
    """(planta, sku, esperado): days left on which the planta works, times the chance that the series consumes on one, times
    its mean size."""
    plan = F.coalesce("plan", F.array().cast("array<struct<fecha:date,share:double>>"))
    days = F.aggregate(plan, F.lit(0.0), lambda total, d: total + d["share"])
    mean_size = F.aggregate("sizes", F.lit(0.0), lambda total, x: total + x) / F.size("sizes")
    return _inputs(df, panel, mi, day, lookback, shrink).select(
        *SERIES, F.when(F.size("sizes") > 0, days * F.col("q") * mean_size).otherwise(F.lit(0.0)).alias("esperado")
    )
