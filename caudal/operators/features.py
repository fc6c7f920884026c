"""The forecasting frame: every origin at once, as windows over the dense panel.

All the series windows share one partitioning (planta, sku) and one order, so Spark shuffles and sorts once; the planta
and total seasonal ratios come from a table of plantas by months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.dates import working_days
from caudal.functions.numbers import ratio
from caudal.operators.panel import SERIES, Panel, month_to_date

# The first origin, and the names of features and baselines, which saved tables use.
MIN_ORIGIN = 3

FEATURES = [
    "lag1", "lag2", "lag3",
    "mean3", "mean6", "mean12", "std6",
    "zero_share12", "months_active", "ly",
    "planta_code", "month_t",
    "ratio_planta", "ratio_global", "lyrel_planta", "lyrel_global",
    "n_days_t",
    "rate3", "rate6", "rate12",
    "occ3", "occ6", "occ12",
    "size6", "ly_rate",
]
PARTIAL_FEATURES = ["mtd", "mtd_rate", "mtd_occ", "mtd_proj"]
BASELINES = ["naive", "mean3", "mean6", "mean12", "perday6", "seasonal_naive", "mean6_x_global", "mean6_x_planta"]
DIRECT = ["naive", "mean3", "mean6", "mean12", "perday6", "seasonal_naive", "mean6_x_seasonal"]


def _seasonal(prefix: str, keys: list[str], horizon: int) -> list[Column]:
    """Last year's value of the target month over the year-ago level, from origin windows and target windows."""
    order = Window.partitionBy(*keys).orderBy("mi")
    last_year = F.lag("y", 12 - horizon).over(order) if horizon <= 12 else F.lead("y", horizon - 12).over(order)
    level = F.avg("y").over(order.rowsBetween(-17, -12))
    around = F.avg("y").over(order.rowsBetween(horizon - 15, horizon - 9))
    o = F.col("mi")
    return [
        F.when((o + horizon >= 12) & (o >= 17), ratio(last_year, level)).alias(f"ratio_{prefix}"),
        F.when(o + horizon >= 15, ratio(last_year, around)).alias(f"lyrel_{prefix}"),
    ]


def seasonal_ratios(panel: Panel, horizon: int) -> DataFrame:
    """(planta, mi, planta_code, ratio_*, lyrel_*): one row per planta and origin month."""
    plantas = panel.planta_months()
    total = plantas.groupBy("mi").agg(F.sum("y").alias("y")).withColumn("_all", F.lit(1))
    total = total.select("mi", *_seasonal("global", ["_all"], horizon))
    own = plantas.select("planta", "mi", *_seasonal("planta", ["planta"], horizon))
    return own.join(total, "mi").join(panel.plantas(), "planta")


def make_frame(panel: Panel, horizon: int, ahead: int = 0, first_origin: int = MIN_ORIGIN) -> DataFrame:
    """One row per (origin o, series alive at o) with target month t = o + horizon, features, baselines and target y.

    `ahead` months without data are added so that the last origins have a (null) target.
    """
    n_months = panel.last_mi + 1 + ahead
    order = Window.partitionBy(*SERIES).orderBy("mi")
    o, t = F.col("mi"), F.col("mi") + F.lit(horizon)
    dense = panel.dense(ahead).withColumn("_days", panel.business_days(o).cast("double"))
    known_days = F.when(F.col("y").isNotNull(), F.col("_days"))

    def over(k: int):
        return order.rowsBetween(-k + 1, 0)

    def rate(value: str, k: int) -> Column:
        return ratio(F.sum(value).over(over(k)), F.sum(known_days).over(over(k)))

    last_year = F.lag("y", 12 - horizon).over(order) if horizon <= 12 else F.lead("y", horizon - 12).over(order)
    zero = F.when(F.col("y").isNotNull(), (F.col("y") == 0).cast("double"))
    windows = dense.select(
        *SERIES,
        o.alias("o"),
        t.alias("t"),
        F.col("y").alias("lag1"),
        F.lag("y", 1).over(order).alias("lag2"),
        F.lag("y", 2).over(order).alias("lag3"),
        *[F.avg("y").over(over(k)).alias(f"mean{k}") for k in (3, 6, 12)],
        F.stddev_pop("y").over(over(6)).alias("std6"),
        F.avg(zero).over(over(12)).alias("zero_share12"),
        F.row_number().over(order).alias("months_active"),
        last_year.alias("ly"),
        panel.month_of_year(t).alias("month_t"),
        panel.business_days(t).alias("n_days_t"),
        *[rate("y", k).alias(f"rate{k}") for k in (3, 6, 12)],
        *[rate("active_days", k).alias(f"occ{k}") for k in (3, 6, 12)],
        F.lead("y", horizon).over(order).alias("y"),
    )
    # Filtered after the windows, which need the earlier months, and before the joins.
    rows = windows.where(F.col("o").between(first_origin, n_months - horizon - 1))
    ratios = panel.planta_side(seasonal_ratios(panel, horizon).withColumnRenamed("mi", "o"))
    joined = rows.join(ratios, ["planta", "o"], "left")
    if ahead:
        # The planta code does not depend on the month, so rows past the data still get theirs.
        joined = joined.drop("planta_code").join(panel.planta_side(panel.plantas()), "planta", "left")
    joined = joined.withColumn("size6", F.when(F.col("occ6") > 0, ratio(F.col("rate6"), F.col("occ6")))).withColumn(
        "ly_rate", ratio(F.col("ly"), panel.business_days(F.col("t") - 12))
    )
    return joined.select(*SERIES, "o", "t", *FEATURES, "y", *baseline_columns())


def baseline_columns() -> list[Column]:
    mean6 = F.col("mean6")
    return [
        F.col("lag1").alias("p_naive"),
        F.col("mean3").alias("p_mean3"),
        mean6.alias("p_mean6"),
        F.col("mean12").alias("p_mean12"),
        (F.col("rate6") * F.col("n_days_t")).alias("p_perday6"),
        F.coalesce(F.col("ly"), mean6).alias("p_seasonal_naive"),
        F.coalesce(mean6 * F.col("ratio_global"), mean6).alias("p_mean6_x_global"),
        F.coalesce(mean6 * F.col("ratio_planta"), mean6).alias("p_mean6_x_planta"),
    ]


def direct_forecasts(panel: Panel, horizon: int, level: str = "planta") -> DataFrame:
    """The simple models applied to planta (or total) series, for every origin: (planta, o, t, one column per model)."""
    series = panel.planta_months()
    if level == "total":
        series = series.groupBy("mi").agg(F.sum("y").alias("y")).withColumn("planta", F.lit(""))
    order = Window.partitionBy("planta").orderBy("mi")
    o, t = F.col("mi"), F.col("mi") + F.lit(horizon)

    def mean(k: int) -> Column:
        return F.avg("y").over(order.rowsBetween(-k + 1, 0))

    days = panel.business_days(o).cast("double")
    rate6 = ratio(F.sum("y").over(order.rowsBetween(-5, 0)), F.sum(days).over(order.rowsBetween(-5, 0)))
    last_year = F.lag("y", 12 - horizon).over(order) if horizon <= 12 else F.lead("y", horizon - 12).over(order)
    seasonal = F.when(o >= 17, ratio(last_year, F.avg("y").over(order.rowsBetween(-17, -12))))
    return series.select(
        "planta", o.alias("o"), t.alias("t"),
        F.col("y").alias("naive"), mean(3).alias("mean3"), mean(6).alias("mean6"), mean(12).alias("mean12"),
        (rate6 * panel.business_days(t)).alias("perday6"),
        F.coalesce(last_year, mean(6)).alias("seasonal_naive"),
        F.coalesce(mean(6) * seasonal, mean(6)).alias("mean6_x_seasonal"),
    )


def add_partial_features(frame: DataFrame, df: DataFrame, panel: Panel, day: int) -> DataFrame:
    """Month-to-date features of month o + 1 from its first `day` days."""
    seen = month_to_date(df, panel.first_ym, day).withColumn("o", F.col("mi") - 1).drop("mi")
    month = F.col("o") + 1
    cut = F.least(F.date_add(panel.first_day(month), day - 1), panel.last_day(month))
    elapsed = working_days(panel.first_day(month), cut).cast("double")
    joined = frame.join(seen, [*SERIES, "o"], "left")
    mtd, active = F.coalesce("mtd", F.lit(0.0)), F.coalesce("active", F.lit(0.0))
    rate = ratio(mtd, F.when(elapsed > 0, elapsed))
    return joined.select(
        *frame.columns,
        mtd.alias("mtd"),
        rate.alias("mtd_rate"),
        ratio(active, F.when(elapsed > 0, elapsed)).alias("mtd_occ"),
        (rate * panel.business_days(month)).alias("mtd_proj"),
    )
