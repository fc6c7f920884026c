"""Month-to-month changes and descriptive statistics of the consumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.numbers import ratio
from caudal.operators.panel import SERIES, Panel


def _change_columns(current: Column, previous: Column) -> list[Column]:
    change = current - previous
    return [
        previous.alias("consumo_mes_anterior"),
        current.alias("consumo_mes"),
        change.alias("cambio_TO"),
        F.when(previous > 0, change / previous * 100.0).alias("cambio_pct"),
    ]


def change_by_sku(panel: Panel) -> DataFrame:
    """Rows where either month has consumption. Each month is sent to itself and to the next one and added up: no
    grid of empty months is built."""
    now, later = F.struct("mi", F.col("y").alias("cur"), F.lit(0.0).alias("prev")), F.struct((F.col("mi") + 1).alias("mi"), F.lit(0.0).alias("cur"), F.col("y").alias("prev"))
    both = panel.known().select(*SERIES, F.explode(F.array(now, later)).alias("m")).select(*SERIES, "m.*")
    sums = both.groupBy(*SERIES, "mi").agg(F.sum("cur").alias("cur"), F.sum("prev").alias("prev"))
    rows = sums.where(F.col("mi").between(1, panel.last_mi) & ((F.col("cur") > 0) | (F.col("prev") > 0)))
    state = F.when(F.col("prev") == 0, "nuevo").when(F.col("cur") == 0, "sin consumo").otherwise("cambia")
    return rows.select(panel.label(F.col("mi")).alias("mes"), *SERIES, *_change_columns(F.col("cur"), F.col("prev")), state.alias("estado"))


def change_by_planta(panel: Panel) -> DataFrame:
    order = Window.partitionBy("planta").orderBy("mi")
    active = panel.known().groupBy("planta", "mi").agg(F.count_if(F.col("y") > 0).alias("skus_con_consumo"))
    rows = panel.planta_months().withColumn("prev", F.lag("y").over(order)).where(F.col("mi") >= 1)
    return rows.join(active, ["planta", "mi"], "left").select(
        panel.label(F.col("mi")).alias("mes"), "planta", *_change_columns(F.col("y"), F.col("prev")),
        F.coalesce("skus_con_consumo", F.lit(0)).alias("skus_con_consumo"),
    )


def _described(df: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("consumo").alias("n_obs"), F.min("fecha").alias("fecha_min"), F.max("fecha").alias("fecha_max"),
        F.bround(F.avg("consumo"), 3).alias("mean"), F.bround(F.stddev_samp("consumo"), 3).alias("std"),
        F.min("consumo").alias("min"), F.max("consumo").alias("max"),
        F.bround(F.avg((F.col("consumo") == 0).cast("double")) * 100, 1).alias("pct_zero"), *extra,
    )


def describe_series(df: DataFrame) -> DataFrame:
    """Count, span, coverage and consumption statistics of every series."""
    span = (F.date_diff("fecha_max", "fecha_min") + 1).cast("bigint")
    table = _described(df, SERIES).withColumn("span_days", span)
    coverage = F.bround(F.col("n_obs") / F.col("span_days") * 100, 1)
    return table.withColumn("coverage_pct", coverage).withColumn("cv", F.bround(ratio(F.col("std"), F.col("mean")), 3))


def describe_plantas(df: DataFrame) -> DataFrame:
    """The same by planta. The SKUs are counted after the fact is reduced to series, not with a distinct over rows."""
    table = _described(df, ["planta"], F.bround(F.sum("consumo"), 1).alias("consumo_total"))
    skus = df.select(*SERIES).distinct().groupBy("planta").agg(F.count(F.lit(1)).alias("n_sku"))
    return table.join(skus, "planta").select(
        "planta", "n_sku", "n_obs", "fecha_min", "fecha_max", "consumo_total",
        *[F.col(c).alias(f"consumo_{c}") for c in ("mean", "std", "min", "max")], "pct_zero",
        F.bround(ratio(F.col("std"), F.col("mean")), 3).alias("cv"), F.bround(F.col("n_obs") / F.col("n_sku"), 1).alias("obs_por_sku"),
    )
