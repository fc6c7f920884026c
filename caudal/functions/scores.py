"""Forecast errors as mergeable sums: every score is a ratio of sums that any grouping can add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.numbers import ratio

ERROR_SUMS = ["n", "abs_error", "error", "real", "pronostico"]


def error_sums(real: Column, forecast: Column) -> list[Column]:
    """The five sums behind MAE, WAPE, accuracy and bias."""
    gap = real - forecast
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(gap)).alias("abs_error"),
        F.sum(gap).alias("error"),
        F.sum(real).alias("real"),
        F.sum(forecast).alias("pronostico"),
    ]


def add_up() -> list[Column]:
    """Merge already computed sums."""
    return [F.sum(name).alias(name) for name in ERROR_SUMS]


def score_columns() -> list[Column]:
    """n, mae, wape, accuracy and bias_pct (positive = forecast too low) from the five sums."""
    wape = ratio(F.col("abs_error"), F.col("real"))
    return [
        F.col("n"),
        ratio(F.col("abs_error"), F.col("n")).alias("mae"),
        wape.alias("wape"),
        (1.0 - wape).alias("accuracy"),
        (ratio(F.col("error"), F.col("real")) * 100.0).alias("bias_pct"),
    ]


def accuracy() -> Column:
    """1 - WAPE, null when there is no real consumption."""
    return F.when(F.col("real") > 0, 1.0 - F.col("abs_error") / F.col("real"))


def ranked(scores: DataFrame, within: list[str], by: str = "wape", descending: bool = False) -> DataFrame:
    """1-based rank, ties share the best place. Ranks a table of models; sums in parallel differ in the last
    bits between runs, so the rank looks at ten decimals."""
    value = F.round(F.col(by), 10)
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return scores.withColumn("rank", F.rank().over(Window.partitionBy(*within).orderBy(order)))
