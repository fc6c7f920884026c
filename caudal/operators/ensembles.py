"""Forecast combinations: mean, median, trimmed mean and weights from past errors only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.numbers import row_mean, row_median, row_trimmed_mean

METHODS = ["mean", "median", "trimmed", "weighted"]
SMALLEST_ERROR = 1e-9


def past_weights(res: DataFrame, members: list[str], horizon: int) -> DataFrame:
    """(t, w_<member>): weights proportional to 1 / MAE over the months already known at the origin of t.

    The errors are added up per month first; the expanding window then runs over a table of months.
    """
    totals = res.groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.abs(F.col("y") - F.col(f"p_{m}"))).alias(f"e_{m}") for m in members]
    )
    past = Window.orderBy("t").rangeBetween(Window.unboundedPreceding, -horizon)
    seen = totals.select("t", F.sum("n").over(past).alias("n"), *[F.sum(f"e_{m}").over(past).alias(f"e_{m}") for m in members])
    inverse = {m: 1.0 / F.greatest(F.col(f"e_{m}") / F.col("n"), F.lit(SMALLEST_ERROR)) for m in members}
    total = sum(inverse.values(), F.lit(0.0))
    equal = F.lit(1.0 / len(members))
    return seen.select("t", *[F.coalesce(inverse[m] / total, equal).alias(f"w_{m}") for m in members])


def add_ensembles(res: DataFrame, groups: dict[str, list[str]], horizon: int) -> DataFrame:
    """Add p_<group>_<method> for every group of members; the weight table has one row per month."""
    out = res
    for group, members in groups.items():
        columns = [F.col(f"p_{m}") for m in members]
        weights = F.broadcast(past_weights(res, members, horizon))  # as many rows as target months
        weighted = sum((F.col(f"p_{m}") * F.col(f"w_{m}") for m in members), F.lit(0.0))
        out = out.join(weights, "t").withColumns({
            f"p_{group}_mean": row_mean(columns),
            f"p_{group}_median": row_median(columns),
            f"p_{group}_trimmed": row_trimmed_mean(columns),
            f"p_{group}_weighted": weighted,
        }).drop(*[f"w_{m}" for m in members])
    return out
