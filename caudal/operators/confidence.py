"""Model Confidence Set (Hansen, Lunde and Nason, 2011, Econometrica 79(2)) over monthly losses.

Months are resampled in circular blocks. Only monthly sums enter the bootstrap, so its size is draws x months whatever
the number of series; the pairwise statistics of all the draws are two aggregations and the driver sees one row of each.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.numbers import uniform
from caudal.session import cut_lineage

SMALLEST_SE = 1e-12


def bootstrap_means(period: DataFrame, n_periods: int, block: int, n_boot: int, seed: int, models: list[str]) -> DataFrame:
    """Mean loss of every model in every draw: (draw, one column per model)."""
    blocks = math.ceil(n_periods / block)

    def block_months(b: Column) -> Column:
        start = F.floor(uniform(F.lit(seed), F.col("draw"), b) * n_periods).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda k: (start + k) % n_periods)

    picks = F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), block_months)), 1, n_periods)
    draws = period.sparkSession.range(n_boot).withColumnRenamed("id", "draw").select("draw", F.explode(picks).alias("pos"))
    drawn = draws.join(F.broadcast(period), "pos")  # one row per month and model
    wide = drawn.groupBy("draw").pivot("modelo", models).agg(F.sum("loss") / F.sum("n"))
    return wide


def model_confidence_set(period_loss: DataFrame, models: list[str], block: int = 3, n_boot: int = 5000, seed: int = 0) -> DataFrame:
    """Run the MCS on (t, modelo, loss, n) sums: model, elimination_step, mean_loss, mcs_p_value.

    The standard errors do not depend on which models are left, so the whole elimination order follows from one row of
    pair statistics, and every p-value is an average over the draws computed in one pass.
    """
    spark = period_loss.sparkSession
    period_loss = cut_lineage(period_loss.select("t", "modelo", "loss", "n"))  # months x models, read by several jobs
    months = period_loss.select("t").distinct()
    n_periods = months.count()
    block = min(block, max(1, n_periods // 3))
    places = months.withColumn("pos", (F.row_number().over(Window.orderBy("t")) - 1).cast("int"))
    period = period_loss.join(places, "t").select("pos", "modelo", "loss", "n")
    boot = bootstrap_means(period, n_periods, block, n_boot, seed, models).persist()
    sample_row = period.groupBy().pivot("modelo", models).agg(F.sum("loss") / F.sum("n")).first()
    mean = {m: sample_row[m] for m in models}
    pairs = list(combinations(models, 2))
    spread = boot.agg(*[F.stddev_pop(F.col(a) - F.col(b)).alias(f"{a}|{b}") for a, b in pairs]).first()
    se = {pair: max(spread["|".join(pair)], SMALLEST_SE) for pair in pairs}

    def t_stat(a: str, b: str) -> float:
        return (mean[a] - mean[b]) / se[(a, b)] if (a, b) in se else -(mean[b] - mean[a]) / se[(b, a)]

    alive, order, steps = list(models), [], []
    while len(alive) > 1:
        left = list(combinations(alive, 2))
        statistic = max(abs(t_stat(a, b)) for a, b in left)
        excess = {m: max(0.0, *(t_stat(m, other) for other in alive if other != m)) for m in alive}
        steps.append((left, statistic))
        worst = max(alive, key=lambda m: excess[m])
        order.append(worst)
        alive.remove(worst)
    order += alive

    def reached(left: list[tuple[str, str]], statistic: float) -> Column:
        gaps = [F.abs(F.col(a) - F.col(b) - F.lit(mean[a] - mean[b])) / F.lit(se[(a, b)]) for a, b in left]
        top = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
        return F.avg((top >= F.lit(statistic)).cast("double"))

    shares = boot.agg(*[reached(*step).alias(f"step{i}") for i, step in enumerate(steps)]).first() if steps else []
    boot.unpersist()
    p_values, running = [], 0.0
    for share in shares:
        running = max(running, share)
        p_values.append(running)
    rows = [(m, i + 1, mean[m], p) for i, (m, p) in enumerate(zip(order, [*p_values, 1.0]))]
    return spark.createDataFrame(rows, "model string, elimination_step int, mean_loss double, mcs_p_value double")


def with_sets(table: DataFrame, alphas: tuple[float, ...] = (0.10, 0.25)) -> DataFrame:
    """Rank by p-value then loss, and membership at each level (a table of models)."""
    order = Window.orderBy(F.desc("mcs_p_value"), "mean_loss")
    return table.select(
        F.row_number().over(order).alias("rank"), "*", *[(F.col("mcs_p_value") >= a).alias(f"in_mcs_{int(a * 100)}") for a in alphas]
    )
