"""Scores at SKU, planta and total level from one aggregation of the forecasts into (month, planta, model) cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.functions.numbers import ratio
from caudal.functions.scores import ERROR_SUMS, add_up, error_sums, ranked, score_columns
from caudal.operators.features import direct_forecasts
from caudal.operators.panel import Panel

LEVELS = ["sku", "planta", "total"]


def last_months(panel: Panel, n: int) -> Column:
    """The last `n` target months (column t)."""
    return F.col("t").between(panel.last_mi - n + 1, panel.last_mi)


def long_forecasts(res: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    """One row per forecast: `keep`, modelo, p. Works for any number of models in one later aggregation."""
    renamed = res.select(*keep, *[F.col(f"p_{m}").alias(m) for m in models])
    return renamed.unpivot(keep, models, "modelo", "p")


def cells(res: DataFrame, models: list[str]) -> DataFrame:
    """The sums of every (t, planta, modelo): the only step that reads all the forecasts."""
    return long_forecasts(res, models, ["t", "planta", "y"]).groupBy("t", "planta", "modelo").agg(*error_sums(F.col("y"), F.col("p")))


def planta_cells(panel: Panel, sums: DataFrame, models: list[str], months: DataFrame) -> DataFrame:
    """Real planta totals and bottom-up forecasts of every planta, month and model (0 where no series was forecast)."""
    real = panel.planta_months().withColumnRenamed("mi", "t").join(F.broadcast(months), "t").select("t", "planta", F.col("y").alias("real"))
    grid = real.withColumn("modelo", F.explode(F.array(*[F.lit(m) for m in models])))
    bottom_up = sums.select("t", "planta", "modelo", F.col("pronostico").alias("p"))
    return grid.join(bottom_up, ["t", "planta", "modelo"], "left").select("t", "planta", "modelo", "real", F.coalesce("p", F.lit(0.0)).alias("p"))


def _months(panel: Panel, first: int, last: int) -> DataFrame:
    return panel.monthly.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("t"))


def level_sums(panel: Panel, res: DataFrame, models: list[str], first: int, last: int) -> DataFrame:
    """(nivel, t, modelo) error sums of every month: series pooled, planta totals pooled, grand total."""
    sums = cells(res.where(F.col("t").between(first, last)), models)
    plantas = planta_cells(panel, sums, models, _months(panel, first, last))
    keys = ["t", "modelo"]
    sku = sums.groupBy(*keys).agg(*add_up()).select(F.lit("sku").alias("nivel"), *keys, *ERROR_SUMS)
    gap = F.col("error")
    upper = plantas.groupBy(*keys).agg(*error_sums(F.col("real"), F.col("p"))).select(*keys, F.explode(F.array(
        F.struct(F.lit("planta").alias("nivel"), "n", "abs_error", "error", "real", "pronostico"),
        F.struct(F.lit("total").alias("nivel"), F.lit(1).cast("bigint").alias("n"), F.abs(gap).alias("abs_error"), "error", "real", "pronostico"),
    )).alias("l"))
    return sku.unionByName(upper.select(*keys, "l.*"))


def score_models_by_level(panel: Panel, res: DataFrame, models: list[str], first: int, last: int) -> DataFrame:
    """Ranked accuracy of the models at every level over the months first..last (nivel, rank, modelo, scores)."""
    sums = level_sums(panel, res, models, first, last).groupBy("nivel", "modelo").agg(*add_up())
    return ranked(sums.select("nivel", "modelo", *score_columns()), ["nivel"])


def scores_by_month(res: DataFrame, models: list[str]) -> DataFrame:
    """SKU-level scores of each target month and model."""
    return cells(res, models).groupBy("t", "modelo").agg(*add_up()).select("t", "modelo", *score_columns())


def accuracy_pivot(scores: DataFrame, months: str, models: list[str]) -> DataFrame:
    """Accuracy in percent, one row per month and one column per model."""
    return scores.groupBy(months).pivot("modelo", models).agg(F.first(F.col("accuracy") * 100))


def reconcile(res: DataFrame, panel: Panel, horizon: int, column: str, out: str) -> DataFrame:
    """Scale the forecasts of each planta and month so they add up to the direct planta forecast.

    The sums are a partial aggregation, and come back as a planta by month table; no window over a whole planta.
    """
    control = direct_forecasts(panel, horizon).select("planta", "t", F.col("mean6_x_seasonal").alias("control"))
    sums = res.groupBy("planta", "t").agg(F.sum(column).alias("suma"))
    factor = ratio(F.col("control"), F.when(F.col("suma") != 0, F.col("suma")))
    factors = sums.join(control, ["planta", "t"], "left").select("planta", "t", F.coalesce(factor, F.lit(1.0)).alias("factor"))
    return res.join(panel.planta_side(factors), ["planta", "t"]).withColumn(out, F.col(column) * F.col("factor")).drop("factor")


def losses(panel: Panel, res: DataFrame, models: list[str], first: int, last: int, level: str) -> DataFrame:
    """Absolute-error losses (t, modelo, loss) of every observation of a level."""
    if level == "sku":
        rows = long_forecasts(res.where(F.col("t").between(first, last)), models, ["t", "y"])
        return rows.select("t", "modelo", F.abs(F.col("y") - F.col("p")).alias("loss"))
    sums = cells(res.where(F.col("t").between(first, last)), models)
    rows = planta_cells(panel, sums, models, _months(panel, first, last))
    if level == "total":
        rows = rows.groupBy("t", "modelo").agg(F.sum("real").alias("real"), F.sum("p").alias("p"))
    return rows.select("t", "modelo", F.abs(F.col("real") - F.col("p")).alias("loss"))


def period_losses(panel: Panel, res: DataFrame, models: list[str], first: int, last: int) -> DataFrame:
    """Sum and count of the losses of every level, month and model: all the bootstrap needs."""
    return level_sums(panel, res, models, first, last).select("nivel", "t", "modelo", F.col("abs_error").alias("loss"), "n")


def roll_up(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(nivel, planta, sku, keys, value): the same measure by series, planta and total in one pass."""
    sets = [[*(F.col(c) for c in names), *(F.col(k) for k in keys)] for names in (["planta", "sku"], ["planta"], [])]
    level = F.when(F.grouping("sku") == 0, "sku").when(F.grouping("planta") == 0, "planta").otherwise("total")
    sums = rows.groupingSets(sets, F.col("planta"), F.col("sku"), *[F.col(k) for k in keys]).agg(F.sum(value).alias(value), level.alias("nivel"))
    return sums.select("nivel", "planta", "sku", *keys, value)


def months_won(sums: DataFrame, keys: list[str]) -> DataFrame:
    """How many months each model had the lowest WAPE in (nivel, modelo, meses); an exact tie goes to the first name."""
    wape = F.round(ratio(F.col("abs_error"), F.col("real")), 10)
    best = sums.groupBy(*keys).agg(F.min_by("modelo", F.struct(wape, "modelo")).alias("modelo"))
    return best.groupBy("nivel", "modelo").agg(F.count(F.lit(1)).alias("meses"))
