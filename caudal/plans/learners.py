"""The three members of the forecast: boosted trees of two shapes under the Tweedie loss, and a random forest.

`lgbm` and `xgb` are the names that forecast tables use for the boosted members: one bounds the leaves of a tree and takes the
planta as a category, the other bounds its depth. Missing values choose their side at every split. The number of boosted trees
is the one that `PATIENCE` further trees don't beat on the absolute error of the last target months; then all months are fitted again
with so many, and forecasts are never below 0. `caudal.plans.boosting` fits them.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.functions.numbers import row_mean
from caudal.operators.features import FEATURES
from caudal.plans.boosting import fit_models, forecasts
from caudal.plans.trees import Budget, Fit

KINDS = ["lgbm", "xgb", "rf"]
SEED = 0
MISSING = -1.0
# The parameters before any tuning. Power of the Tweedie variance, learning rate, bounds of a tree, least rows or hessian of a
# leaf, shares of rows and columns. A forest stops at `depth`.
BASE = {
    "lgbm": {"power": 1.2, "rate": 0.05, "leaves": 15, "min_rows": 30, "row_share": 0.8, "column_share": 0.8, "l1": 0.0, "l2": 0.0},
    "xgb": {"power": 1.2, "rate": 0.05, "depth": 6, "min_weight": 50.0, "row_share": 0.8, "column_share": 0.8, "gain": 0.0, "l1": 0.0, "l2": 1.0},
    "rf": {"criterion": "squared", "column_share": 1.0, "min_rows": 1, "row_share": 1.0, "depth": 12},
}
__all__ = ["BASE", "KINDS", "Budget", "Fit", "fit_members", "member_fits", "member_forecasts", "ml_mean", "parameters", "tweedie_model", "with_vector"]


def parameters(kind: str, tuned: dict | None) -> dict:
    """Tuned parameters over the base ones."""
    return {**BASE[kind], **(tuned or {}).get(kind, {}).get("best_params", {})}


def member_fits(group: str, train_to: int, tuned: dict | None = None, budget: Budget = Budget(), seed: int = SEED) -> list[Fit]:
    return [Fit(group, kind, parameters(kind, tuned), train_to, seed, budget) for kind in KINDS]


def fit_members(ready: DataFrame, train_to: dict[str, int], tuned: dict | None = None, budget: Budget = Budget(), seed: int = SEED, features: list[str] | None = None) -> DataFrame:
    """The members of every group, which trains on target months up to its `train_to`: one table of models. `ready` is settled."""
    return fit_models(ready, [f for group, to in train_to.items() for f in member_fits(group, to, tuned, budget, seed)], features or FEATURES)


def ml_mean() -> Column:
    return row_mean([F.col(k) for k in KINDS])


def member_forecasts(models: DataFrame, rows: DataFrame, features: list[str] | None = None) -> DataFrame:
    """`rows`, with the column `group` that names their models, with a column per member and their mean."""
    return forecasts(models, rows, features or FEATURES, KINDS).withColumn("ml_mean", ml_mean())


# ---- a generalised linear model beside the trees --------------------------------------------------------------------------


def with_vector(frame: DataFrame, features: list[str] | None = None) -> DataFrame:
    """The frame with its features as one vector; a missing value becomes -1, which no feature takes."""
    names = features or FEATURES
    filled = frame.select(*[c for c in frame.columns if c not in names], *[F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(c) for c in names])
    return VectorAssembler(inputCols=names, outputCol="features").transform(filled)


def tweedie_model(train: DataFrame, power: float = 1.2):
    """The Tweedie loss under a log link, without trees."""
    return GeneralizedLinearRegression(featuresCol="features", labelCol="y", family="tweedie", variancePower=power, linkPower=0.0).fit(train.where(F.col("y").isNotNull()))


def predicted(model, rows: DataFrame, name: str) -> DataFrame:
    """`rows` with the forecast of one linear model, never below 0."""
    return model.transform(rows).withColumn(name, F.greatest(F.col("prediction"), F.lit(0.0))).drop("prediction")
