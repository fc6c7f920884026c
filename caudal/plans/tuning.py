"""Better parameters for the learners: random draws scored on later and later quarters, then a test on unseen months.

Draw 0 is the standing configuration and the others follow from the seed. All fits of a study share the cluster.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.functions.scores import error_sums
from caudal.operators.features import FEATURES
from caudal.operators.levels import reconcile, score_models_by_level
from caudal.operators.panel import Panel
from caudal.plans.boosting import fit_models, forecasts
from caudal.plans.learners import BASE, Budget, Fit
from caudal.session import cut_lineage

FOLD_MONTHS = 3
N_FOLDS = 3
# Fixed values, the ranges of the search: (low, high, whole number?, logarithmic?), or the names to choose from.
SPACE = {
    "lgbm": {
        "power": (1.05, 1.9, False, False), "rate": (0.02, 0.2, False, True), "leaves": (4, 128, True, True), "min_rows": (5, 200, True, True), "row_share": (0.5, 1.0, False, False),
        "column_share": (0.4, 1.0, False, False), "l1": (1e-8, 10.0, False, True), "l2": (1e-8, 10.0, False, True),
    },
    "xgb": {
        "power": (1.05, 1.9, False, False), "rate": (0.02, 0.2, False, True), "depth": (3, 10, True, False), "min_weight": (1.0, 200.0, False, True), "gain": (1e-8, 5.0, False, True),
        "row_share": (0.5, 1.0, False, False), "column_share": (0.4, 1.0, False, False), "l1": (1e-8, 10.0, False, True), "l2": (1e-8, 10.0, False, True),
    },
    "rf": {"criterion": ["squared", "poisson"], "column_share": (0.2, 1.0, False, False), "min_rows": (1, 60, True, True), "row_share": (0.3, 1.0, False, False)},
}


def fold_starts(tune_end: int) -> list[int]:
    """Where the validation quarters begin: back to back, the last one closing with `tune_end`."""
    first = tune_end - N_FOLDS * FOLD_MONTHS + 1
    return [first + k * FOLD_MONTHS for k in range(N_FOLDS)]


def fold_table(frame: DataFrame, horizon: int, tune_end: int) -> DataFrame:
    """(fold, parte, t, n): rows of every fold by target month; training ends `horizon` months before validation."""
    parts = None
    for k, start in enumerate(fold_starts(tune_end)):
        side = F.when(F.col("t") <= start - horizon, "train").when(F.col("t").between(start, start + FOLD_MONTHS - 1), "val")
        part = frame.select(F.lit(k).alias("fold"), side.alias("parte"), "t").where(F.col("parte").isNotNull())
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("fold", "parte", "t").agg(F.count(F.lit(1)).alias("n"))


def sample(kind: str, rng: random.Random) -> dict:
    """One draw of the search space."""
    out = dict(BASE[kind])
    for name, range_ in SPACE[kind].items():
        if isinstance(range_, list):
            out[name] = rng.choice(range_)
            continue
        low, high, whole, logarithmic = range_
        value = low * (high / low) ** rng.random() if logarithmic else low + (high - low) * rng.random()
        out[name] = round(value) if whole else value
    return out


def run_study(kind: str, frame: DataFrame, horizon: int, tune_end: int, n_trials: int, seed: int = 42, budget: Budget = Budget(), base: dict | None = None) -> DataFrame:
    """(trial, wape, fold_wape, params): the baseline is trial 0. All trials on all folds are fitted at once, as many side by side as there
    are cores: a fit whose patience is over makes room for the next."""
    ready = cut_lineage(frame.where(F.col("t") <= tune_end))
    rng = random.Random(seed)
    trials = [base or BASE[kind], *[sample(kind, rng) for _ in range(n_trials - 1)]]
    starts = fold_starts(tune_end)
    fits = [Fit(f"{trial}:{fold}", kind, params, start - horizon, 0, budget) for trial, params in enumerate(trials) for fold, start in enumerate(starts)]
    models = fit_models(ready, fits, FEATURES)
    fold = F.floor((F.col("t") - starts[0]) / FOLD_MONTHS).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))).alias("trial")
    rows = ready.where(F.col("t").between(starts[0], tune_end)).select("planta", "sku", "o", "t", "y", *FEATURES, fold.alias("fold"), each)
    judged = forecasts(models, rows.withColumn("group", F.concat_ws(":", "trial", "fold")), FEATURES, [kind])
    errors = judged.groupBy("trial", "fold").agg(*error_sums(F.col("y"), F.col(kind))).select("trial", "fold", (F.col("abs_error") / F.col("real")).alias("wape"))
    scores = errors.groupBy("trial").agg(F.avg("wape").alias("wape"), F.transform(F.sort_array(F.collect_list(F.struct("fold", "wape"))), lambda x: x["wape"]).alias("fold_wape"))
    given = frame.sparkSession.createDataFrame([(i, {k: str(v) for k, v in params.items()}) for i, params in enumerate(trials)], "trial int, params map<string,string>")
    return scores.join(given, "trial").select(F.col("trial").cast("int").alias("trial"), "wape", "fold_wape", "params")


def best_params(study: DataFrame, kind: str) -> dict:
    """The parameters of the best trial, typed like the baseline."""
    row = study.orderBy("wape", "trial").first()
    def typed(text: str):
        try:
            return int(text)
        except ValueError:
            try:
                return float(text)
            except ValueError:
                return text
    keep_text = {k for k, v in BASE[kind].items() if isinstance(v, str)}
    return {k: v if k in keep_text else typed(v) for k, v in row["params"].items()}


def rolling_test(kind: str, params: dict, frame: DataFrame, panel: Panel, horizon: int, test_months: list[int], seeds: list[int], budget: Budget = Budget()) -> DataFrame:
    """Refit before every test month, once per seed: (semilla, planta, sku, o, t, y, p_naive, p, p_rec). All are fitted at once."""
    ready = cut_lineage(frame)
    models = fit_models(ready, [Fit(f"{seed}:{t}", kind, params, t - horizon, seed, budget) for seed in seeds for t in test_months], FEATURES)
    rows = ready.where(F.col("t").isin(test_months)).withColumn("semilla", F.explode(F.array(*map(F.lit, seeds))))
    out = forecasts(models, rows.withColumn("group", F.concat_ws(":", "semilla", "t")), FEATURES, [kind])
    out = cut_lineage(out.select("semilla", "planta", "sku", "o", "t", "y", "p_naive", F.col(kind).alias("p")))
    runs = [reconcile(out.where(F.col("semilla") == seed), panel, horizon, "p", "p_rec") for seed in seeds]
    table = runs[0]
    for run in runs[1:]:
        table = table.unionByName(run)
    return table


def summarise(runs: DataFrame, panel: Panel, seeds: list[int], first: int, last: int) -> DataFrame:
    """Scores of every seed at every level, plain and reconciled: (semilla, nivel, modelo, scores)."""
    out = None
    renamed = runs.withColumnRenamed("p", "p_plain")
    for seed in seeds:
        part = score_models_by_level(panel, renamed.where(F.col("semilla") == seed), ["plain", "rec", "naive"], first, last).withColumn("semilla", F.lit(seed))
        out = part if out is None else out.unionByName(part)
    return out


def compare_base_and_tuned(kind: str, tuned: dict, frame: DataFrame, panel: Panel, horizon: int, test_months: list[int], seeds: list[int], budget: Budget = Budget(), base: dict | None = None) -> DataFrame:
    """(modelo, version, semilla, nivel, accuracy) of the plain forecasts of both configurations."""
    out = None
    for version, params in (("base", base or BASE[kind]), ("tuned", tuned)):
        runs = cut_lineage(rolling_test(kind, params, frame, panel, horizon, test_months, seeds, budget))
        scores = summarise(runs, panel, seeds, test_months[0], test_months[-1]).where(F.col("modelo") == "plain")
        part = scores.select(F.lit(kind).alias("modelo"), F.lit(version).alias("version"), "semilla", "nivel", "accuracy")
        out = part if out is None else out.unionByName(part)
    return out
