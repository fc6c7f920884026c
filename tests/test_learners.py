import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caudal.operators.features import make_frame
from caudal.operators.panel import build_panel
from caudal.plans import tuning as tn
from caudal.plans.learners import KINDS, Budget
from caudal.plans.production import run_prediction
from caudal.plans.strategies import collect_members, direct_forecast, iterated_forecast
from tests.test_panel import shaken

SMALL = Budget(max_trees=3, min_trees=2, rf_trees=3)
SHALLOW = {"lgbm": {"best_params": {"leaves": 4, "min_rows": 5}}, "xgb": {"best_params": {"depth": 2, "min_weight": 1.0}}, "rf": {"best_params": {"depth": 3}}}


@pytest.fixture(scope="module")
def panel(fact):
    return build_panel(fact)


def values(df):
    return {(r["planta"], r["sku"]): tuple(r[k] for k in [*KINDS, "ml_mean"]) for r in df.collect()}


def test_forecasts_repeat_do_not_look_ahead_and_are_not_negative(fact, panel):
    first = values(direct_forecast(panel, 20, 1, SHALLOW, SMALL))
    changed = build_panel(shaken(fact, dt.date(2024, 9, 30)))
    again = values(direct_forecast(changed, 20, 1, SHALLOW, SMALL))
    assert len(first) == 12 and first.keys() == again.keys()
    for key, row in first.items():
        assert row == pytest.approx(again[key]) and min(row) >= 0
        assert row[-1] == pytest.approx(sum(row[:3]) / 3)


def test_second_step_keeps_the_series_of_the_origin(panel):
    rows = iterated_forecast(panel, 27, SHALLOW, SMALL).collect()
    assert len(rows) == 12 and {r["mes"] for r in rows} == {"2025-06"} and {r["mes_origen"] for r in rows} == {"2025-04"}


def test_backtest_rows(panel):
    rows = collect_members(make_frame(panel, 1), [28, 29], 1, SHALLOW, SMALL)
    assert {r["t"]: r["n"] for r in rows.groupBy("t").agg(F.count("*").alias("n")).collect()} == {28: 12, 29: 12}


def test_folds_are_chronological(panel):
    assert tn.fold_starts(20) == [12, 15, 18]
    table = tn.fold_table(make_frame(panel, 2), 2, 20).collect()
    for k, start in enumerate((12, 15, 18)):
        train = [r["t"] for r in table if r["fold"] == k and r["parte"] == "train"]
        val = sorted(r["t"] for r in table if r["fold"] == k and r["parte"] == "val")
        assert max(train) == start - 2 and val == [start, start + 1, start + 2]


def test_samples_stay_in_the_space():
    rng = random.Random(0)
    for kind in KINDS:
        for _ in range(50):
            draw = tn.sample(kind, rng)
            for name, given in tn.SPACE[kind].items():
                if isinstance(given, list):
                    assert draw[name] in given
                else:
                    assert given[0] <= draw[name] <= given[1] and (not given[2] or draw[name] == int(draw[name]))


def test_production_run(fact, folder, spark):
    run = run_prediction(fact.where(F.col("fecha") <= F.lit(dt.date(2025, 5, 15))), folder, tuned=SHALLOW, budget=SMALL)
    assert (run.plan.strategy, run.plan.origin, run.plan.target, run.state.cutoff_day) == ("nowcast_media", "2025-04", "2025-06", 15)
    saved = spark.read.parquet(folder + "/forecast")
    assert saved.count() == run.result.count() == 12
    assert '"first_date":"2023-01-02"' in spark.read.text(folder + "/manifest").first()[0]
