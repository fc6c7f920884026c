"""Learned forecasts (rows-only: the learners are not SQL) and the folds they are tuned on."""

from __future__ import annotations

from pyspark.sql import functions as F

from caudal.catalog.domain import TEST_MONTHS, closed, closed_panel, consumption, frame, open_panel, written_once
from caudal.catalog.registry import query, rounded, with_
from caudal.operators.explore import candidate_summary
from caudal.operators.levels import score_models_by_level
from caudal.operators.month_state import resolve_strategy
from caudal.plans import strategies as sg
from caudal.plans import tuning as tn
from caudal.plans.learners import KINDS, predicted, tweedie_model, with_vector

# Every query fits with the production budget and the default parameters of the learners. The README says how long that takes.
DAY = 15
TRIALS = {"lgbm": 100, "xgb": 100, "rf": 40}
SEEDS = {"lgbm": [0, 1, 2], "xgb": [0, 1, 2], "rf": [0, 1]}


@query("forecast_next_month")
def forecast_next_month(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(sg.direct_forecast(panel, panel.last_mi, 1))


@query("forecast_two_months_direct")
def forecast_two_months_direct(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(sg.direct_forecast(panel, panel.last_mi - 2, 2, name="directa"))


@query("forecast_by_plan")
def forecast_by_plan(spark, sf):
    """The strategy the open month asks for (its first days complete it)."""
    df, panel = consumption(spark, sf), open_panel(spark, sf)
    _, plan = resolve_strategy(df)
    return rounded(sg.forecast_with_strategy(df, panel, plan.strategy, panel.index_of(plan.origin), plan.cutoff_day))


@query("nowcast_input_forecast")
def nowcast_input_forecast(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(sg.nowcast_input_forecast(closed(spark, sf), panel, panel.last_mi - 2, DAY))


@query("iterated_forecast")
def iterated_forecast(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(sg.iterated_forecast(panel, panel.last_mi - 2))


@query("tweedie_forecast")
def tweedie_forecast(spark, sf):
    """The Tweedie loss through a generalised linear model."""
    panel = closed_panel(spark, sf)
    ready = with_vector(frame(spark, sf))
    model = tweedie_model(ready.where(F.col("t") < panel.last_mi))
    return rounded(predicted(model, ready.where(F.col("t") == panel.last_mi), "tweedie").select("planta", "sku", "t", "y", "tweedie"))


@query("backtest_members")
def backtest_members(spark, sf):
    last = closed_panel(spark, sf).last_mi
    return rounded(sg.collect_members(frame(spark, sf), list(range(last - TEST_MONTHS + 1, last + 1)), 1))


@query("horizon_strategies")
def horizon_strategies(spark, sf):
    """Direct, direct with first days, iterated and naive, two months ahead, scored at every level."""
    panel = closed_panel(spark, sf)
    first = panel.last_mi - TEST_MONTHS + 1
    res = sg.strategy_forecasts(closed(spark, sf), panel, list(range(first, panel.last_mi + 1)), DAY)
    models = ["direct", "partial", "iterated", "naive"]
    return rounded(score_models_by_level(panel, sg.common_series(res, models), models, first, panel.last_mi))


@query("tuning_folds", with_("frame span", f"""
select k::int as fold, case when t <= s - 1 then 'train' else 'val' end as parte, t::int as t, count(*) as n
from frame cross join span cross join (values (0), (1), (2)) v(k) cross join lateral (select last_mi - {TEST_MONTHS} - 8 + 3 * k as s) w
where t <= s - 1 or t between s and s + 2 group by 1, 2, 3"""))
def tuning_folds(spark, sf):
    return tn.fold_table(frame(spark, sf), 1, closed_panel(spark, sf).last_mi - TEST_MONTHS)


def studies(spark, sf):
    """Every trial of every kind on the months before the test months."""

    def build():
        end = closed_panel(spark, sf).last_mi - TEST_MONTHS
        out = [tn.run_study(k, frame(spark, sf), 1, end, TRIALS[k]).withColumn("kind", F.lit(k)) for k in KINDS]
        return out[0].unionByName(out[1]).unionByName(out[2])

    return written_once(spark, sf, "tuning_studies", build)


@query("tuning_search")
def tuning_search(spark, sf):
    return rounded(studies(spark, sf).select("kind", "trial", "wape", F.map_entries("params").cast("string").alias("params")))


@query("tuning_candidate")
def tuning_candidate(spark, sf):
    """The best trial of each kind against the default parameters on the test months."""
    panel = closed_panel(spark, sf)
    months = list(range(panel.last_mi - TEST_MONTHS + 1, panel.last_mi + 1))
    best = {k: tn.best_params(studies(spark, sf).where(F.col("kind") == k), k) for k in KINDS}
    parts = [tn.compare_base_and_tuned(k, best[k], frame(spark, sf), panel, 1, months, SEEDS[k]) for k in KINDS]
    return rounded(candidate_summary(parts[0].unionByName(parts[1]).unionByName(parts[2])))
