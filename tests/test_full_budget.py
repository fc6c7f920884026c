"""The registered learner queries hand the production budget and the default parameters to the plans."""

import inspect

import pytest

import bench
from caudal.catalog import learning, load
from caudal.plans import strategies as sg
from caudal.plans import tuning as tn
from caudal.plans.learners import BASE, KINDS, Budget

PLANS = [(sg, "direct_forecast"), (sg, "forecast_with_strategy"), (sg, "nowcast_input_forecast"), (sg, "iterated_forecast"), (sg, "collect_members"), (sg, "strategy_forecasts"), (tn, "run_study"), (tn, "compare_base_and_tuned")]
QUERIES = [
    "forecast_next_month", "forecast_two_months_direct", "forecast_by_plan", "nowcast_input_forecast", "iterated_forecast", "backtest_members", "horizon_strategies",
    "tuning_search", "tuning_candidate",
]


class Called(Exception):
    pass


@pytest.mark.parametrize("name", QUERIES)
def test_production_budget(spark, monkeypatch, name):
    given = []

    def stand_in(plan):
        def called(*args, **named):
            bound = inspect.signature(plan).bind(*args, **named)
            bound.apply_defaults()
            given.append(bound.arguments)
            raise Called

        return called

    for module, plan in PLANS:
        monkeypatch.setattr(module, plan, stand_in(getattr(module, plan)))
    if name == "tuning_candidate":
        monkeypatch.setattr(learning, "studies", lambda spark, sf: spark.createDataFrame([(k, 0, 0.1, {p: str(v) for p, v in BASE[k].items()}) for k in KINDS], "kind string, trial int, wape double, params map<string,string>"))
    with pytest.raises(Called):
        load()[name].run(spark, "/root/testdata/sf0.001")
    own = given[0]
    assert own["budget"] == Budget()
    assert own.get("base") is None and (name == "tuning_candidate" or own.get("tuned") is None)
    assert own.get("n_trials", 100) >= 40 and len(own.get("seeds", [0, 1])) > 1


def test_benchmark_forecast_has_no_budget_of_its_own():
    assert not {"SHALLOW", "Budget"} & set(vars(bench))
