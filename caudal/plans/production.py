"""One production forecast run: check the data, choose the strategy from its state, forecast, save with its record."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.operators.checks import validate
from caudal.operators.loading import panel_mark, run_record
from caudal.operators.month_state import MonthState, StrategyPlan, resolve_strategy, up_to_month
from caudal.operators.panel import Panel, build_panel
from caudal.plans.learners import Budget
from caudal.plans.strategies import FORECAST_COLUMNS, forecast_with_strategy
from caudal.session import cut_lineage


@dataclass(frozen=True)
class PredictionRun:
    result: DataFrame
    warnings: DataFrame
    manifest: DataFrame
    panel: Panel
    state: MonthState
    plan: StrategyPlan


def run_prediction(
    full: DataFrame, out_path: str | None = None, as_of: str | None = None, strategy: str = "automatica", cutoff_day: int | None = None,
    tuned: dict | None = None, budget: Budget = Budget(),
) -> PredictionRun:
    """Forecast the month the data and the settings ask for. Stops when the checks find errors or the settings do not fit.
    A saved run replaces its own (estrategia, mes_origen) block only, and adds a manifest of its own."""
    warnings = validate(full)
    df = full if as_of is None else up_to_month(full, as_of)
    state, plan = resolve_strategy(df, strategy, cutoff_day)
    panel = build_panel(df)
    result = forecast_with_strategy(df, panel, plan.strategy, panel.index_of(plan.origin), plan.cutoff_day, tuned, budget)
    result = cut_lineage(result.select(*FORECAST_COLUMNS, "mes_origen", "estrategia"))
    run_id = uuid.uuid4().hex
    manifest = cut_lineage(run_record(df, result, run_id=run_id, strategy=plan.strategy, cutoff_day=plan.cutoff_day, mark=panel_mark(panel), warnings=warnings))
    if out_path is not None:
        rounded = [F.bround(c, 3).alias(c) if kind == "double" else F.col(c) for c, kind in result.dtypes]
        blocks = result.select(*rounded).hint("rebalance", "estrategia", "mes_origen").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        blocks.partitionBy("estrategia", "mes_origen").parquet(f"{out_path}/forecast")
        manifest.write.mode("errorifexists").text(f"{out_path}/manifest/run_id={run_id}")
    return PredictionRun(result, warnings, manifest, panel, state, plan)
