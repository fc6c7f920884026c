"""Runs and loads that must not lose data, white space of every kind, early stopping, and refused forecasts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caudal import session
from caudal.operators import checks, explore
from caudal.operators.loading import run_record, run_row
from caudal.operators.panel import build_panel
from caudal.operators.tracking import refused, strategy_of
from caudal.plans.learners import Budget
from caudal.plans.production import run_prediction
from caudal.sources.store import Versions

SMALL = Budget(max_trees=3, min_trees=2, rf_trees=3)
SHALLOW = {"lgbm": {"best_params": {"leaves": 4}}, "xgb": {"best_params": {"depth": 2}}, "rf": {"best_params": {"depth": 3}}}


def test_two_runs_keep_both_months_without_the_session_setting(spark, fact, folder):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        run_prediction(fact, folder, as_of="2025-04", strategy="h1", tuned=SHALLOW, budget=SMALL)
        run_prediction(fact, folder, as_of="2025-05", strategy="h1", tuned=SHALLOW, budget=SMALL)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    saved = spark.read.parquet(f"{folder}/forecast")
    assert {r["mes"]: r["n"] for r in saved.groupBy("mes").agg(F.count("*").alias("n")).collect()} == {"2025-05": 12, "2025-06": 12}
    manifests = spark.read.text(f"{folder}/manifest").select(F.col("value").alias("manifiesto"), F.lit("forecast_2025-05").alias("archivo"))
    assert manifests.count() == 2
    assert {r["estrategia"] for r in strategy_of(manifests).collect()} == {"h1"}
    rows = run_row(manifests.select(F.col("manifiesto").alias("manifest"))).collect()
    assert len({r["run_id"] for r in rows}) == 2 and all(r["pronosticos"] == 12 and r["series"] == 12 for r in rows)


def test_a_manifest_tells_its_strategy(spark, fact):
    forecast = fact.groupBy("planta", "sku").agg(F.sum("consumo").alias("ml_mean"))
    manifest = run_record(fact, forecast, "r", strategy="nowcast_media", cutoff_day=15)
    row = strategy_of(manifest.select(F.lit("forecast_2025-05").alias("archivo"), F.col("manifest").alias("manifiesto"))).first()
    assert (row["estrategia"], row["corte"]) == ("nowcast_media", 15)


def test_a_shared_folder_is_needed_away_from_one_machine(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="share"):
        session.checkpoint_dir(Session())


def test_no_break_spaces_are_white_space(make_fact):
    rows = make_fact([("A\u00a0", "S/01", dt.date(2024, 1, 1), 1.0), ("A", "S/01", dt.date(2024, 1, 2), 1.0), ("\u00a0", "S/01", dt.date(2024, 1, 3), 1.0)])
    assert checks.missing(rows).count() == 1
    assert checks.keys(rows).count() == 2
    assert checks.near_duplicate_keys(rows).count() == 2


def test_an_empty_text_suggests_the_first_names(spark):
    names = spark.createDataFrame([("Ce",), ("Alpha",), ("B",)], "nombre string")
    assert [r["nombre"] for r in explore.suggest(names, " ", 2).collect()] == ["Alpha", "B"]


def test_refused_forecasts_are_listed(spark, fact):
    forecast = spark.createDataFrame([("r", "2025-05", "NORTE", "G10/01/90gsm/1800mm/KRAFT", 1.0), ("r", "2030-01", "NORTE", "G10/01/90gsm/1800mm/KRAFT", 1.0)], "run_id string, mes string, planta string, sku string, ml_mean double")
    got = {(r["mes"], r["motivo"]) for r in refused(fact, build_panel(fact), forecast, ["run_id", "mes"]).collect()}
    assert ("2030-01", "mes abierto") in got and not any(m == "2025-05" for m, _ in got)


def test_a_version_is_written_once(spark, fact, folder):
    table = Versions(spark, f"{folder}/master")
    assert table.publish(fact) == 1
    late = Versions(spark, f"{folder}/master")
    late.numbers = lambda: []  # another load that has looked before the first one was published
    with pytest.raises(Exception, match="(?i)exists"):
        late.publish(fact.limit(1))
    assert table.read().count() == fact.count()
