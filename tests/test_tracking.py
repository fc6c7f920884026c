import datetime as dt

import pytest
from pyspark.sql import functions as F

from caudal.operators import tracking as tr
from caudal.operators.panel import build_panel

JAN, FEB = dt.date(2024, 1, 10), dt.date(2024, 2, 10)
END = dt.date(2024, 2, 29)


@pytest.fixture(scope="module")
def case(spark):
    rows = [("A", "s1", JAN, 10.0), ("A", "s1", FEB, 12.0), ("A", "s2", JAN, 20.0), ("A", "s2", FEB, 18.0), ("B", "s3", JAN, 30.0), ("B", "s3", END, 30.0), ("B", "s4", FEB, 5.0)]
    df = spark.createDataFrame(rows, "planta string, sku string, fecha date, consumo double")
    forecast = spark.createDataFrame([("A", "s1", "2024-02", 10.0, 10.0), ("A", "s2", "2024-02", 20.0, 20.0), ("B", "s3", "2024-02", 36.0, 30.0)], "planta string, sku string, mes string, ml_mean double, naive double")
    return df, build_panel(df), forecast


def test_scores_by_hand(case):
    _, panel, forecast = case
    got = {(r["nivel"], r["planta"], r["modelo"]): r for r in tr.month_scores(panel, forecast).collect()}
    assert got["sku", "", "ml_mean"]["acierto"] == pytest.approx(1 - 10 / 60)
    assert got["planta", "", "ml_mean"]["acierto"] == pytest.approx(1 - 1 / 65)
    assert got["total", "", "ml_mean"]["acierto"] == pytest.approx(1 - 1 / 65)
    assert (got["sin_pronostico", "", "-"]["n"], got["sin_pronostico", "", "-"]["real_TO"]) == (1, 5.0)
    assert got["planta", "B", "ml_mean"]["real_TO"] == 35.0


def test_a_month_without_consumption_has_no_ratio(case):
    _, panel, forecast = case
    gone = forecast.withColumn("planta", F.lit("Z")).withColumn("sku", F.concat("sku", F.lit("-gone")))
    row = tr.month_scores(panel, gone).where("nivel = 'sku' and modelo = 'naive'").first()
    assert row["acierto"] is None and row["bias_pct"] is None and row["n"] == 3


def test_equal_to_the_threshold_does_not_fire(spark):
    row = lambda level, model, value: ("2024-02", level, "", model, value)
    schema = "mes string, nivel string, planta string, modelo string, acierto double"
    equal = spark.createDataFrame([row("sku", "ml_mean", 0.64), row("sku", "naive", 0.64), row("planta", "ml_mean", 0.85), row("total", "ml_mean", 0.90)], schema)
    assert tr.find_alerts(equal).count() == 0
    below = spark.createDataFrame([row("sku", "ml_mean", 0.63), row("sku", "naive", 0.64), row("planta", "ml_mean", 0.84), row("total", "ml_mean", 0.89), ("2024-02", "planta", "A", "ml_mean", 0.5)], schema)
    assert sorted((r["codigo"], r["tipo"]) for r in tr.find_alerts(below).collect()) == [
        ("peor_que_naive", "alerta"), ("planta_bajo", "alerta"), ("planta_revisar", "info"), ("sku_bajo", "alerta"), ("total_bajo", "alerta"),
    ]
    two = tr.find_alerts(below, strategy=F.lit("iterada")).collect()
    assert sorted(r["codigo"] for r in two) == ["peor_que_naive", "planta_revisar"]


def test_only_closed_months_and_known_forecasts_are_tracked(case):
    df, panel, forecast = case
    by = ["mes", "run_id", "estrategia"]
    runs = forecast.withColumns({"run_id": F.lit("r1"), "estrategia": F.lit("h1")})
    foreign = runs.withColumns({"run_id": F.lit("r2"), "sku": F.concat("sku", F.lit("?"))})
    early = runs.withColumns({"run_id": F.lit("r3"), "mes": F.lit("2024-03")})
    rows = tr.track(df, panel, runs.unionByName(foreign).unionByName(early), by, F.lit("2024-03-01 00:00:00"))
    assert [r["run_id"] for r in rows.select("run_id").distinct().collect()] == ["r1"]
    assert set(rows.columns) == set(tr.TRACKING_COLUMNS)


def test_history_keeps_the_newest_run(spark):
    schema = "run_id string, mes string, nivel string, planta string, modelo string, acierto double, wape double, bias_pct double, n bigint, real_TO double, pronostico_TO double, alerta string, creado_en string, estrategia string, corte int"
    row = lambda run, value, created: (run, "2024-02", "sku", "", "ml_mean", value, 0.0, 0.0, 1, 1.0, 1.0, "", created, "h1", None)
    table = spark.createDataFrame([row("b", 0.7, "2024-03-02"), row("a", 0.6, "2024-03-01"), row("c", 0.8, "2024-03-02"), row("backtest-h1", 0.5, "2024-01-01")], schema)
    got = {(r["origen"], r["run_id"]): r["sku"] for r in tr.history(table).collect()}
    assert got == {("produccion", "b"): 70.0, ("backtest", "backtest-h1"): 50.0}
