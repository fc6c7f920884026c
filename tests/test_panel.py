import datetime as dt

import pytest
from pyspark.sql import functions as F

from caudal.operators import nowcast as nc
from caudal.operators import scenarios as sc
from caudal.operators.features import FEATURES, direct_forecasts, make_frame
from caudal.operators.month_state import detect_month_state, resolve_strategy
from caudal.operators.panel import build_panel, sorted_positions

ORIGIN = 20


def rows_of(df, keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def shaken(fact, after: dt.date):
    """The fact with everything after a day multiplied."""
    return fact.withColumn("consumo", F.when(F.col("fecha") > F.lit(after), F.col("consumo") * 7 + 3).otherwise(F.col("consumo")))


@pytest.fixture(scope="module")
def panel(fact):
    return build_panel(fact)


def test_totals_are_sums_of_the_series(fact, panel):
    total = fact.agg(F.sum("consumo")).first()[0]
    assert panel.dense().agg(F.sum("y")).first()[0] == pytest.approx(total)
    assert panel.planta_months().agg(F.sum("y")).first()[0] == pytest.approx(total)
    assert panel.total_months().agg(F.sum("y")).first()[0] == pytest.approx(total)
    assert panel.planta_months().count() == 4 * 30


def test_a_series_is_unknown_before_its_first_month_and_zero_later(make_fact):
    df = make_fact([("A", "s", dt.date(2024, 1, 3), 5.0), ("A", "t", dt.date(2024, 2, 1), 0.0), ("A", "t", dt.date(2024, 4, 1), 2.0)])
    got = rows_of(build_panel(df).dense(), ["sku", "mi"])
    assert {k: v["y"] for k, v in got.items()} == {("s", 0): 5.0, ("s", 1): 0.0, ("s", 2): 0.0, ("s", 3): 0.0, ("t", 1): 0.0, ("t", 2): 0.0, ("t", 3): 2.0}


def test_working_days_stop_at_the_last_record(make_fact):
    df = make_fact([("A", "s", dt.date(2024, 1, 3), 5.0), ("A", "s", dt.date(2024, 2, 10), 5.0)])
    panel = build_panel(df)
    assert [r["business_days"] for r in panel.months(ahead=1).orderBy("mi").collect()] == [27, 9, 26]
    assert [r["business_days"] for r in panel.completed_calendar().months().orderBy("mi").collect()] == [27, 25]


def test_features_by_hand(make_fact):
    """One series with value m in month m: windows are simple sums."""
    df = make_fact([("A", "s", dt.date(2022 + m // 12, m % 12 + 1, 3), float(m + 1)) for m in range(24)])
    row = make_frame(build_panel(df), 1, ahead=1).where("o = 23").first()
    assert (row["lag1"], row["lag2"], row["lag3"], row["mean3"], row["mean6"]) == (24.0, 23.0, 22.0, 23.0, 21.5)
    assert row["ly"] == 13.0 and row["months_active"] == 24 and row["y"] is None
    assert row["std6"] == pytest.approx(1.7078, abs=1e-4)
    assert row["ratio_planta"] == pytest.approx(13.0 / ((7 + 8 + 9 + 10 + 11 + 12) / 6))
    assert row["lyrel_planta"] == pytest.approx(13.0 / 13.0)
    assert row["size6"] == pytest.approx(21.5)


@pytest.mark.parametrize("horizon", [1, 2, 3])
def test_features_do_not_look_ahead(fact, panel, horizon):
    changed = build_panel(shaken(fact, dt.date(2024, 9, 30)))  # months 0..20 stay
    names = [c for c in FEATURES if c not in ("ratio_planta",)] + ["ratio_planta"]
    a = rows_of(make_frame(panel, horizon).where(F.col("o") <= ORIGIN).select("planta", "sku", "o", *names), ["planta", "sku", "o"])
    b = rows_of(make_frame(changed, horizon).where(F.col("o") <= ORIGIN).select("planta", "sku", "o", *names), ["planta", "sku", "o"])
    assert a == b and len(a) > 100


def test_masked_panel_gives_the_same_features_as_the_whole_one(panel):
    whole = rows_of(make_frame(panel, 2).where(F.col("o") == ORIGIN).select("planta", "sku", *FEATURES), ["planta", "sku"])
    masked = rows_of(make_frame(panel.masked(ORIGIN), 2, ahead=2).where(F.col("o") == ORIGIN).select("planta", "sku", *FEATURES), ["planta", "sku"])
    assert whole == masked


def test_direct_forecast_of_the_total_is_that_of_one_big_planta(fact, panel):
    one = build_panel(fact.withColumn("planta", F.lit("")))
    a = rows_of(direct_forecasts(panel, 1, "total"), ["o"])
    b = rows_of(direct_forecasts(one, 1), ["o"])
    for o, row in a.items():
        for name in ("naive", "mean6", "perday6", "mean6_x_seasonal"):
            assert row[name] == pytest.approx(b[o][name])


def test_positions_follow_the_names(make_fact):
    names = [("B", "x"), ("A", "K1/01"), ("A", "K10/01"), ("A", "K1"), ("A", "K2"), ("C", "")]
    df = make_fact([(p, s, dt.date(2024, 1, 3), 1.0) for p, s in names])
    got = sorted_positions(build_panel(df)).orderBy("series").collect()
    assert [(r["planta"], r["sku"]) for r in got] == sorted(names)
    assert [r["series"] for r in got] == list(range(len(names)))


def test_month_state(make_fact):
    sundays_left = make_fact([("A", "s", dt.date(2024, 3, 30), 1.0)])  # the 31st is a Sunday
    assert detect_month_state(sundays_left).status == "complete"
    open_month = make_fact([("A", "s", dt.date(2024, 7, 30), 1.0)])
    state, plan = resolve_strategy(open_month)
    assert (state.status, state.last_complete, state.cutoff_day, state.days_left) == ("in_progress", "2024-06", 30, 1)
    assert (plan.strategy, plan.origin, plan.target, plan.cutoff_day) == ("nowcast_media", "2024-06", "2024-08", 30)
    assert resolve_strategy(open_month, "h1")[1].target == "2024-07"
    assert resolve_strategy(open_month, "automatica", 5)[1].notes
    with pytest.raises(ValueError, match="cutoff"):
        resolve_strategy(open_month, "automatica", 31)


# ---- nowcast and scenarios -----------------------------------------------------------------------------------------------


def test_completion_by_hand(make_fact):
    rows = [("A", "s", dt.date(2024, 1, 10), 9.0)] + [("A", "s", dt.date(2024, 2, d), v) for d, v in ((1, 4.0), (2, 6.0), (4, 2.0), (20, 50.0), (29, 1.0))]
    df = make_fact(rows)  # the 4th is a Sunday
    panel = build_panel(df)
    row = nc.completed(panel, nc.alive_before(panel, 1, 1), nc.first_days(df, panel, 5, 1, 1), 5).first()
    assert (row["dias_vistos"], row["dias_restantes"], row["primeros"], row["resto"]) == (4, 21, 12.0, 51.0)
    assert row["resto_media"] == pytest.approx(10.0 / 4 * 21)
    assert row["resto_mediana"] == pytest.approx(2.0 * 21)  # 0, 0, 4, 6
    assert row["mes_completado"] == pytest.approx(12.0 + 52.5)
    assert row["dias_activos"] == pytest.approx(3 / 4 * 25)


def test_completion_reads_only_the_first_days(fact, panel):
    changed = shaken(fact, dt.date(2024, 10, 15))
    a = rows_of(nc.completed_month(fact, panel, 21, 15), ["planta", "sku"])
    b = rows_of(nc.completed_month(changed, build_panel(changed), 21, 15), ["planta", "sku"])
    assert a == b and len(a) == 12


def test_nowcast_parts_add_up(fact, panel):
    table = nc.nowcast_table(fact, panel, 24, 29, 15)
    monthly = panel.dense().where("mi between 24 and 29").agg(F.sum("y")).first()[0]
    assert table.agg(F.sum("real_mes")).first()[0] == pytest.approx(monthly)
    pooled = nc.global_scores(table).where("mes = 'todos' and modelo = 'media'").first()
    assert pooled["real_TO"] == pytest.approx(monthly)


def test_expected_rest_does_not_depend_on_partitions_and_does_not_look_ahead(spark, fact, panel):
    first = rows_of(sc.expected_rest(fact, panel, 21, 15), ["planta", "sku"])
    again = rows_of(sc.expected_rest(fact.repartition(7), panel, 21, 15), ["planta", "sku"])
    changed = shaken(fact, dt.date(2024, 10, 15))
    ahead = rows_of(sc.expected_rest(changed, build_panel(changed), 21, 15), ["planta", "sku"])
    assert len(first) == 12 and first == again == ahead
