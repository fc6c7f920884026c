import datetime as dt
import random
import statistics

import pytest

from caudal.operators import changes, checks
from caudal.operators.checks import InputError, Limits
from caudal.operators.panel import build_panel


D0 = dt.date(2024, 1, 1)


def clean_rows():
    """Every working day of half a year, 3 plantas x 2 SKUs: nothing to find."""
    rows, day, i = [], dt.date(2024, 1, 1), 0
    while day <= dt.date(2024, 6, 30):
        if day.weekday() != 6:
            for planta in "ABC":
                for k in (1, 2):
                    rows.append((planta, f"K{k}/01/100gsm/2100mm/1200", day, float(i % 5 + 1)))
                    i += 1
        day += dt.timedelta(days=1)
    return rows


def codes(df, **limits):
    return {(r["severity"], r["code"]): r["n"] for r in checks.summary(checks.violations(df, Limits(**limits))).collect()}


def test_clean_table_has_no_findings(make_fact):
    assert codes(make_fact(clean_rows()), require_complete_last_month=True) == {}


def test_each_rule_fires(make_fact):
    rows = clean_rows()
    key = ("A", "K1/01/100gsm/2100mm/1200")
    assert codes(make_fact([*rows, (*key, dt.date(2024, 6, 30), -1.0)])) == {("error", "negative"): 1}
    assert codes(make_fact([*rows, rows[0]])) == {("error", "duplicate"): 2}
    assert codes(make_fact([*rows, (None, key[1], dt.date(2024, 6, 30), 1.0)])) == {("error", "missing"): 1}
    assert codes(make_fact([*rows, ("A", "odd", dt.date(2024, 6, 30), 1.0)])) == {("warning", "sku_format"): 1}
    assert codes(make_fact([r for r in rows if not dt.date(2024, 3, 4) <= r[2] <= dt.date(2024, 3, 6)])) == {("error", "day_gap"): 1}
    assert codes(make_fact([r for r in rows if r[2].month != 3])) == {("error", "month_gap"): 1, ("error", "day_gap"): 1}
    assert codes(make_fact([r for r in rows if r[2] <= dt.date(2024, 6, 27)]), require_complete_last_month=True) == {("error", "last_month"): 2}
    assert codes(make_fact([r for r in rows if not (r[0] == "C" and r[2].month == 6)])) == {("warning", "planta_set"): 1}
    lower = make_fact([*rows, ("a ", key[1], dt.date(2024, 6, 30), 1.0)])
    assert codes(lower) == {("error", "keys"): 1, ("error", "near_duplicate_keys"): 2, ("warning", "planta_set"): 1}


def test_a_sunday_inside_a_gap_does_not_break_it(make_fact):
    rows = [r for r in clean_rows() if r[2] not in (dt.date(2024, 3, 1), dt.date(2024, 3, 2), dt.date(2024, 3, 4))]
    rows.append(("A", "K1/01/100gsm/2100mm/1200", dt.date(2024, 3, 3), 1.0))  # a Sunday
    found = checks.day_gap(make_fact(rows)).collect()
    assert [(r["desde"], r["hasta"], r["dias_habiles"]) for r in found] == [(dt.date(2024, 3, 1), dt.date(2024, 3, 4), 3)]


def test_equal_to_the_limit_does_not_fire(make_fact):
    rows = clean_rows()
    extra = ("A", "K1/01/100gsm/2100mm/1200", dt.date(2024, 6, 30))  # a Sunday, free
    assert codes(make_fact([*rows, (*extra, 100.0)]), spike_factor=1e9) == {}
    assert codes(make_fact([*rows, (*extra, 100.1)]), spike_factor=1e9) == {("warning", "daily_peak"): 1}
    assert codes(make_fact([*rows, (*extra, 60.0)])) == {}  # 20 times the median of 3
    assert codes(make_fact([*rows, (*extra, 60.1)])) == {("warning", "spike"): 1}


def test_forty_percent_fewer_rows_does_not_fire(make_fact):
    rows = clean_rows()
    june, may = ([r for r in rows if r[2].month == m] for m in (6, 5))
    keep = [r for r in rows if r[2].month < 5] + may[:160]
    assert checks.rows_drop(make_fact(keep + june[:96])).count() == 0
    assert [r["filas"] for r in checks.rows_drop(make_fact(keep + june[:95])).collect()] == [95]


def test_validate_stops_on_errors_only(make_fact, spark):
    rows = clean_rows()
    assert checks.validate(make_fact(rows)).count() == 0
    with pytest.raises(InputError, match="negative: 1 rows"):
        checks.validate(make_fact([*rows, ("A", "K1/01/100gsm/2100mm/1200", dt.date(2024, 6, 30), -1.0)]))
    with pytest.raises(InputError, match="columns"):
        checks.validate(make_fact(rows).drop("sku"))
    with pytest.raises(InputError, match="types"):
        checks.validate(make_fact(rows).selectExpr("planta", "sku", "cast(fecha as string) as fecha", "consumo"))
    with pytest.raises(InputError, match="2 working days"):
        checks.check_last_month_complete(make_fact([r for r in rows if r[2] <= dt.date(2024, 6, 27)]))


def test_change_table_by_hand(make_fact):
    jan, feb = dt.date(2024, 1, 5), dt.date(2024, 2, 5)
    df = make_fact([("A", "s1", jan, 10.0), ("A", "s1", feb, 15.0), ("A", "s3", jan, 4.0), ("A", "s2", feb, 5.0), ("B", "s4", jan, 8.0), ("B", "s4", feb, 8.0)])
    panel = build_panel(df)
    rows = {r["sku"]: (r["cambio_pct"], r["estado"]) for r in changes.change_by_sku(panel).collect()}
    assert rows == {"s1": (50.0, "cambia"), "s2": (None, "nuevo"), "s3": (-100.0, "sin consumo"), "s4": (0.0, "cambia")}
    a = changes.change_by_planta(panel).where("planta = 'A'").first()
    assert (a["consumo_mes_anterior"], a["consumo_mes"], a["skus_con_consumo"]) == (14.0, 20.0, 2)


def test_description_by_hand(make_fact):
    df = make_fact([("A", "s1", dt.date(2024, 1, d), v) for d, v in ((1, 2.0), (3, 0.0), (5, 4.0))])
    row = changes.describe_series(df).first()
    assert (row["n_obs"], row["span_days"], row["mean"], row["std"], row["pct_zero"], row["coverage_pct"], row["cv"]) == (3, 5, 2.0, 2.0, 33.3, 60.0, 1.0)


def test_medians_are_exact(spark):
    rng = random.Random(5)
    rows = [("A", f"s{k}", D0, float(rng.choice([rng.randrange(1, 4), rng.randrange(1, 10**6)]))) for k in range(12) for _ in range(k * k * 40 + 1)]
    rows += [("B", "hot", D0, round(rng.random() * 1000, 3) + 0.001) for _ in range(30001)] + [("B", "flat", D0, 2.0)] * 5000 + [("B", "none", D0, 0.0)]
    df = spark.createDataFrame(rows, "planta string, sku string, fecha date, consumo double")
    got = {(r["planta"], r["sku"]): r["mediana"] for r in checks.positive_medians(df).collect()}
    values = {}
    for p, s, _, v in rows:
        if v > 0:
            values.setdefault((p, s), []).append(v)
    assert got == {k: statistics.median(v) for k, v in values.items()}
