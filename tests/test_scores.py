import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from caudal.functions import skus
from caudal.functions.numbers import row_mean, row_median, row_trimmed_mean
from caudal.functions.scores import error_sums, ranked, score_columns
from caudal.operators import confidence, ensembles, explore, levels
from caudal.operators.features import make_frame
from caudal.operators.panel import build_panel

MEMBERS = ["naive", "mean3", "mean6"]


@pytest.fixture(scope="module")
def panel(fact):
    return build_panel(fact)


@pytest.fixture(scope="module")
def res(panel):
    return make_frame(panel, 1).where("t >= 18").select("planta", "sku", "o", "t", "y", *[f"p_{m}" for m in MEMBERS]).cache()


def test_score_by_hand(spark):
    df = spark.createDataFrame([(10.0, 8.0), (10.0, 14.0)], "y double, p double")
    row = df.agg(*error_sums(F.col("y"), F.col("p"))).select(*score_columns()).first()
    assert (row["n"], row["mae"], row["wape"], row["accuracy"], row["bias_pct"]) == (2, 3.0, 0.3, 0.7, -10.0)
    none = spark.createDataFrame([(0.0, 8.0)], "y double, p double").agg(*error_sums(F.col("y"), F.col("p"))).select(*score_columns()).first()
    assert none["wape"] is None and none["bias_pct"] is None


def test_ties_share_the_best_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 5.0)], "modelo string, wape double")
    assert {r["modelo"]: r["rank"] for r in ranked(df, []).collect()} == {"a": 1, "b": 1, "c": 3}


def test_combinations_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0, 9.0), (4.0, 4.0, 4.0)], "a double, b double, c double")
    columns = [F.col(c) for c in "abc"]
    got = df.select(row_mean(columns).alias("m"), row_median(columns).alias("d"), row_trimmed_mean(columns).alias("t")).collect()
    assert [(r["m"], r["d"], r["t"]) for r in got] == [(4.0, 2.0, 4.0), (4.0, 4.0, 4.0)]  # three members: nothing is trimmed
    five = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 100.0)], "a double, b double, c double, d double, e double")
    assert five.select(row_trimmed_mean([F.col(c) for c in "abcde"])).first()[0] == 3.0


def test_weights_use_only_known_months(res):
    before = {r["t"]: r.asDict() for r in ensembles.past_weights(res, MEMBERS, 2).collect()}
    changed = res.withColumn("y", F.when(F.col("t") > 24, F.col("y") * 9).otherwise(F.col("y")))
    after = {r["t"]: r.asDict() for r in ensembles.past_weights(changed, MEMBERS, 2).collect()}
    assert all(before[t] == after[t] for t in before if t <= 26) and before[28] != after[28]
    assert all(before[t][f"w_{m}"] == pytest.approx(1 / 3) for t in (18, 19) for m in MEMBERS)
    assert all(sum(row[f"w_{m}"] for m in MEMBERS) == pytest.approx(1) for row in before.values())


def test_reconciled_series_add_up_to_the_control(panel, res):
    out = levels.reconcile(res, panel, 1, "p_mean3", "p_rec")
    from caudal.operators.features import direct_forecasts

    control = direct_forecasts(panel, 1).select("planta", "t", "mean6_x_seasonal")
    sums = out.groupBy("planta", "t").agg(F.sum("p_rec").alias("s")).join(control, ["planta", "t"]).collect()
    assert len(sums) == 48 and all(r["s"] == pytest.approx(r["mean6_x_seasonal"]) for r in sums)


def test_zero_sums_are_left_alone(panel, res):
    zero = res.withColumn("p_mean3", F.lit(0.0))
    assert levels.reconcile(zero, panel, 1, "p_mean3", "p_rec").agg(F.max("p_rec")).first()[0] == 0.0


def test_level_scores_pool_the_same_volume(panel, res):
    scores = levels.score_models_by_level(panel, res, MEMBERS, 18, 29)
    assert {r["nivel"]: r["n"] for r in scores.where("modelo = 'naive'").collect()} == {"sku": 144, "planta": 48, "total": 12}


def test_confidence_set_against_brute_force(spark):
    """The same draws in numpy: elimination order and p-values."""
    rng = np.random.default_rng(1)
    base = rng.gamma(5, 2, 12)
    models = ["a", "b", "c", "d"]
    loss = {m: base + shift + rng.normal(0, 1, 12) for m, shift in zip(models, (0, 0.2, 1.5, 4))}
    table = spark.createDataFrame([(t, m, float(loss[m][t] * 10), 10) for t in range(12) for m in models], "t int, modelo string, loss double, n bigint")
    got = confidence.model_confidence_set(table, models, n_boot=400).orderBy("elimination_step").collect()
    period = table.select(F.col("t").alias("pos"), "modelo", "loss", "n")
    boot = confidence.bootstrap_means(period, 12, 3, 400, 0, models).orderBy("draw").toPandas()[models].to_numpy()
    mean = np.array([loss[m].mean() for m in models])
    alive, order, p_values, running = list(range(4)), [], [], 0.0
    while len(alive) > 1:
        stat, null, worst = 0.0, np.zeros(len(boot)), {}
        for i, j in itertools.permutations(alive, 2):
            gap = boot[:, i] - boot[:, j]
            t = (mean[i] - mean[j]) / gap.std()
            stat, worst[i] = max(stat, abs(t)), max(worst.get(i, 0.0), t)
            null = np.maximum(null, np.abs(gap - (mean[i] - mean[j])) / gap.std())
        running = max(running, float((null >= stat - 1e-12).mean()))
        out = max(alive, key=lambda i: worst[i])
        order.append(models[out])
        p_values.append(running)
        alive.remove(out)
    assert [r["model"] for r in got] == [*order, models[alive[0]]]
    assert [r["mcs_p_value"] for r in got] == pytest.approx([*p_values, 1.0])
    assert [r["mcs_p_value"] for r in got] == sorted(r["mcs_p_value"] for r in got)


def test_keys(spark):
    rows = [("K/01/1/110gsm/2100mm",), ("k/01/110GSM/2100mm/1200-1400/Subst.",), ("SF1/200GSM/2100MM",)]
    df = spark.createDataFrame(rows, "sku string")
    got = df.select(skus.planner_key(F.col("sku")).alias("p"), skus.dataset_key(F.col("sku")).alias("d"), skus.sku_part(F.col("sku"), "gsm").alias("g"), skus.sku_part(F.col("sku"), "sufijo").alias("x")).collect()
    assert got[0]["p"] == got[1]["d"] == "k/01/110gsm/2100mm"
    assert (got[1]["g"], got[1]["x"], got[2]["g"]) == (110, "Subst.", None)
    months = df.limit(1).select(*[skus.header_month(F.lit(h)) for h in ("SEPT´26 allocation", "JUN´26 allocation", "total")], skus.column_month(F.lit("06.2026")), skus.column_month(F.lit("13.2026"))).first()
    assert tuple(months) == ("2026-09", "2026-06", None, "2026-06", None)
    name = df.limit(1).select(skus.build_sku(F.lit(" K "), F.lit(1), F.lit(110), F.lit(2100)), skus.build_sku(F.lit("K"), F.lit(101), F.lit(110), F.lit(2100))).first()
    assert tuple(name) == ("K/01/110gsm/2100mm", "K/101/110gsm/2100mm")


def test_name_search(spark):
    names = spark.createDataFrame([("México",), ("Medellín",), ("Santa Fé Norte",), ("Fenix",)], "nombre string")
    best = lambda text: [r["nombre"] for r in explore.suggest(names, text).collect()]
    assert best("MEXICO") == ["México"]
    assert best("me") == ["México", "Medellín"]
    assert best("fe san") == ["Santa Fé Norte"]
    assert best("mexcio") == ["México"]
    assert best("zzzz") == []
    assert explore.exact_name(names, "santa-fe norte") == "Santa Fé Norte"
    with pytest.raises(explore.NotFound, match="México"):
        explore.exact_name(names, "mexcio")
