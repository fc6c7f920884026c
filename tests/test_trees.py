"""Histogram trees: one tree against a plain version, early stop, missing values and categories, and both ways of fitting on Spark."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from caudal.operators.features import FEATURES, make_frame
from caudal.operators.panel import build_panel
from caudal.plans import boosting as bo
from caudal.plans import trees as tr
from caudal.plans.learners import BASE, Budget, Fit, member_fits

NAMES = ["a", "b", "planta_code", "c"]


def data(n=500, seed=2):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 9, n).astype(float), rng.integers(0, 6, n).astype(float), rng.gamma(2, 1, n)], axis=1)
    x[rng.random((n, 4)) < [0.2, 0.1, 0.0, 0.0]] = np.nan
    mean = np.exp(0.5 * (np.nan_to_num(x[:, 0], nan=2.0) > 0.3) + 0.6 * np.isin(x[:, 2], [1, 4]) + 0.2 * x[:, 3])
    y = np.where(rng.random(n) < 0.3, 0.0, rng.gamma(2, mean / 2))
    return x, y, rng.integers(0, 12, n), rng.integers(0, 2**63, n).astype(np.uint64)


def plain_tree(bins, g, h, rows, fit, category, total_rows):
    """The same tree by trying every split of every node on its rows."""
    p, l1, l2 = fit.params, fit.params.get("l1", 0.0), fit.params.get("l2", 0.0)
    value = np.zeros(len(g))

    def worth(i, extra=0.0):
        return max(abs(g[i].sum()) - l1, 0) ** 2 / (h[i].sum() + l2 + extra)

    def leaf(i):
        s = g[i].sum()
        return -np.sign(s) * max(abs(s) - l1, 0) / (h[i].sum() + l2) * p["rate"]

    per_hessian = total_rows / h[rows].sum()

    def best(i):
        top = (0.0, None, None)
        for k in range(len(bins)):
            b, extra, choices = bins[k, i], 0.0, []
            if k == category:
                extra = tr.CATEGORY_L2
                ratio = {v: g[i][b == v].sum() / (h[i][b == v].sum() + tr.CATEGORY_SMOOTH) for v in set(b.tolist()) if v != tr.MISSING}
                order = sorted(ratio, key=lambda v: (ratio[v], v))
                choices = [np.isin(b, order[: m + 1]) for m in range(len(order))]
            else:
                for cut in range(tr.BINS):
                    choices += [(b <= cut) & (b != tr.MISSING), (b <= cut) | (b == tr.MISSING)]
            for left in choices:
                a, c = i[left], i[~left]
                if not len(a) or not len(c) or min(h[a].sum(), h[c].sum()) < p.get("min_weight", 1e-3) or min(h[a].sum(), h[c].sum()) * per_hessian < p.get("min_rows", 0) - 1e-6:
                    continue
                gain = worth(a, extra) + worth(c, extra) - worth(i)
                if gain > top[0] + 1e-9:
                    top = (gain, a, c)
        return top

    nodes, leaves, level = [rows], 1, 0
    value[rows] = leaf(rows)
    while nodes and leaves < p.get("leaves", 10**9) and level < p.get("depth", 64):
        found = sorted(((best(i), n) for n, i in enumerate(nodes)), key=lambda f: (-f[0][0], f[1]))
        chosen = [f for f in found if f[0][0] > max(tr.LEAST_GAIN, p.get("gain", 0.0))][: p.get("leaves", 10**9) - leaves]
        nodes = []
        for (_, a, c), _ in sorted(chosen, key=lambda f: f[1]):
            for part in (a, c):
                value[part] = leaf(part)
                nodes.append(part)
        leaves, level = leaves + len(chosen), level + 1
    return value


@pytest.mark.parametrize(("kind", "params"), [
    ("xgb", {"power": 1.2, "rate": 0.1, "depth": 4, "min_weight": 3.0, "l2": 1.0, "l1": 0.3, "gain": 0.01}),
    ("lgbm", {"power": 1.5, "rate": 0.1, "leaves": 7, "min_rows": 10}),
])
def test_one_tree(kind, params):
    x, y, t, hashes = data()
    fit = Fit("g", kind, params, 11, 0, Budget(1, 1, 1))
    held = bo.Held(fit, x, y, t, hashes)
    phase = tr.Phase(fit, False)
    held.start(phase)
    held.begin(0)
    category = 2 if kind == "lgbm" else None
    steps, answer = tr.one_tree(phase, 0, 4, category, len(y)), None
    try:
        while True:
            asked = steps.send(answer)
            answer = held.level(asked.tree, asked.nodes)
    except StopIteration as done:
        tree = done.value
    g, h = tr.gradients(fit, y, held.raw)
    expected = plain_tree(held.bins, g, h, np.arange(len(y)), fit, category, len(y))
    assert len(set(np.round(expected, 12))) > 3
    assert tree.value[tree.leaves(held.bins)] == pytest.approx(expected)
    if category is not None:
        assert tree.members


def test_gradients_are_those_of_the_deviance():
    fit = Fit("g", "xgb", {"power": 1.3}, 0)
    y, raw, step = np.array([0.0, 2.0, 7.0]), np.array([-0.5, 0.4, 2.0]), 1e-5
    loss = lambda f: -y * np.exp((1 - 1.3) * f) / (1 - 1.3) + np.exp((2 - 1.3) * f) / (2 - 1.3)
    g, h = tr.gradients(fit, y, raw)
    assert g == pytest.approx((loss(raw + step) - loss(raw - step)) / (2 * step), rel=1e-5)
    assert h == pytest.approx((loss(raw + step) - 2 * loss(raw) + loss(raw - step)) / step**2, rel=1e-3)


def test_missing_values_find_their_side():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 1))
    x[:2000] = np.nan
    y = np.where(np.isnan(x[:, 0]) | (x[:, 0] > 0), 5.0, 1.0)  # missing behaves like large values
    model = bo.fit_held(Fit("g", "xgb", {**BASE["xgb"], "row_share": 1.0, "rate": 0.5}, 11, 0, Budget(40, 20, 1)), ["a"], x, y, rng.integers(0, 12, 4000), np.arange(4000, dtype=np.uint64))
    assert tr.combined([model], np.array([[np.nan], [2.0], [-2.0]])) == pytest.approx([5, 5, 1], rel=0.02)


def test_patience_and_least_trees():
    x, y, t, hashes = data(800)
    noise = np.random.default_rng(0).permutation(y)
    few = bo.fit_held(Fit("g", "xgb", BASE["xgb"], 11, 0, Budget(400, 20, 1)), NAMES, x, noise, t, hashes)
    many = bo.fit_held(Fit("g", "xgb", {**BASE["xgb"], "min_weight": 5.0}, 11, 0, Budget(400, 20, 1)), NAMES, x, y, t, hashes)
    assert 20 <= len(few.trees) < len(many.trees) < 400


@pytest.mark.parametrize(("errors", "trees"), [([10.0 - i for i in range(8)] + [5.0] * 30 + [2.5] + [4.0] * 60, 39), ([10.0 - i for i in range(8)] + [5.0] * 60, 20), ([float(90 - i) for i in range(90)], 70)])
def test_boosting_stops_fifty_trees_after_the_best(errors, trees):
    """Trees without a level, and errors as given: the number of trees of the second fit, at least 20, at most 70."""
    steps, answer, probed = tr.boosted(Fit("g", "xgb", {"power": 1.2, "depth": 0, "rate": 0.1}, 0, 0, Budget(70, 20, 1)), 3, None), None, 0
    try:
        while True:
            asked = steps.send(answer)
            if isinstance(asked, tr.Start):
                answer = (1.0, 10, 4)
            else:
                answer = errors[asked.number]
                probed += asked.phase.probe
    except StopIteration as done:
        assert len(done.value[1]) == trees
    assert probed == min(70, errors.index(min(errors[:70])) + 51)


def test_forest_blocks_are_parts_of_one_forest():
    x, y, t, hashes = data(600)
    fit = Fit("g", "rf", {**BASE["rf"], "depth": 5}, 11, 3, Budget(1, 1, 60))
    whole = bo.fit_held(fit, NAMES, x, y, t, hashes)
    blocks = [bo.fit_held(f, NAMES, x, y, t, hashes) for _, f in bo.fits_in_blocks([fit])]
    assert [len(b.trees) for b in blocks] == [25, 25, 10]
    assert tr.combined(blocks, x) == pytest.approx(tr.combined([whole], x))
    assert np.abs(tr.combined([whole], x) - y).mean() < np.abs(y - y.mean()).mean() * 0.95


def test_draws_follow_the_row():
    rows = np.arange(20_000, dtype=np.uint64)
    fit, forest = Fit("g", "xgb", {"row_share": 0.3}, 0, 4), Fit("g", "rf", {"row_share": 0.7}, 0, 4)
    taken, times = tr.weights_of(fit, rows, 5), tr.weights_of(forest, rows, 5)
    assert taken.mean() == pytest.approx(0.3, abs=0.02) and times.mean() == pytest.approx(0.7, abs=0.02) and times.max() > 2
    assert (tr.weights_of(fit, rows[::-1], 5)[::-1] == taken).all() and (tr.weights_of(fit, rows, 6) != taken).any()


@pytest.fixture(scope="module")
def ready(fact):
    return make_frame(build_panel(fact), 1).repartition(3).cache()


def test_lockstep_grows_the_same_models(ready):
    """The way for frames that no task holds gives the same trees as the one for small frames, but where two splits gain the same but for rounding."""
    budget = Budget(4, 2, 3)
    fits = member_fits("x", 24, {"rf": {"best_params": {"depth": 4}}, "xgb": {"best_params": {"min_weight": 2.0}}, "lgbm": {"best_params": {"min_rows": 5}}}, budget)
    rows = ready.where(F.col("t") == 25).withColumn("group", F.lit("x"))
    out = []
    for cells in (bo.LOCAL_CELLS, 0):
        models = bo.fit_models(ready, fits, FEATURES, cells)
        assert {pickle.loads(r["model"]).kind for r in models.collect()} == {"lgbm", "xgb", "rf"}
        out.append({(r["planta"], r["sku"]): (r["lgbm"], r["xgb"], r["rf"]) for r in bo.forecasts(models, rows, FEATURES, ["lgbm", "xgb", "rf"]).collect()})
    assert len(out[0]) == 12 and out[0].keys() == out[1].keys()
    for key, values in out[0].items():
        assert values == pytest.approx(out[1][key], rel=1e-3)


def test_scores_are_settled_in_between(ready, monkeypatch):
    monkeypatch.setattr(bo, "SETTLE", 2)
    fit = Fit("x", "xgb", {**BASE["xgb"], "min_weight": 2.0, "depth": 2}, 24, 0, Budget(5, 5, 1))
    rows = ready.where(F.col("t") == 25).withColumn("group", F.lit("x"))
    spread, held = (bo.forecasts(bo.fit_models(ready, [fit], FEATURES, cells), rows, FEATURES, ["xgb"]).orderBy("planta", "sku").collect() for cells in (0, bo.LOCAL_CELLS))
    assert [r["xgb"] for r in spread] == pytest.approx([r["xgb"] for r in held], rel=1e-3)


def test_without_rows_to_learn_from(ready):
    fits = member_fits("x", -5, None, Budget(3, 2, 2))
    rows = ready.where(F.col("t") == 25).withColumn("group", F.lit("x"))
    out = bo.forecasts(bo.fit_models(ready, fits, FEATURES), rows, FEATURES, ["lgbm", "xgb", "rf"]).collect()
    assert len(out) == 12 and all(0 <= r["lgbm"] < 1e-6 and r["rf"] == 0 for r in out)
    assert bo.forecasts(bo.fit_models(ready, fits, FEATURES), rows.withColumn("group", F.lit("other")), FEATURES, ["rf"]).count() == 0
