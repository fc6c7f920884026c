"""Compiled fits against those over arrays: the same trees, whatever the parameters; and the draws of columns against NumPy."""

import numpy as np
import pytest

import caudal.plans.boosting as bo
from caudal.plans import compiled as co
from caudal.plans import trees as tr
from caudal.plans.learners import BASE, Budget, Fit
from tests.test_trees import NAMES, data

FEW = Budget(60, 20, 6)
CASES = [
    ("lgbm", {}),
    ("lgbm", {"leaves": 90, "min_rows": 2, "power": 1.7, "rate": 0.15, "l1": 0.3, "l2": 0.5, "column_share": 0.5, "row_share": 0.6}),
    ("lgbm", {"leaves": 400, "min_rows": 0, "row_share": 1.0}),
    ("xgb", {"min_weight": 2.0}),
    ("xgb", {"depth": 10, "min_weight": 0.0, "gain": 0.01, "l1": 0.1, "column_share": 0.4, "rate": 0.2}),
    ("rf", {}),
    ("rf", {"criterion": "poisson", "min_rows": 3, "column_share": 0.5, "row_share": 0.6}),
    ("rf", {"criterion": "poisson", "depth": 3, "row_share": 0.3}),
]


def bits(model):
    return [np.concatenate([t.feature, t.left, np.where(t.feature >= 0, t.threshold, 0), np.where(t.feature >= 0, t.missing_left, 0)]) for t in model.trees]


def fitted(spark, fits, arrays, names=NAMES):
    rows = co.fit_compiled(list(enumerate(fits)), names, arrays, spark, bo.MODELS).collect()
    return [bo.pickle.loads(r["model"]) for r in sorted(rows, key=lambda r: r["block"])]


@pytest.mark.parametrize("train_to", [11, 8])
def test_the_same_trees_as_over_arrays(spark, train_to):
    x, y, t, hashes = data(2500)
    x[:, 3] = np.round(x[:, 3], 1)  # equal values
    y[7] = np.nan
    fits = [Fit(f"g{k}", kind, {**BASE[kind], **more}, train_to, seed, FEW, (2, 5) if kind == "rf" else None) for k, (kind, more) in enumerate(CASES) for seed in (0, 3)]
    for fit, model in zip(fits, fitted(spark, fits, (x, y, t, hashes)), strict=True):
        expected = bo.fit_held(fit, NAMES, x, y, t, hashes)
        assert (model.kind, model.features, len(model.trees)) == (expected.kind, expected.features, len(expected.trees))
        assert all(np.array_equal(a, b) for a, b in zip(model.edges, expected.edges, strict=True))
        # Missing against all others is the same split with either side first, and rounding decides between the two.
        assert np.mean([np.array_equal(a, b) for a, b in zip(bits(model), bits(expected), strict=True)]) > 0.9, fit
        assert tr.combined([model], x) == pytest.approx(tr.combined([expected], x), rel=1e-6)
        assert any(t.members for t in model.trees) == (fit.kind == "lgbm")


def test_no_rows_and_one_row(spark):
    x, y, t, hashes = data(60)
    fits = [Fit("none", k, BASE[k], -1, 0, FEW, (0, 3) if k == "rf" else None) for k in BASE] + [Fit("one", k, BASE[k], 0, 0, FEW, (0, 3) if k == "rf" else None) for k in BASE]
    t[:] = 1 + t
    t[5] = 0
    for fit, model in zip(fits, fitted(spark, fits, (x, y, t, hashes)), strict=True):
        expected = bo.fit_held(fit, NAMES, x, y, t, hashes)
        assert len(model.trees) == len(expected.trees)
        assert tr.combined([model], x) == pytest.approx(tr.combined([expected], x))


def test_columns_are_drawn_as_numpy_draws_them(spark):
    """Many features and a small share: trees that have only the drawn ones, seed by seed."""
    rng = np.random.default_rng(4)
    x, names = rng.normal(size=(400, 37)), [f"f{k}" for k in range(37)]
    y, t, hashes = np.exp(x[:, :20].sum(axis=1) / 6), rng.integers(0, 9, 400), rng.integers(0, 2**63, 400).astype(np.uint64)
    fits = [Fit(f"{kind}{seed}", kind, {**BASE[kind], "column_share": 0.1, **({"min_weight": 1.0} if kind == "xgb" else {})}, 8, seed, Budget(20, 20, 10), (0, 10) if kind == "rf" else None)
            for kind in ("xgb", "rf") for seed in (0, 1, 2**31 - 1)]
    for fit, model in zip(fits, fitted(spark, fits, (x, y, t, hashes), names), strict=True):
        expected = bo.fit_held(fit, names, x, y, t, hashes)
        assert all(np.array_equal(a.feature, b.feature) for a, b in zip(model.trees, expected.trees, strict=True))


def test_a_frame_that_tasks_hold_is_fitted_compiled(spark, monkeypatch):
    from caudal.operators.features import FEATURES

    seen = []
    monkeypatch.setattr(bo, "fit_compiled", lambda work, *rest: seen.append(work))
    monkeypatch.setattr(bo, "arrays_of", lambda ready, features: None)
    rows = spark.createDataFrame([(1, 1.0)], "t int, y double")
    fits = [Fit("a", "rf", BASE["rf"], 3), Fit("a", "xgb", BASE["xgb"], 3)]
    bo.fit_models(rows, fits, FEATURES)
    assert [f.kind for _, f in seen[0]] == ["xgb", *["rf"] * 8]
    assert not co.possible(spark, [Fit("a", "rf", BASE["rf"], 3, 2**31)]) and not co.possible(object(), fits)
