"""Fitting many tree models on the forecasting frame with Spark.

The frame decides how. While its training rows fit in `LOCAL_CELLS` numbers, a size that is counted first, they are shared with all tasks as the
small side of a join would be, and every model (or block of forest trees) is a task of its own: the fits of all origins, seeds, trials and kinds run
side by side on the cluster, compiled to Java where the session allows it (`caudal.plans.compiled`), else over arrays. Beyond that size no task holds the frame: it is binned and written once, and the models of a window grow in
lockstep, one job a level for all of them, in which each task adds up its rows by (model, node, feature, bin) and only
sums are shuffled and reach the driver. Both ways run the same steps (`caudal.plans.trees`) on the same draws of rows.

Models are a table (group, kind, block, model). Forecasts join it with the rows of their group, in chunks of bounded size.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from caudal.plans.compiled import fit_compiled, possible
from caudal.plans.trees import MISSING, VALIDATION_MONTHS, WIDTH, Fit, Grown, Level, Model, Phase, Start, Steps, Tree, binned, combined, edges_of, gradients, response, start_of, steps_of, weights_of
from caudal.session import cut_lineage, written

LOCAL_CELLS = 1 << 24  # numbers of a frame that is shared with the tasks: 128 MB
FOREST_BLOCK = 25  # trees of a forest in one task
PREDICT_ROWS = 50_000  # rows that are forecast in one group
KEPT = 128  # nodes of a level whose histograms are kept for the next one
SETTLE = 25  # trees after which the raw scores are written anew
SUMS_BYTES = 64 << 20  # histograms that reach the driver at once
KEYS = ["planta", "sku", "o"]
MODELS = "group string, kind string, block int, model binary"


def row_hash() -> F.Column:
    return F.xxhash64(*KEYS).alias("_hash")


def fits_in_blocks(fits: list[Fit]) -> list[tuple[int, Fit]]:
    """Forests cut into blocks of trees; every other fit is its own block."""
    out = []
    for fit in fits:
        if not fit.forest:
            out.append((0, fit))
            continue
        for k, a in enumerate(range(0, fit.budget.rf_trees, FOREST_BLOCK)):
            block = (a, min(a + FOREST_BLOCK, fit.budget.rf_trees))
            out.append((k, Fit(fit.group, fit.kind, fit.params, fit.train_to, fit.seed, fit.budget, block)))
    return out


# ---- one task holds the rows ---------------------------------------------------------------------------------------------


class Held:
    """Answers the steps of one fit from arrays: x (rows, features), y, t, hashes; rows up to `train_to` with a target."""

    def __init__(self, fit: Fit, x: np.ndarray, y: np.ndarray, t: np.ndarray, hashes: np.ndarray):
        known = ~np.isnan(y) & (t <= fit.train_to)
        self.fit, self.y, self.hashes = fit, y[known], hashes[known]
        self.edges = [edges_of(x[known, k]) for k in range(x.shape[1])]
        self.bins = binned(x[known], self.edges)
        t = t[known]
        self.late = t > (t.max() if len(t) else 0) - VALIDATION_MONTHS
        self.kept: tuple[dict[int, int], np.ndarray] | None = None

    def start(self, phase: Phase) -> tuple[float, int, int]:
        fitted = ~self.late if phase.probe else np.ones(len(self.y), dtype=bool)
        self.fitted = fitted
        mean = float(self.y[fitted].mean()) if fitted.any() else 0.0
        self.raw = np.full(len(self.y), start_of(self.fit, mean))
        return mean, int(fitted.sum()), int((~fitted).sum())

    def begin(self, number: int) -> None:
        weights = weights_of(self.fit, self.hashes, number)
        weights = self.fitted.astype(np.float64) if weights is None else weights * self.fitted
        bag = np.flatnonzero(weights > 0)
        # Out-of-bag rows of a boosted tree take part when raw scores are updated, those of a forest never.
        self.rows = self.bins[:, bag] if self.fit.forest else self.bins
        self.bag = np.arange(len(bag)) if self.fit.forest else bag
        g, h = gradients(self.fit, self.y, self.raw)
        pick = bag if self.fit.forest else slice(None)
        self.g, self.h = (g * weights)[pick], (h * weights)[pick]
        self.node = np.zeros(self.rows.shape[1], dtype=np.int64)
        self.kept, self.size = None, 1

    def add_up(self, slots: int, slot_of: np.ndarray) -> np.ndarray:
        """Histograms of `slots` nodes; slot_of: slot of every node, or -1."""
        slot = slot_of[self.node[self.bag]]
        inside = self.bag[slot >= 0]
        base = slot[slot >= 0] * WIDTH
        g, h = self.g[inside], self.h[inside]
        out = np.empty((2, len(self.rows), slots, WIDTH))
        whole = len(inside) == self.rows.shape[1]
        for k, column in enumerate(self.rows):
            at = base + (column if whole else column[inside])
            out[0, k] = np.bincount(at, weights=g, minlength=slots * WIDTH).reshape(slots, WIDTH)
            out[1, k] = np.bincount(at, weights=h, minlength=slots * WIDTH).reshape(slots, WIDTH)
        return out

    def level(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        if len(tree.feature) > self.size:
            self.node, self.size = tree.step(self.node, self.rows), len(tree.feature)
        slot_of = np.full(len(tree.feature), -1, dtype=np.int64)
        if self.kept is not None and nodes[0] > 0:  # the smaller child is added up, the other is what is left of the parent
            slots, before = self.kept
            parent = {int(tree.left[p]): slot for p, slot in slots.items()}
            count = np.bincount(self.node[self.bag], minlength=len(tree.feature))
            first = np.array(nodes[::2])
            second_is_small = (count[first] > count[first + 1]).astype(np.int64)
            slot_of[first + second_is_small] = np.arange(len(first))
            part = self.add_up(len(first), slot_of)
            rest = before[:, :, [parent[n] for n in nodes[::2]]] - part
            np.maximum(rest[1], 0, out=rest[1])
            out = np.empty((2, len(self.rows), len(nodes), WIDTH))
            out[:, :, 2 * np.arange(len(first)) + second_is_small], out[:, :, 2 * np.arange(len(first)) + 1 - second_is_small] = part, rest
        else:
            slot_of[nodes] = np.arange(len(nodes))
            out = self.add_up(len(nodes), slot_of)
        self.kept = (dict(zip(nodes, range(len(nodes)), strict=True)), out) if len(nodes) <= KEPT else None
        return out

    def grown(self, tree: Tree) -> float:
        while True:
            after = tree.step(self.node, self.rows)
            if (after == self.node).all():
                break
            self.node = after
        self.raw += tree.value[self.node]
        late = ~self.fitted
        return float(np.abs(self.y[late] - response(self.fit.kind, self.raw[late])).sum())


def fit_held(fit: Fit, features: list[str], x: np.ndarray, y: np.ndarray, t: np.ndarray, hashes: np.ndarray) -> Model:
    held, steps = Held(fit, x, y, t, hashes), steps_of(fit, features)
    answer, number = None, None
    try:
        while True:
            asked = steps.send(answer)
            if isinstance(asked, Start):
                answer, number = held.start(asked.phase), None
                continue
            if number != asked.number:
                number = asked.number
                held.begin(number)
            answer = held.level(asked.tree, asked.nodes) if isinstance(asked, Level) else held.grown(asked.tree)
    except StopIteration as done:
        start, trees = done.value
        return Model(fit.kind, features, held.edges, start, trees)


def arrays_of(ready: DataFrame, features: list[str]) -> tuple[np.ndarray, ...]:
    """The frame as arrays, in an order that doesn't depend on its partitions. Its size has been checked."""
    rows = ready.select(row_hash(), F.col("t").cast("long").alias("_t"), F.col("y").cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features]).toArrow()
    hashes = rows.column("_hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    x = np.stack([rows.column(c).to_numpy() for c in features], axis=1) if rows.num_rows else np.zeros((0, len(features)))
    return x.astype(np.float64)[order], rows.column("_y").to_numpy().astype(np.float64)[order], rows.column("_t").to_numpy()[order], hashes[order]


def fit_side_by_side(ready: DataFrame, fits: list[Fit], features: list[str]) -> DataFrame:
    """One task for each block of each fit; compiled where the session can."""
    spark = ready.sparkSession
    last = max(f.train_to for f in fits)
    arrays = arrays_of(ready.where(F.col("y").isNotNull() & (F.col("t") <= last)), features)
    work = fits_in_blocks(fits)
    work.sort(key=lambda w: (w[1].forest, -w[1].params.get("depth", 0)))  # boosting and deep trees take longest and start first
    if possible(spark, fits):
        return fit_compiled(work, features, arrays, spark, MODELS)
    shared = spark.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                block, fit = work[i]
                model = fit_held(fit, features, *shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([fit.group]), pa.array([fit.kind]), pa.array([block], pa.int32()), pa.array([pickle.dumps(model)], pa.binary())], ["group", "kind", "block", "model"])

    return written(spark.range(0, len(work), 1, len(work)).mapInArrow(run, MODELS), f"models/{uuid.uuid4().hex}")


# ---- no task holds the rows ----------------------------------------------------------------------------------------------


class Spread:
    """Answers the steps of several fits of one window from a table: _hash, _y, _late, _bins (a byte for each feature), _raw (a
    score for each fit). Scores are brought up to date in the tasks by the trees that came since the table was last written."""

    def __init__(self, ready: DataFrame, fits: list[Fit], features: list[str]):
        self.fits, self.features = fits, features
        known = ready.where(F.col("y").isNotNull() & (F.col("t") <= fits[0].train_to))
        shares = [k / (WIDTH - 1) for k in range(1, WIDTH - 1)]
        found = known.agg(F.max("t").alias("_last"), *[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in features]).first()
        self.edges = [np.unique(np.array(found[c] or [], dtype=np.float64)) for c in features]
        edges, n = self.edges, len(features)
        late = (F.col("t") > F.lit(found["_last"] or 0) - VALIDATION_MONTHS).alias("_late")

        def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([batch.column(3 + k).to_numpy(zero_copy_only=False) for k in range(n)], axis=1).astype(np.float64)
                data = np.ascontiguousarray(binned(x, edges).T)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in data], pa.binary())], ["_hash", "_y", "_late", "_bins"])

        rows = known.select(row_hash(), F.col("y").cast("double").alias("_y"), late, *[F.col(c).cast("double") for c in features])
        self.state = cut_lineage(rows.mapInArrow(bins, "_hash long, _y double, _late boolean, _bins binary").withColumn("_raw", F.array_repeat(F.lit(0.0), len(fits))))
        self.pending: list[list[Tree]] = [[] for _ in fits]
        self.probing = [False] * len(fits)

    def each(self, batch: pa.RecordBatch) -> tuple:
        n = batch.num_rows
        bins = np.frombuffer(b"".join(batch.column("_bins").to_pylist()), np.uint8).reshape(n, len(self.edges)).T
        raw = batch.column("_raw").flatten().to_numpy().reshape(n, len(self.fits))
        return batch.column("_hash").to_numpy().view(np.uint64), batch.column("_y").to_numpy(), batch.column("_late").to_numpy(zero_copy_only=False), np.ascontiguousarray(bins), raw

    def scores(self, k: int, bins: np.ndarray, raw: np.ndarray, pending: list[list[Tree]]) -> np.ndarray:
        out = raw[:, k].copy()
        for tree in pending[k]:
            out += tree.value[tree.leaves(bins)]
        return out

    def start(self, asked: dict[int, Start]) -> dict[int, tuple]:
        early, every = F.when(~F.col("_late"), F.col("_y")), F.col("_y")
        r = self.state.agg(F.sum(early).alias("a"), F.count(early).alias("b"), F.sum(every).alias("c"), F.count(every).alias("d")).first()
        out, starts = {}, []
        for k, s in asked.items():
            total, rows = (r["a"], r["b"]) if s.phase.probe else (r["c"], r["d"])
            mean = (total or 0.0) / rows if rows else 0.0
            out[k] = (mean, rows, r["d"] - rows)
            self.probing[k], self.pending[k] = s.phase.probe, []
            starts.append((k, start_of(self.fits[k], mean)))
        fresh = dict(starts)
        self.state = self.state.withColumn("_raw", F.array(*[F.lit(fresh[k]) if k in fresh else F.col("_raw")[k] for k in range(len(self.fits))]))
        return out

    def summed(self, asked: dict[int, Level]) -> dict[int, np.ndarray]:
        """One job: every task's sums, added up in two steps, so that no group has a row from every task."""
        trees, pending, probing = {k: (a.number, a.tree, a.nodes) for k, a in asked.items()}, self.pending, list(self.probing)
        shape = {k: (2, len(self.features), len(a.nodes), WIDTH) for k, a in asked.items()}

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros(s) for k, s in shape.items()}
            for batch in batches:
                hashes, y, late, bins, raw = self.each(batch)
                for k, (number, tree, nodes) in trees.items():
                    weights = weights_of(self.fits[k], hashes, number)
                    weights = np.ones(len(y)) if weights is None else weights
                    if probing[k]:
                        weights = weights * ~late
                    g, h = gradients(self.fits[k], y, self.scores(k, bins, raw, pending))
                    slot_of = np.full(len(tree.feature), -1, dtype=np.int64)
                    slot_of[nodes] = np.arange(len(nodes))
                    slot = slot_of[tree.leaves(bins)]
                    inside = np.flatnonzero((slot >= 0) & (weights > 0))
                    for c in range(len(bins)):
                        at = slot[inside] * WIDTH + bins[c, inside]
                        for part, x in ((0, g), (1, h)):
                            total[k][part, c] += np.bincount(at, weights=(x * weights)[inside], minlength=len(nodes) * WIDTH).reshape(len(nodes), WIDTH)
            for k, x in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["k", "sums"])

        def add(table: pa.Table) -> pa.Table:
            k = table.column("k")[0].as_py()
            total = np.sum([np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist()], axis=0)
            return pa.table({"k": pa.array([k], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        parts = self.state.mapInArrow(partial, "k int, sums binary").withColumn("salt", F.spark_partition_id() % 32)
        some = parts.groupBy("k", "salt").applyInArrow(add, "k int, sums binary")
        rows = some.groupBy("k").applyInArrow(add, "k int, sums binary").collect()  # SUMS_BYTES at most
        return {r["k"]: np.frombuffer(r["sums"], np.float64).reshape(shape[r["k"]]).copy() for r in rows}

    def level(self, asked: dict[int, Level]) -> dict[int, np.ndarray]:
        out, some, size = {}, {}, 0
        for k, a in asked.items():
            own = len(a.nodes) * len(self.features) * WIDTH * 16
            if some and size + own > SUMS_BYTES:
                out |= self.summed(some)
                some, size = {}, 0
            some[k] = a
            size += own
        return out | self.summed(some)

    def grown(self, asked: dict[int, Grown]) -> dict[int, float]:
        for k, a in asked.items():
            if not self.fits[k].forest:
                self.pending[k].append(a.tree)
        if max(map(len, self.pending)) >= SETTLE:
            self.settle()
        pending, wanted = self.pending, [k for k in asked if self.probing[k]]
        if not wanted:
            return dict.fromkeys(asked, 0.0)

        def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = dict.fromkeys(wanted, 0.0)
            for batch in batches:
                _, y, late, bins, raw = self.each(batch)
                late = np.flatnonzero(late)
                inside = np.ascontiguousarray(bins[:, late])
                for k in wanted:
                    total[k] += float(np.abs(y[late] - response(self.fits[k].kind, self.scores(k, inside, raw[late], pending))).sum())
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()))], ["k", "error"])

        found = {r["k"]: r["error"] for r in self.state.mapInArrow(errors, "k int, error double").groupBy("k").agg(F.sum("error").alias("error")).collect()}
        return {k: found.get(k, 0.0) for k in asked}

    def settle(self) -> None:
        pending = self.pending

        def renewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, _, _, bins, raw = self.each(batch)
                new = np.stack([self.scores(k, bins, raw, pending) for k in range(len(self.fits))], axis=1)
                edges = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(self.fits))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(edges, pa.array(new.ravel()))], batch.schema.names)

        self.state = cut_lineage(self.state.mapInArrow(renewed, self.state.schema))
        self.pending = [[] for _ in self.fits]

    def __getstate__(self) -> dict:
        """What tasks need of it."""
        return {"fits": self.fits, "features": self.features, "edges": self.edges}


def fit_in_lockstep(ready: DataFrame, fits: list[Fit], features: list[str]) -> list[Model]:
    """Models of one window (the same `train_to`), grown together."""
    spread = Spread(ready, fits, features)
    steps: dict[int, Steps] = {k: steps_of(f, features) for k, f in enumerate(fits)}
    asked, done = {}, {}

    def go(k: int, answer) -> None:
        try:
            asked[k] = steps[k].send(answer)
        except StopIteration as end:
            done[k] = end.value

    for k in steps:
        go(k, None)
    while asked:
        for kind, answer in ((Start, spread.start), (Grown, spread.grown), (Level, spread.level)):
            now = {k: asked.pop(k) for k in list(asked) if isinstance(asked[k], kind)}
            for k, a in (answer(now) if now else {}).items():
                go(k, a)
    return [Model(f.kind, features, spread.edges, *done[k]) for k, f in enumerate(fits)]


def fit_spread(ready: DataFrame, fits: list[Fit], features: list[str]) -> DataFrame:
    rows = []
    for window in sorted({f.train_to for f in fits}):
        own = [f for f in fits if f.train_to == window]
        rows += [(f.group, f.kind, 0, pickle.dumps(m)) for f, m in zip(own, fit_in_lockstep(ready, own, features), strict=True)]
    return written(ready.sparkSession.createDataFrame(rows, MODELS), f"models/{uuid.uuid4().hex}")


# ---- both ----------------------------------------------------------------------------------------------------------------


def fit_models(ready: DataFrame, fits: list[Fit], features: list[str], cells: int = LOCAL_CELLS) -> DataFrame:
    """The models of all fits, as a written table. `ready`: a settled frame with planta, sku, o, t, y and the features. Columns that
    hash a row (`KEYS`) tell rows apart."""
    last = max(f.train_to for f in fits)
    rows = ready.where(F.col("y").isNotNull() & (F.col("t") <= last)).count()
    return fit_side_by_side(ready, fits, features) if rows * len(features) <= cells else fit_spread(ready, fits, features)


def forecasts(models: DataFrame, rows: DataFrame, features: list[str], kinds: list[str]) -> DataFrame:
    """`rows`, with a column `group`, and a forecast of each kind of its group; rows of a group without models are left out."""
    chunks = max(1, -(-rows.count() // PREDICT_ROWS))
    cut = rows.withColumn("_chunk", F.pmod(F.xxhash64(*KEYS), F.lit(chunks)).cast("int"))
    copies = models.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    schema = StructType([*rows.schema.fields, *[StructField(k, DoubleType()) for k in kinds]])

    def forecast(left: pa.Table, right: pa.Table) -> pa.Table:
        keep = left.select(rows_columns)
        parts: dict[str, list[Model]] = {}
        for blob in right.column("model").to_pylist():
            model = pickle.loads(blob)
            parts.setdefault(model.kind, []).append(model)
        if not parts or not left.num_rows:
            keep = keep.slice(0, 0)
        x = np.stack([keep.column(c).cast(pa.float64()).to_numpy() for c in features], axis=1) if keep.num_rows else np.zeros((0, len(features)))
        for k in kinds:
            keep = keep.append_column(k, pa.array(combined(parts[k], x) if k in parts and len(x) else np.full(len(x), np.nan), pa.float64()))
        return keep

    rows_columns = rows.columns
    return cut.groupBy("group", "_chunk").cogroup(copies.groupBy("group", "_chunk")).applyInArrow(forecast, schema)


assert MISSING < 256
