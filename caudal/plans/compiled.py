"""The fits of `caudal.plans.boosting` that hold their rows in one task, compiled to Java by the compiler that Spark itself generates code with.

`TreeFit.java` takes the steps of `caudal.plans.trees` on the same draws and adds up the same numbers in the same order as `boosting.Held`; the tests hold
them against each other. Its classes reach the executors as a jar of the session, and each fit is a call of a function of Spark SQL, so a
task needs no Python until its model is put into the table of models.
"""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.plans.trees import WIDTH, Fit, Model, Tree
from caudal.session import written

SOURCE = Path(__file__).with_name("TreeFit.java")
CLASS = "caudal.TreeFit"
SPECS = 24  # numbers that describe a fit
MOST = 1 << 30
_OBJECTS: dict[str, object] = {}


def possible(spark: SparkSession, fits: list[Fit]) -> bool:
    """A session that talks to its driver's JVM, and seeds that are one word of the generator of column draws."""
    return hasattr(spark, "_jsparkSession") and all(0 <= f.seed < 1 << 31 for f in fits)


def compiler_of(spark: SparkSession):
    """A `TreeFit` without rows; its classes are known to the driver and, as a jar, to all executors."""
    context = spark.sparkContext
    app, gateway = context.applicationId, context._gateway
    if app not in _OBJECTS:
        jvm = gateway.jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE.read_text())
        folder = tempfile.mkdtemp(prefix="caudal-classes-")
        atexit.register(shutil.rmtree, folder, True)
        codes, path = compiler.getBytecodes(), f"{folder}/{uuid.uuid4().hex}.jar"
        with zipfile.ZipFile(path, "w") as jar:
            for name in codes:
                jar.writestr(f"{name.replace('.', '/')}.class", bytes(codes[name]))
        context._jsc.addJar(path)
        none = gateway.new_array(jvm.java.lang.Class, 0)
        _OBJECTS[app] = compiler.getClassLoader().loadClass(CLASS).getDeclaredConstructor(none).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
    return _OBJECTS[app]


def spec_of(fit: Fit, features: list[str]) -> list[float]:
    p, many = fit.params, len(features)
    first, end = fit.block or (0, fit.budget.rf_trees)
    category = features.index("planta_code") if fit.kind == "lgbm" and "planta_code" in features else -1
    share = p.get("row_share", 1.0)
    out = [
        fit.train_to, fit.seed, first, end, fit.budget.max_trees, fit.budget.min_trees, fit.forest, category,
        0.0 if fit.forest else p["power"], 1.0 if fit.forest else p["rate"], min(p.get("leaves", MOST), MOST), p.get("depth", 64), p.get("min_rows", 0),
        p.get("min_weight", 0.0 if fit.forest else 1e-3), p.get("gain", 0.0), share, min(many, max(1, round(p.get("column_share", 1.0) * many))),
        p.get("l1", 0.0), p.get("l2", 0.0), p.get("criterion") == "poisson", float(np.exp(-share)),
    ]
    return [float(v) for v in out] + [0.0] * (SPECS - len(out))


def model_of(fit: Fit, features: list[str], blob: bytes) -> Model:
    """What `TreeFit.bytes` wrote."""
    at = 0

    def take(kind: str, many: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, many, at)
        at += out.nbytes
        return out

    edges = [take("<f8", int(take("<i4", 1)[0])) for _ in features]
    start, trees = float(take("<f8", 1)[0]), []
    for _ in range(int(take("<i4", 1)[0])):
        size, sets = (int(v) for v in take("<i4", 2))
        value, feature, threshold, left, missing = take("<f8", size), take("<i4", size), take("<i4", size), take("<i4", size), take("?", size)
        members = {int(take("<i4", 1)[0]): take("?", WIDTH) for _ in range(sets)}
        trees.append(Tree(feature, threshold, missing, left, value, members))
    return Model(fit.kind, features, edges, start, trees)


def fit_compiled(work: list[tuple[int, Fit]], features: list[str], arrays: tuple[np.ndarray, ...], spark: SparkSession, schema: str) -> DataFrame:
    """One task for each (block, fit); `arrays` as `boosting.arrays_of` gives them, shared with all tasks."""
    x, y, t, hashes = arrays
    data = b"".join(np.ascontiguousarray(part).tobytes() for part in (np.array(x.shape, np.int64), hashes.astype(np.uint64), t.astype(np.int64), y, x.T))
    specs = uuid.uuid4().bytes[:8] + np.array([spec_of(fit, features) for _, fit in work]).tobytes()
    given = spark.createDataFrame(pa.table({"specs": pa.array([specs], pa.binary()), "data": pa.array([data], pa.binary())}))
    one, name = compiler_of(spark).of(spark.sparkContext._jsc, given._jdf), f"caudal_tree_fit_{uuid.uuid4().hex}"
    spark._jsparkSession.udf().register(name, one, spark._jsparkSession.parseDataType('"binary"'))

    def models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block, fit = work[i]
                model = pickle.dumps(model_of(fit, features, blob))
                yield pa.RecordBatch.from_arrays([pa.array([fit.group]), pa.array([fit.kind]), pa.array([block], pa.int32()), pa.array([model], pa.binary())], ["group", "kind", "block", "model"])

    try:
        fitted = spark.range(0, len(work), 1, len(work)).select("id", F.call_udf(name, "id").alias("fitted"))
        return written(fitted.mapInArrow(models, schema), f"models/{uuid.uuid4().hex}")
    finally:
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
