"""Parquet tables results are kept in: partition overwrite for blocks, numbered versions for whole tables.

Everything lives under one shared folder. A version is written beside the current one and becomes current when Spark
has committed it, so a failed write or a lost executor never leaves a half table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caudal.functions.dates import shift_label
from caudal.functions.skus import SKU_PARTS, dataset_key, sku_part
from caudal.operators.loading import fingerprint
from caudal.operators.tracking import TRACKING_COLUMNS, replace_tracking, with_defaults
from caudal.session import cut_lineage

KEEP_VERSIONS = 10
PREDICTION_KEY = ["planta", "sku", "mes_objetivo", "mes_origen", "estrategia", "modelo"]
BLOCK = ["estrategia", "mes_origen"]
# Read with a fixed schema, so that a month label in a folder name is never guessed to be a date.
PREDICTIONS = (
    "planta string, sku string, mes_objetivo string, modelo string, valor double, creado_en string, run_id string, estrategia string, mes_origen string"
)
TRACKING = (
    "run_id string, nivel string, planta string, modelo string, acierto double, wape double, bias_pct double, n bigint, real_TO double, "
    "pronostico_TO double, alerta string, creado_en string, estrategia string, corte int, mes string"
)
ID_BUCKETS = 256


class StoreError(ValueError):
    """A write was refused; the stored tables are unchanged."""


# ---- numbered versions of a table ----------------------------------------------------------------------------------------


class Versions:
    """The numbered versions of one table: publish, undo, keep the newest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Committed versions, oldest first."""
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        found = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
        return [n for n in found if self._fs.exists(self._path(f"{self.path}/v={n}/_SUCCESS"))]

    def read(self) -> DataFrame | None:
        numbers = self.numbers()
        return self.spark.read.parquet(f"{self.path}/v={numbers[-1]}") if numbers else None

    def publish(self, df: DataFrame) -> int:
        """The next version. A number is written once: of two loads at the same time the later one fails and changes nothing."""
        number = (self.numbers() or [0])[-1] + 1
        df.write.mode("errorifexists").parquet(f"{self.path}/v={number}")
        for old in self.numbers()[: -KEEP_VERSIONS - 1]:
            self._fs.delete(self._path(f"{self.path}/v={old}"), True)
        return number

    def undo(self) -> int:
        """Back to the version before; the newest is removed."""
        numbers = self.numbers()
        if len(numbers) < 2:
            raise StoreError("there is no earlier load to go back to")
        self._fs.delete(self._path(f"{self.path}/v={numbers[-1]}"), True)
        return numbers[-2]


def mark_of(df: DataFrame | None) -> tuple | None:
    """The fingerprint of a table as a value to compare; one row read by the driver."""
    return None if df is None else tuple(fingerprint(df).first())


def publish_reviewed(master: Versions, reviewed: DataFrame, mark: tuple | None) -> int:
    """Make a reviewed table the master, unless the master changed after the review."""
    if mark_of(master.read()) != mark:
        raise StoreError("the data changed after the review: review the load again")
    return master.publish(reviewed)


# ---- star schema ---------------------------------------------------------------------------------------------------------


def assign_ids(existing: DataFrame | None, names: DataFrame, name: str, id_name: str) -> DataFrame:
    """(id, name) with the old ids kept and new names numbered after them.

    New names are numbered inside hash buckets and shifted by the sizes of the earlier buckets, so no task sees them all."""
    new = names.select(name).distinct()
    start = F.lit(0)
    if existing is not None:
        new = new.join(existing.select(name), name, "left_anti")
        start = F.lit(existing.agg(F.coalesce(F.max(id_name), F.lit(0)).alias("m")).first()["m"])
    placed = new.withColumn("_b", F.pmod(F.xxhash64(name), F.lit(ID_BUCKETS)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over the buckets
    shifts = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    order = F.row_number().over(Window.partitionBy("_b").orderBy(name))
    numbered = placed.join(F.broadcast(shifts), "_b").select((start + F.col("_s") + order).cast("bigint").alias(id_name), name)
    return numbered if existing is None else existing.select(id_name, name).unionByName(numbered)


def describe_skus(skus: DataFrame) -> DataFrame:
    """The parts of every description next to its id, and the planner key."""
    sku = F.col("descripcion")
    return skus.select("*", *[sku_part(sku, part).alias(part) for part in SKU_PARTS], dataset_key(sku).alias("clave_planificador"))


def star_tables(df: DataFrame, plantas: DataFrame | None = None, skus: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plantas, skus, consumos) of a fact; dims of an earlier load keep their ids."""
    p = assign_ids(plantas, df.select(F.col("planta").alias("codigo")), "codigo", "planta_id")
    s = describe_skus(assign_ids(None if skus is None else skus.select("sku_id", "descripcion"), df.select(F.col("sku").alias("descripcion")), "descripcion", "sku_id"))
    names = s.select("sku_id", F.col("descripcion").alias("sku"))
    fact = df.join(p.withColumnRenamed("codigo", "planta"), "planta").join(names, "sku").select("planta_id", "sku_id", "fecha", "consumo")
    return p, s, fact


def read_star(plantas: DataFrame, skus: DataFrame, consumos: DataFrame) -> DataFrame:
    """The fact with its names."""
    joined = consumos.join(plantas, "planta_id").join(skus.select("sku_id", "descripcion"), "sku_id")
    return joined.select(F.col("codigo").alias("planta"), F.col("descripcion").alias("sku"), "fecha", "consumo")


def roundtrip_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Planta by month sums that are not the same on both sides: must be empty."""
    sums = lambda df: df.groupBy("planta", F.date_format("fecha", "yyyy-MM").alias("mes")).agg(F.round(F.sum("consumo"), 6).alias("consumo"))
    left, right = sums(a), sums(b)
    return left.exceptAll(right).withColumn("lado", F.lit("a")).unionByName(right.exceptAll(left).withColumn("lado", F.lit("b")))


# ---- predictions ---------------------------------------------------------------------------------------------------------


def predictions_from_cache(cache: DataFrame, label, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Long predictions from a wide cache (planta, sku, o, t, one column per forecast); `columns` maps a column to its
    (estrategia, modelo) and `label` turns a month index into its label."""
    names = list(columns)
    wide = cache.select("planta", "sku", label(F.col("t")).alias("mes_objetivo"), label(F.col("o")).alias("mes_origen"), *[F.col(c).cast("double").alias(c) for c in names])
    long = wide.unpivot(["planta", "sku", "mes_objetivo", "mes_origen"], names, "_c", "valor").where(F.col("valor").isNotNull())
    pick = lambda i: F.coalesce(*[F.when(F.col("_c") == c, F.lit(v[i])) for c, v in columns.items()])
    return long.select("planta", "sku", "mes_objetivo", "mes_origen", pick(0).alias("estrategia"), pick(1).alias("modelo"), "valor")


def predictions_from_forecast(forecast: DataFrame, strategy: str = "h1") -> DataFrame:
    """A forecast table (planta, sku, mes and a column for each model) in long form, made one month before its target."""
    identity = {"planta", "sku", "mes"}
    models = sorted(set(forecast.columns) - identity, key=forecast.columns.index)
    wide = forecast.select("planta", "sku", F.col("mes").alias("mes_objetivo"), shift_label(F.col("mes"), -1).alias("mes_origen"), *[F.col(m).cast("double").alias(m) for m in models])
    long = wide.unpivot(["planta", "sku", "mes_objetivo", "mes_origen"], models, "modelo", "valor")
    return long.select("planta", "sku", "mes_objetivo", "mes_origen", F.lit(strategy).alias("estrategia"), "modelo", "valor")


def unknown_dims(preds: DataFrame, plantas: DataFrame, skus: DataFrame) -> DataFrame:
    """(tipo, nombre) of plantas and SKUs the store does not know."""
    p = preds.select(F.col("planta").alias("codigo")).distinct().join(plantas, "codigo", "left_anti")
    s = preds.select(F.col("sku").alias("descripcion")).distinct().join(skus.select("descripcion"), "descripcion", "left_anti")
    return p.select(F.lit("planta").alias("tipo"), F.col("codigo").alias("nombre")).unionByName(s.select(F.lit("sku").alias("tipo"), F.col("descripcion").alias("nombre")))


def prediction_problems(preds: DataFrame) -> DataFrame:
    """(problema, n): repeated keys, values that are not finite."""
    odd = F.col("valor").isNull() | F.isnan("valor") | (F.abs("valor") == float("inf"))
    keys = preds.groupBy(*PREDICTION_KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("odd"))
    counts = keys.agg(F.count_if(F.col("n") > 1).alias("claves repetidas"), F.sum("odd").alias("valores no finitos"))
    return counts.unpivot([], ["claves repetidas", "valores no finitos"], "problema", "n").where(F.col("n") > 0)


def replace_predictions(preds: DataFrame, path: str, plantas: DataFrame, skus: DataFrame, created_at: Column | None = None, run_id: str | None = None) -> None:
    """The blocks that `preds` holds take the place of the stored ones; all other blocks are left alone. Rows are settled and
    looked at first, so a table with bad rows changes nothing."""
    if lacking := [c for c in (*PREDICTION_KEY, "valor") if c not in preds.columns]:
        raise StoreError(f"no column {', '.join(lacking)} in the predictions")
    preds = cut_lineage(preds.select(*PREDICTION_KEY, "valor"))
    problems = prediction_problems(preds).collect()  # at most two rows
    if problems:
        raise StoreError("; ".join(f"{row['problema']}: {row['n']}" for row in problems))
    unknown = unknown_dims(preds, plantas, skus).limit(5).collect()
    if unknown:
        raise StoreError(f"unknown names, not in the star schema: {', '.join(row['nombre'] for row in unknown)}")
    stamp = created_at if created_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    rows = preds.select(*PREDICTION_KEY, "valor", stamp.alias("creado_en"), F.lit(run_id).cast("string").alias("run_id"))
    rows.hint("rebalance", *BLOCK).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BLOCK).parquet(path)


def read_predictions(spark: SparkSession, path: str, strategy: str | None = None, model: str | None = None) -> DataFrame:
    """The stored predictions; a strategy prunes partitions and a model is pushed to the scan."""
    table = spark.read.schema(PREDICTIONS).parquet(path)
    if strategy is not None:
        table = table.where(F.col("estrategia") == strategy)
    return table if model is None else table.where(F.col("modelo") == model)


def catalogue(preds: DataFrame) -> DataFrame:
    """(mes, estrategia, total_TO, series) of the saved forecasts, newest first and h1 first inside a month."""
    sums = preds.where(F.col("modelo") == "ml_mean").groupBy(F.col("mes_objetivo").alias("mes"), "estrategia").agg(
        F.sum("valor").alias("total_TO"), F.count(F.lit(1)).alias("series"), F.max("creado_en").alias("creado_en")
    )
    return sums.orderBy(F.desc("mes"), F.desc(F.col("estrategia") == "h1"), F.desc("estrategia"))


def all_batches(batches: list[DataFrame]) -> DataFrame:
    """Several prediction batches (caches and forecasts) as one load."""
    columns = [*PREDICTION_KEY, "valor"]
    union = batches[0].select(*columns)
    for batch in batches[1:]:
        union = union.unionByName(batch.select(*columns))
    return union


# ---- runs and tracking ---------------------------------------------------------------------------------------------------


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the rows of the keys of `new` replaced."""
    if old is None:
        return new
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def save_tracking(rows: DataFrame, path: str) -> None:
    """Replace the (run_id, mes) rows of `rows` in the stored history; only the months they touch are rewritten."""
    spark = rows.sparkSession
    new = cut_lineage(with_defaults(rows))
    months = [row["mes"] for row in new.select("mes").distinct().collect()]  # a handful of labels
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    merged = new
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        old = spark.read.schema(TRACKING).parquet(path)
        merged = replace_tracking(old.where(F.col("mes").isin(months)), new)
    # The old months are read and overwritten by the same job, so the merged rows are settled first.
    settled = cut_lineage(merged)
    settled.sortWithinPartitions("mes", "run_id", "nivel", "planta", "modelo").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mes").parquet(path)


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.read.schema(TRACKING).parquet(path))


def tracking_from_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, lines): an exported tracking history, and the lines of it that can't be read or lack a key, kept apart. The header must name the
    columns in their order; another file is refused. An empty file gives no rows and no lines."""
    kinds = StructType.fromDDL(TRACKING)
    schema = StructType([*[kinds[c] for c in TRACKING_COLUMNS], *StructType.fromDDL("_linea string").fields])
    read = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_linea").csv(path)
    read = cut_lineage(read)  # a column of bad lines can't be asked for alone
    whole = F.col("_linea").isNull() & F.col("run_id").isNotNull() & F.col("mes").isNotNull() & F.col("nivel").isNotNull() & F.col("modelo").isNotNull()
    columns = [c for c in read.columns if c != "_linea"]
    return with_defaults(read.where(whole).select(*columns)), read.where(~whole).select(F.coalesce("_linea", F.to_csv(F.struct(*columns))).alias("linea"))


def restore_tracking(spark: SparkSession, csv: str, path: str) -> DataFrame:
    """Puts the readable rows of an exported history in place of the stored ones with the same run and month; returns the other lines."""
    rows, lines = tracking_from_csv(spark, csv)
    save_tracking(rows, path)
    return lines
