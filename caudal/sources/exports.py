"""Consumption exports as tabular DataFrames (one column per day, or one row per day) to the long fact."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.functions.skus import export_day

# The fact schema, and the columns that tell a long export.
CONSUMPTION = T.StructType([
    T.StructField("planta", T.StringType()), T.StructField("sku", T.StringType()),
    T.StructField("fecha", T.DateType()), T.StructField("consumo", T.DoubleType()),
])
KEYS = ["planta", "sku", "fecha"]
LONG_COLUMNS = ["Customer", "Day", "Material", "TO"]
DAY_HEADER = re.compile(r"\d{2}\.\d{2}\.\d{4}")
TOLERANCE = 1e-9


class ExportConflict(ValueError):
    """The same key has different values in different exports."""


def read_consumption(spark, path: str) -> DataFrame:
    """The fact from CSV (with header) or Parquet, with a fixed schema."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.schema(CONSUMPTION).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    return spark.read.schema(CONSUMPTION).parquet(path)


def _rows(planta: Column, sku: Column, value: Column, drop_zeros: bool) -> Column:
    """Rows kept: with planta, SKU and value, no subtotal; the zero test looks at the raw value."""
    kept = planta.isNotNull() & (planta != "Result") & sku.isNotNull() & value.isNotNull()
    return kept & (value != 0.0) if drop_zeros else kept


def wide_to_long(wide: DataFrame, drop_zeros: bool = False, planta: str = "planta", sku: str = "sku") -> DataFrame:
    """One row per day column; negatives become 0 after the zero test. Columns that are no day are ignored."""
    days = [c for c in wide.columns if DAY_HEADER.fullmatch(c)]
    rows = wide.select(F.col(planta).alias("planta"), F.col(sku).alias("sku"), *[F.col(f"`{d}`").cast("double").alias(d) for d in days])
    rows = rows.where(_rows(F.col("planta"), F.col("sku"), F.lit(1.0), False))
    long = rows.unpivot(["planta", "sku"], [F.col(f"`{d}`") for d in days], "_dia", "valor").where(_rows(F.col("planta"), F.col("sku"), F.col("valor"), drop_zeros))
    return long.select("planta", "sku", export_day(F.col("_dia")).alias("fecha"), F.greatest("valor", F.lit(0.0)).alias("consumo"))


def long_to_long(raw: DataFrame, drop_zeros: bool = False) -> DataFrame:
    """Columns found by name; the SKU is the column after `Material`. Rows without a readable day are dropped."""
    sku = raw.columns[raw.columns.index("Material") + 1]
    rows = raw.select(F.col("Customer").alias("planta"), F.col(f"`{sku}`").alias("sku"), export_day(F.col("Day")).alias("fecha"), F.col("TO").cast("double").alias("valor"))
    kept = rows.where(_rows(F.col("planta"), F.col("sku"), F.col("valor"), drop_zeros) & F.col("fecha").isNotNull())
    return kept.select("planta", "sku", "fecha", F.greatest("valor", F.lit(0.0)).alias("consumo"))


def read_export(raw: DataFrame, drop_zeros: bool = False, ordered: bool = False) -> DataFrame:
    """Either layout, told apart by its column names."""
    out = long_to_long(raw, drop_zeros) if set(LONG_COLUMNS) <= set(raw.columns) else wide_to_long(raw, drop_zeros)
    return out.orderBy(*KEYS) if ordered else out


def merged(parts: list[DataFrame]) -> DataFrame:
    """(keys, consumo, minimo, maximo, copias) over all the exports; the last export gives the value."""
    union = None
    for number, part in enumerate(parts):
        tagged = part.select(*KEYS, "consumo", F.lit(number).alias("_archivo"))
        union = tagged if union is None else union.unionByName(tagged)
    return union.groupBy(*KEYS).agg(
        F.max_by("consumo", "_archivo").alias("consumo"), F.min("consumo").alias("minimo"), F.max("consumo").alias("maximo"), F.count(F.lit(1)).alias("copias")
    )


def conflicts(table: DataFrame) -> DataFrame:
    return table.where(F.col("maximo") - F.col("minimo") > TOLERANCE)


def combine_exports(parts: list[DataFrame]) -> DataFrame:
    """Equal copies collapse; a key with different values stops the load with the number of such keys."""
    table = merged(parts)
    n = conflicts(table).count()
    if n:
        raise ExportConflict(f"{n} (planta, sku, fecha) keys have different values in different inputs")
    return table.select(*KEYS, "consumo")


def write_csv(df: DataFrame, path: str, digits: int | None = 3) -> None:
    """Results as CSV, doubles rounded."""
    if digits is not None:
        df = df.select(*[F.bround(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
    df.write.mode("overwrite").option("header", True).csv(path)
