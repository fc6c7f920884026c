"""Planner assignment tables and internal forecast tables, as tabular DataFrames, to their long layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.skus import build_sku, header_month, month_of_column
from caudal.functions.text import strip

# The columns of the two sources and of their long layouts.
ASSIGNMENT_COLUMNS = ["Customer", "Grade", "Sub-grade", "Grammage", "Width", "Product", "Strategy", "Plant Forecast"]
INTERNAL_COLUMNS = ["Customer", "Grade", "Sub-grade", "Grammage", "Width", "Product"]
PLANNER_COLUMNS = ["planta", "mes", "sku_planner", "product_sap", "strategy", "forecast_to"]
LONG_INTERNAL = ["planta", "mes", "sku_planner", "product_sap", "forecast_to"]


class SourceError(ValueError):
    """A source table cannot be used."""


def _sku() -> Column:
    return build_sku(F.col("Grade"), F.col("Sub-grade"), F.col("Grammage"), F.col("Width"))


def assignment(raw: DataFrame) -> DataFrame:
    """One row per planta and planner SKU; the month comes from the name of the ninth column."""
    if raw.columns[:8] != ASSIGNMENT_COLUMNS or len(raw.columns) < 9:
        raise SourceError(f"expected the columns {ASSIGNMENT_COLUMNS} and an allocation column, found {raw.columns}")
    rows = raw.where(F.col("Customer").isNotNull())
    return rows.select(
        strip(F.col("Customer").cast("string")).alias("planta"), header_month(F.lit(raw.columns[8])).alias("mes"), _sku().alias("sku_planner"),
        F.col("Product").cast("int").alias("product_sap"), strip(F.coalesce(F.col("Strategy").cast("string"), F.lit(""))).alias("strategy"),
        F.col("Plant Forecast").cast("string").try_cast("double").alias("forecast_to"),
    )


def repeated_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("copias")).where(F.col("copias") > 1)


def assignment_problems(table: DataFrame) -> DataFrame:
    """(problema, n): unreadable month, missing or negative forecasts, repeated (planta, SKU)."""
    value = F.col("forecast_to")
    flags = F.array_compact(F.array(
        F.when(F.col("mes").isNull(), F.lit("mes")), F.when(value.isNull() | F.isnan(value), F.lit("pronostico faltante")), F.when(value < 0, F.lit("pronostico negativo"))
    ))
    by_row = table.select(F.explode(flags).alias("problema")).groupBy("problema").agg(F.count(F.lit(1)).alias("n"))
    copies = repeated_keys(table, ["planta", "sku_planner"]).agg(F.sum("copias").alias("n")).where(F.col("n") > 0)
    return by_row.unionByName(copies.select(F.lit("clave repetida").alias("problema"), "n"))


def read_assignment(raw: DataFrame) -> DataFrame:
    table = assignment(raw)
    found = assignment_problems(table).collect()  # at most one row per kind of problem
    if found:
        raise SourceError("; ".join(f"{row['problema']}: {row['n']} rows" for row in found))
    return table


def internal_months(raw: DataFrame) -> list[str]:
    if raw.columns[:6] != INTERNAL_COLUMNS or len(raw.columns) == 6:
        raise SourceError(f"expected the columns {INTERNAL_COLUMNS} and month columns, found {raw.columns}")
    return raw.columns[6:]


def _quoted(name: str) -> str:
    return f"`{name}`"


def internal_totals(raw: DataFrame) -> DataFrame:
    """(columna, suma, total, cuadra): each month column added up against its Result row (absolute 0.5, relative 1e-5)."""
    months = internal_months(raw)
    is_total = F.lower(strip(F.col("Customer").cast("string"))) == "result"
    rows = raw.select(is_total.alias("es_total"), F.col("Grade").isNotNull().alias("es_fila"), *[F.col(_quoted(m)).cast("double").alias(m) for m in months])
    long = rows.unpivot(["es_total", "es_fila"], [F.col(_quoted(m)) for m in months], "columna", "valor")
    sums = long.groupBy("columna").agg(
        F.coalesce(F.sum(F.when(F.col("es_fila"), F.col("valor"))), F.lit(0.0)).alias("suma"), F.max(F.when(F.col("es_total"), F.col("valor"))).alias("total")
    )
    fits = F.abs(F.col("total") - F.col("suma")) <= 0.5 + 1e-5 * F.abs("suma")
    return sums.withColumn("cuadra", F.col("total").isNull() | fits)


def internal_long(raw: DataFrame) -> DataFrame:
    """(planta, mes, sku_planner, product_sap, forecast_to) without the Result row."""
    labels = {name: month_of_column(name) for name in internal_months(raw)}
    unreadable = [name for name, label in labels.items() if label is None]
    if unreadable:
        raise SourceError(f"cannot read the month from the columns {unreadable}")
    rows = raw.where(F.col("Grade").isNotNull()).select(
        strip(F.col("Customer").cast("string")).alias("planta"), _sku().alias("sku_planner"), F.col("Product").cast("int").alias("product_sap"),
        *[F.col(_quoted(name)).cast("string").try_cast("double").alias(label) for name, label in labels.items()],
    )
    long = rows.unpivot(["planta", "sku_planner", "product_sap"], [F.col(_quoted(label)) for label in labels.values()], "mes", "forecast_to")
    return long.select(*LONG_INTERNAL)


def read_internal(raw: DataFrame) -> DataFrame:
    """The long table, after the checks that stop the load."""
    off = [row["columna"] for row in internal_totals(raw).where(~F.col("cuadra")).collect()]  # one row per month column
    if off:
        raise SourceError(f"the Result row is not the sum of the rows in {off}")
    long = internal_long(raw)
    bad = long.where(F.col("forecast_to").isNull() | F.isnan("forecast_to") | (F.col("forecast_to") < 0)).count()
    if bad:
        raise SourceError(f"{bad} missing or negative forecasts")
    if not repeated_keys(long, ["planta", "sku_planner", "mes"]).isEmpty():
        raise SourceError("a (planta, SKU) is repeated")
    return long


def product_to_sku(files: DataFrame) -> DataFrame:
    """(product_sap, sku_planner): the name in the first file wins. `files` has product_sap, sku_planner, archivo, fila."""
    return files.groupBy("product_sap").agg(F.min_by("sku_planner", F.struct("archivo", "fila")).alias("sku_planner"))


def internal_by_code(wide: DataFrame, dictionary: DataFrame, months: list[str]) -> tuple[DataFrame, DataFrame]:
    """The internal forecast by product code in the planner layout, and the rows whose code is unknown."""
    known = wide.join(dictionary, "product_sap")
    long = known.unpivot(["planta", "product_sap", "sku_planner"], [F.col(_quoted(m)) for m in months], "mes", "forecast_to")
    unmatched = wide.join(dictionary, "product_sap", "left_anti")
    return long.withColumn("strategy", F.lit("")).select(*PLANNER_COLUMNS), unmatched


def replace_planta(long: DataFrame, other: DataFrame, planta: str) -> DataFrame:
    """`long` with the rows of one planta taken from `other`."""
    return long.where(F.col("planta") != planta).unionByName(other.where(F.col("planta") == planta).select(*long.columns))


def all_zero_plantas(long: DataFrame) -> DataFrame:
    """(planta, todo_cero): does the planta have only zeros."""
    return long.groupBy("planta").agg(F.bool_and(F.col("forecast_to") == 0).alias("todo_cero"))


def mark_missing(long: DataFrame) -> DataFrame:
    """A SKU that is 0 in every month has no forecast: null. A group is one row per month."""
    months = Window.partitionBy("planta", "sku_planner")
    empty = F.coalesce(F.bool_and(F.col("forecast_to") == 0).over(months), F.lit(False))
    return long.withColumn("forecast_to", F.when(~empty, F.col("forecast_to")))
