"""Comparison of planner, internal and model forecasts on planner SKUs, for all months at once.

The model forecasts and the series are first added up by (planta, key), so every join is between small keyed tables and
never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.functions.dates import label_number
from caudal.functions.numbers import ratio
from caudal.functions.scores import error_sums, ranked, score_columns
from caudal.functions.skus import alt_key, dataset_key, planner_key
from caudal.operators.panel import SERIES, Panel

# Why a planner SKU is left out.
NO_SERIES = "sin serie en los datos"
SUBGRADE = "subgrado distinto"
LOW_HISTORY = "poca historia"
NO_MODEL = "sin predicción del modelo"
MISSING_INTERNAL = "faltante en el modelo interno"
REASON_TITLES = {
    SUBGRADE: "Subgrado distinto",
    LOW_HISTORY: "Menos de 3 meses de historia",
    MISSING_INTERNAL: "Modelo interno sin pronóstico",
    NO_SERIES: "SKU sin consumo en los datos",
    NO_MODEL: "Nuestro modelo sin pronóstico",
}
ZERO_DETAIL = "0 en todos los meses"
ABSENT_DETAIL = "no está en el archivo del modelo interno"
MISSING_TEXT = "faltante"


def series_table(panel: Panel) -> DataFrame:
    """(planta, sku, key, alt, first_mi) of every series."""
    first = panel.known().groupBy(*SERIES).agg(F.min("mi").alias("first_mi"))
    keyed = first.withColumn("key", dataset_key(F.col("sku")))
    return keyed.withColumn("alt", alt_key(F.col("key")))


def first_consumption_dates(df: DataFrame) -> DataFrame:
    """First day with rows of every (planta, key)."""
    return df.groupBy("planta", dataset_key(F.col("sku")).alias("key")).agg(F.min("fecha").alias("primera_fecha"))


def audit(planner: DataFrame, res: DataFrame, panel: Panel, models: list[str], min_history: int = 0, strategies: list[str] | None = None, horizon: int = 1) -> DataFrame:
    """Every planner row with its match, its sums and the reason it is left out (null when it is compared)."""
    if "strategy" not in planner.columns:
        planner = planner.withColumn("strategy", F.lit(""))
    if strategies is not None:
        planner = planner.where(F.col("strategy").isin(strategies))
    rows = planner.select("planta", "mes", F.col("sku_planner").alias("sku"), "strategy", F.col("forecast_to").alias("planner"))
    rows = rows.withColumn("key", planner_key(F.col("sku"))).withColumn("alt", alt_key(F.col("key")))
    rows = rows.withColumn("t", (label_number(F.col("mes")) - F.lit(panel.first_ym)).cast("int"))
    series = series_table(panel)
    by_key = series.groupBy("planta", "key").agg(F.min("first_mi").alias("first_mi"), F.count(F.lit(1)).alias("series"))
    written = F.array_join(F.slice(F.split("sku", "/"), 1, 4), "/")
    by_alt = series.groupBy("planta", "alt").agg(F.array_join(F.array_sort(F.collect_set(written)), ", ").alias("cerca"))
    sums = res.groupBy("planta", dataset_key(F.col("sku")).alias("key"), "t").agg(
        F.sum("y").alias("real"), *[F.sum(f"p_{m}").alias(m) for m in models], F.lit(True).alias("hay")
    )
    joined = rows.join(by_key, ["planta", "key"], "left").join(by_alt, ["planta", "alt"], "left").join(sums, ["planta", "key", "t"], "left")
    history = (F.col("t") - horizon - F.col("first_mi") + 1).cast("int")
    found = F.col("series").isNotNull()
    reason = (
        F.when(~found & F.col("cerca").isNotNull(), SUBGRADE)
        .when(~found, NO_SERIES)
        .when(history < min_history, LOW_HISTORY)
        .when(F.col("hay").isNull(), NO_MODEL)
    )
    detail = (
        F.when(~found & F.col("cerca").isNotNull(), F.concat(F.lit("en los datos: "), F.col("cerca")))
        .when(found & (history < min_history), F.concat(F.greatest(history, F.lit(0)).cast("string"), F.lit(" meses antes del origen")))
        .otherwise(F.lit(""))
    )
    return joined.select("planta", "mes", "sku", "strategy", "series", history.alias("history"), "real", "planner", *models, reason.alias("reason"), detail.alias("detail"), "key", "t")


def compared(audited: DataFrame) -> DataFrame:
    return audited.where(F.col("reason").isNull()).drop("reason", "detail", "key", "t")


def excluded(audited: DataFrame) -> DataFrame:
    return audited.where(F.col("reason").isNotNull()).select("planta", "mes", "sku", "strategy", "planner", "reason", "detail")


def unmatched(audited: DataFrame) -> DataFrame:
    """Planner SKUs without a match in the data."""
    return audited.where(F.col("reason").isin(NO_SERIES, SUBGRADE)).select("planta", "mes", "sku")


def attach_source(table: DataFrame, source: DataFrame, column: str) -> DataFrame:
    """Add another forecast by planta, month and SKU; null when it is absent."""
    other = source.select("planta", "mes", F.col("sku_planner").alias("sku"), F.col("forecast_to").alias(column))
    return table.join(other, ["planta", "mes", "sku"], "left")


def add_internal(table: DataFrame, internal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The internal forecast and its status; and the rows without one, with the reason."""
    known = internal.select("planta", F.col("sku_planner").alias("sku"), F.lit(True).alias("known")).distinct()
    joined = attach_source(table, internal, "internal").withColumn("internal_status", F.when(F.col("internal").isNotNull(), "ok").otherwise(MISSING_TEXT))
    gone = joined.where(F.col("internal").isNull()).join(known, ["planta", "sku"], "left")
    detail = F.when(F.col("known"), F.lit(ZERO_DETAIL)).otherwise(F.lit(ABSENT_DETAIL))
    return joined, gone.select("planta", "mes", "sku", "strategy", "planner", F.lit(MISSING_INTERNAL).alias("reason"), detail.alias("detail"))


def in_all_sources(table: DataFrame) -> DataFrame:
    return table.where(F.col("internal").isNotNull())


# ---- accuracy ------------------------------------------------------------------------------------------------------------


def source_sums(table: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    long = table.select(*keys, "real", *columns).unpivot([*keys, "real"], columns, "modelo", "f").where(F.col("f").isNotNull())
    return long.groupBy(*keys, "modelo").agg(*error_sums(F.col("real"), F.col("f")))


def accuracy_table(table: DataFrame, columns: list[str]) -> DataFrame:
    return ranked(source_sums(table, columns, []).select("modelo", *score_columns()), [])


def accuracy_by(table: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Accuracy in percent by the keys, one column per source."""
    scores = source_sums(table, columns, keys).select(*keys, "modelo", *score_columns())
    return scores.groupBy(*keys).pivot("modelo", columns).agg(F.first(F.col("accuracy") * 100))


def closest(sources: list[str]) -> Column:
    """The source with the smallest absolute error; null when two share it (a tie counts for nobody)."""
    errors = {s: F.abs(F.col(s) - F.col("real")) for s in sources}
    best = F.least(*errors.values())
    ties = sum(((errors[s] == best).cast("int") for s in sources), F.lit(0))
    winner = F.coalesce(*[F.when(errors[s] == best, F.lit(s)) for s in sources])
    return F.when(ties == 1, winner)


def closest_counts(table: DataFrame, sources: list[str]) -> DataFrame:
    return table.select(closest(sources).alias("fuente")).where(F.col("fuente").isNotNull()).groupBy("fuente").agg(F.count(F.lit(1)).alias("n"))


def by_planta(table: DataFrame, sources: list[str], extra: list[str]) -> DataFrame:
    """Rows, volumes, accuracy in percent and closest counts of every planta, in one aggregation."""
    real = F.sum("real")
    accuracy = lambda c: (1.0 - ratio(F.sum(F.abs(F.col(c) - F.col("real"))), real)) * 100
    return table.withColumn("_closest", closest(sources)).groupBy("planta").agg(
        F.count(F.lit(1)).alias("rows"), real.alias("real_TO"), F.sum("planner").alias("planner_TO"),
        *[accuracy(c).alias(f"acc_{c}") for c in [*sources, *extra]], *[F.count_if(F.col("_closest") == s).alias(f"closest_{s}") for s in sources],
    )


def closer_than(table: DataFrame, columns: list[str], reference: str) -> DataFrame:
    """(modelo, gana, n): rows in which each source is strictly closer to the real than the reference."""
    gap = F.abs(F.col("real") - F.col(reference))
    wide = table.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.abs(F.col("real") - F.col(c)) < gap).alias(c) for c in columns])
    return wide.unpivot(["n"], columns, "modelo", "gana")


# ---- report tables -------------------------------------------------------------------------------------------------------


def with_errors(table: DataFrame, sources: list[str]) -> DataFrame:
    """Errors, absolute errors and errors over the real of every source; null where the source has no forecast."""
    real = F.col("real")
    gap = {s: F.col(s) - real for s in sources}
    return table.withColumns({
        **{f"error_{s}": gap[s] for s in sources},
        **{f"abs_{s}": F.abs(gap[s]) for s in sources},
        **{f"pct_{s}": F.when(real != 0, gap[s] / real) for s in sources},
    })


def summary_by_planta(table: DataFrame, sources: list[str]) -> DataFrame:
    """One row per planta and `Todas` over the SKUs of all the sources: volumes, WAPE, accuracy, bias = forecast / real - 1."""
    rows = in_all_sources(table)
    sums = rows.groupingSets([[F.col("planta")], []], F.col("planta")).agg(
        F.when(F.grouping("planta") == 1, "Todas").otherwise(F.col("planta")).alias("fila"), F.count(F.lit(1)).alias("skus"), F.sum("real").alias("real"),
        *[F.sum(s).alias(s) for s in sources], *[F.sum(F.abs(F.col(s) - F.col("real"))).alias(f"abs_{s}") for s in sources],
    )
    wape = {s: ratio(F.col(f"abs_{s}"), F.col("real")) for s in sources}
    return sums.select(
        F.col("fila").alias("planta"), "skus", "real", *sources, *[wape[s].alias(f"wape_{s}") for s in sources],
        *[(1.0 - wape[s]).alias(f"acierto_{s}") for s in sources], *[(ratio(F.col(s), F.col("real")) - 1.0).alias(f"sesgo_{s}") for s in sources],
    )


def excluded_with_titles(rows: DataFrame) -> DataFrame:
    """The left-out rows with the reason in plain words."""
    titles = F.create_map(*[F.lit(x) for pair in REASON_TITLES.items() for x in pair])
    return rows.select("planta", "mes", "sku", "planner", F.coalesce(F.try_element_at(titles, F.col("reason")), F.col("reason")).alias("motivo"), F.replace(F.col("detail"), F.lit(" antes del origen"), F.lit("")).alias("detalle"))


def short_history(audited: DataFrame, df: DataFrame) -> DataFrame:
    """(planta, sku, primera_fecha_consumo) of the SKUs with little or no history; the date only when there is some."""
    rows = audited.where(F.col("reason").isin(LOW_HISTORY, NO_SERIES)).groupBy("planta", "sku", "key").agg(
        F.min_by("reason", "mes").alias("reason")
    )
    dates = first_consumption_dates(df)
    day = F.when(F.col("reason") == LOW_HISTORY, F.date_format("primera_fecha", "yyyy-MM-dd"))
    return rows.join(dates, ["planta", "key"], "left").select("planta", "sku", F.coalesce(day, F.lit("")).alias("primera_fecha_consumo"))
