"""Selections, series, top-k reports and forecast details for people who look at the data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.dates import add_months_clipped, month_end, month_label, month_number, shift_label, working_days
from caudal.functions.text import INSIDE, contained_score, normalized, typo_score
from caudal.operators.panel import SERIES, Panel
from caudal.session import broadcast_within

# Fixed values.
TOP_SERIES = 7
DEFAULT_DAYS = 90
TABLE_LIMIT = 50
TREES = ["lgbm", "xgb", "rf"]
RETUNE_MONTHS = 6
WARN_DAYS = 30


class NotFound(LookupError):
    """A text stands for none of the names on offer."""


# ---- names ---------------------------------------------------------------------------------------------------------------


def names(df: DataFrame, column: str, planta: str | None = None) -> DataFrame:
    rows = df if planta is None else df.where(F.col("planta") == planta)
    return rows.select(F.col(column).alias("nombre")).distinct()


def suggest(options: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """The names closest to a typed text, best first: (nombre, puntos). Typos count only when nothing contains the text; an
    empty text gives the first names, without points."""
    if not text.strip():
        return options.orderBy("nombre").limit(limit).select("nombre", F.lit(0.0).alias("puntos"))
    named = options.withColumn("_n", normalized(F.col("nombre"))).withColumn("_q", normalized(F.lit(text)))
    scored = named.withColumn("puntos", contained_score(F.col("_q"), F.col("_n")))
    best = scored.where(F.col("puntos").isNotNull())
    if best.isEmpty():
        best = named.withColumn("puntos", typo_score(F.col("_q"), F.col("_n"))).where(F.col("puntos") > 0)
    else:
        best = best.where(F.col("puntos") >= INSIDE - 1.0)
    return best.orderBy(F.desc("puntos"), "nombre").limit(limit).select("nombre", "puntos")


def resolve(options: DataFrame, text: str) -> DataFrame:
    """The names a text stands for, ignoring case, accents and punctuation."""
    return options.where(normalized(F.col("nombre")) == normalized(F.lit(text)))


def exact_name(options: DataFrame, text: str | None) -> str | None:
    """The one name a text stands for, as a value; raises with suggestions when there is none."""
    if text is None or not text.strip():
        return None
    found = resolve(options, text).orderBy("nombre").first()
    if found is None:
        close = [row["nombre"] for row in suggest(options, text, 5).collect()]
        raise NotFound(f"no name like {text!r}; the closest are {close}")
    return found["nombre"]


def select(df: DataFrame, planta: str | None = None, sku: str | None = None) -> DataFrame:
    """Rows of a planta and / or SKU; the filters reach the scan."""
    if planta is not None:
        df = df.where(F.col("planta") == planta)
    return df if sku is None else df.where(F.col("sku") == sku)


# ---- consumption ---------------------------------------------------------------------------------------------------------


def monthly(panel: Panel, planta: str | None = None, sku: str | None = None) -> DataFrame:
    """(mi, mes, consumo) of a selection. One series is unknown before its first month; several add up as zero there."""
    one = planta is not None and sku is not None
    sums = select(panel.known(), planta, sku).groupBy("mi").agg(F.sum("y").alias("consumo"))
    months = panel.months().select("mi", "mes").join(F.broadcast(sums), "mi", "left")  # one row per month
    if not one:
        return months.withColumn("consumo", F.coalesce("consumo", F.lit(0.0)))
    started = F.max(F.col("consumo").isNotNull()).over(Window.orderBy("mi"))
    return months.withColumn("consumo", F.when(started, F.coalesce("consumo", F.lit(0.0))))


def monthly_summary(panel: Panel, planta: str | None = None, sku: str | None = None) -> DataFrame:
    """Total, mean of the complete months, last complete month, change against the month before and first month."""
    partial = working_days(F.date_add(F.lit(panel.calendar_end), 1), month_end(F.lit(panel.first_ym + panel.last_mi))) > 0
    rows = monthly(panel, planta, sku).where(F.col("consumo").isNotNull()).withColumn("hecho", ~(partial & (F.col("mi") == panel.last_mi)))
    done = lambda value: F.when(F.col("hecho"), value)
    previous = F.lag("consumo").over(Window.orderBy("mi"))
    table = rows.withColumn("anterior", previous).agg(
        F.bround(F.sum("consumo"), 1).alias("total_TO"), F.bround(F.avg(done(F.col("consumo"))), 1).alias("promedio_mensual_TO"),
        F.max_by("mes", done(F.col("mi"))).alias("ultimo_mes_completo"), F.max_by("consumo", done(F.col("mi"))).alias("u"), F.max_by("anterior", done(F.col("mi"))).alias("a"),
        F.min("mes").alias("primer_mes"),
    )
    return table.select(
        "total_TO", "promedio_mensual_TO", "ultimo_mes_completo", F.bround("u", 1).alias("ultimo_mes_TO"),
        F.when(F.col("a") > 0, F.bround((F.col("u") / F.col("a") - 1) * 100, 1)).alias("cambio_vs_mes_anterior_pct"), "primer_mes",
    )


def daily(df: DataFrame, panel: Panel, planta: str | None = None, sku: str | None = None, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
    """(fecha, consumo) of every day of a range, the last 90 days by default, 0 on days without rows."""
    last = panel.calendar_end if until is None else until
    wanted = last - dt.timedelta(days=DEFAULT_DAYS - 1) if since is None else since
    if wanted > last:
        raise ValueError(f"no day lies between {wanted} and {last}")
    opening = dt.date(panel.first_ym // 12, panel.first_ym % 12 + 1, 1)
    low, high = max(wanted, opening), min(last, panel.calendar_end)
    rows = select(df, planta, sku).where((F.col("fecha") >= F.lit(low)) & (F.col("fecha") <= F.lit(high)))
    sums = rows.groupBy("fecha").agg(F.sum("consumo").alias("consumo"))
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("fecha"))
    return days.join(sums, "fecha", "left").select("fecha", F.coalesce("consumo", F.lit(0.0)).alias("consumo"))


def breakdown(panel: Panel, planta: str | None = None, top: int = TOP_SERIES) -> DataFrame:
    """(nombre, mi, consumo): the largest series by total (plantas, or the SKUs of one planta) and the rest as `Otros`.

    The top is a limit over totals, so no task ranks all the series."""
    name = "planta" if planta is None else "sku"
    rows = select(panel.known(), planta).groupBy(F.col(name).alias("nombre"), "mi").agg(F.sum("y").alias("consumo"))
    largest = rows.groupBy("nombre").agg(F.sum("consumo").alias("t")).orderBy(F.desc("t"), "nombre").limit(top).select("nombre", F.lit(True).alias("_top"))
    tagged = rows.join(broadcast_within(largest, top), "nombre", "left")
    return tagged.groupBy(F.when(F.col("_top"), F.col("nombre")).otherwise(F.lit("Otros")).alias("nombre"), "mi").agg(F.sum("consumo").alias("consumo"))


def overview(df: DataFrame) -> DataFrame:
    """Rows, series, plantas, first and last day and the partial month, as one row. Series are counted after the fact is
    reduced to one row per series."""
    series = df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.min("fecha").alias("lo"), F.max("fecha").alias("hi"))
    plantas = series.groupBy("planta").agg(F.count(F.lit(1)).alias("series"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    table = plantas.agg(F.sum("n").alias("filas"), F.sum("series").alias("series"), F.count(F.lit(1)).alias("plantas"), F.min("lo").alias("primer_dia"), F.max("hi").alias("ultimo_dia"))
    number = month_number(F.col("ultimo_dia"))
    left = working_days(F.date_add("ultimo_dia", 1), month_end(number))
    partial = F.when(left > 0, month_label(number))
    return table.select("*", partial.alias("mes_parcial"), F.when(left > 0, month_label(number - 1)).otherwise(month_label(number)).alias("ultimo_mes_completo"))


def monthly_pivot(panel: Panel, planta: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """One row per series and one column per month (or per given label), null outside the months of the series."""
    labels = labels or [panel.label_of(mi) for mi in range(panel.last_mi + 1)]
    rows = select(panel.dense(), planta).withColumn("mes", panel.label(F.col("mi")))
    return rows.groupBy(*SERIES).pivot("mes", labels).agg(F.bround(F.sum("y"), 3))


def month_actuals(panel: Panel, mi: int) -> DataFrame:
    """(planta, sku, real) of one month for every series known by then or later (0 when it has nothing)."""
    sums = panel.known().groupBy(*SERIES).agg(F.sum(F.when(F.col("mi") == mi, F.col("y")).otherwise(F.lit(0.0))).alias("real"))
    return sums


# ---- forecasts -----------------------------------------------------------------------------------------------------------


def reference_month(mes: Column, last_complete: Column) -> Column:
    """The real month a forecast is compared with: the one before it when closed, else the last complete one."""
    before = shift_label(mes, -1)
    return F.when(before <= last_complete, before).otherwise(last_complete)


def _change(forecast: Column, real: Column) -> Column:
    return F.when(real != 0, (forecast / real - 1) * 100)


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """Total of every model, the spread of the three trees and the number of series."""
    models = [*TREES, "ml_mean", "naive"]
    sums = forecast.agg(*[F.sum(m).alias(m) for m in models], F.count(F.lit(1)).alias("series"))
    return sums.select("*", F.least(*TREES).alias("minimo"), F.greatest(*TREES).alias("maximo"))


def forecast_by_planta(forecast: DataFrame, panel: Panel, reference: int) -> DataFrame:
    """Forecast and last real of every planta, with the models (the planta real holds all its series)."""
    sums = forecast.groupBy("planta").agg(*[F.sum(m).alias(m) for m in ("ml_mean", *TREES)], F.count(F.lit(1)).alias("series"))
    real = panel.planta_months().where(F.col("mi") == reference).select("planta", F.col("y").alias("real"))
    return sums.join(real, "planta", "left").withColumn("cambio_pct", _change(F.col("ml_mean"), F.col("real")))


def forecast_by_sku(forecast: DataFrame, panel: Panel, reference: int, limit: int | None = TABLE_LIMIT) -> DataFrame:
    """Forecast, range of the trees, last real and change of every series, largest first (a top-k with `limit`)."""
    real = panel.known().where(F.col("mi") == reference).select(*SERIES, F.col("y").alias("real"))
    rows = forecast.join(real, SERIES, "left").withColumn("real", F.coalesce("real", F.lit(0.0)))
    rows = rows.select(*SERIES, "ml_mean", F.least(*TREES).alias("minimo"), F.greatest(*TREES).alias("maximo"), "naive", "real", _change(F.col("ml_mean"), F.col("real")).alias("cambio_pct"))
    return rows if limit is None else rows.orderBy(F.desc("ml_mean"), *SERIES).limit(limit)


def forecast_history(catalogue: DataFrame, measured: DataFrame) -> DataFrame:
    """Saved forecasts with the accuracy of their newest production run, null while they are not measured."""
    scores = measured.where(F.col("origen") == "produccion").select("mes", "estrategia", "sku", "planta", "total")
    return catalogue.join(scores, ["mes", "estrategia"], "left")


def retune_state(last: Column, today: Column, months: int = RETUNE_MONTHS) -> list[Column]:
    """Next due date, days left and state of the periodic retune."""
    due = add_months_clipped(last, months)
    left = F.date_diff(due, today)
    return [due.alias("proximo"), left.alias("dias_restantes"), F.when(left < 0, "vencido").when(left <= WARN_DAYS, "por_vencer").otherwise("al_dia").alias("estado")]


def candidate_summary(scores: DataFrame) -> DataFrame:
    """Gain of tuned parameters: per model the mean accuracy of the seeds at every level, in percent, before and after.

    `scores` has modelo, version (`base` or `tuned`), nivel and accuracy, one row per seed."""
    level = lambda v, n: F.bround(F.avg(F.when((F.col("version") == v) & (F.col("nivel") == n), F.col("accuracy"))) * 100, 1)
    table = scores.groupBy("modelo").agg(*[level(v, n).alias(f"{n}_{name}") for n in ("sku", "planta", "total") for v, name in (("base", "base"), ("tuned", "ajustado"))])
    return table.withColumn("mejora_sku_pts", F.bround(F.col("sku_ajustado") - F.col("sku_base"), 1))

