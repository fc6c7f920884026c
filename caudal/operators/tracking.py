"""Tracking of saved forecasts against the real of closed months, for any number of runs and months in one pass.

`by` names the columns that identify a forecast table; it always holds `mes` and may hold `run_id` and `estrategia`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.functions.dates import label_number, month_end, month_number, working_days
from caudal.functions.numbers import finite, ratio
from caudal.functions.scores import ERROR_SUMS, add_up, error_sums
from caudal.operators.panel import SERIES, Panel

# Fixed values.
MODELS = ["ml_mean", "lgbm", "xgb", "rf", "naive"]
LEVELS = ["sku", "planta", "total"]
THRESHOLDS = {"sku": 0.64, "planta": 0.85, "total": 0.90, "planta_revisar": 0.60}
THRESHOLDS_TWO_MONTHS = {"sku": 0.60, "planta": 0.83, "total": 0.87, "planta_revisar": 0.60}
ALERT_ORDER = ["sku_bajo", "planta_bajo", "total_bajo", "peor_que_naive", "planta_revisar"]
MIN_COVERAGE = 0.5
BACKTEST_PREFIX = "backtest-"
STRATEGY_ORDER = ["h1", "nowcast_media", "iterada"]
TRACKING_COLUMNS = [
    "run_id", "mes", "nivel", "planta", "modelo", "acierto", "wape", "bias_pct", "n", "real_TO", "pronostico_TO",
    "alerta", "creado_en", "estrategia", "corte",
]
TOP_ERRORS = 15


# ---- guards --------------------------------------------------------------------------------------------------------------


def month_closed(df: DataFrame, months: DataFrame) -> DataFrame:
    """(mes, presente, dias_faltantes, cerrado) for a table of months: is the month in the data and are its last working
    days there. Equality joins on the month only; the fact shrinks to one row per month first."""
    last_day = df.groupBy(month_number(F.col("fecha")).alias("ym")).agg(F.max("fecha").alias("ultimo"))
    asked = months.select("mes", label_number(F.col("mes")).alias("ym")).distinct()
    left = working_days(F.date_add("ultimo", 1), month_end(F.col("ym")))
    table = asked.join(last_day, "ym", "left").withColumn("presente", F.col("ultimo").isNotNull()).withColumn("dias_faltantes", left)
    return table.select("mes", "presente", "dias_faltantes", (F.col("presente") & (F.coalesce("dias_faltantes", F.lit(1)) == 0)).alias("cerrado"))


def forecast_coverage(panel: Panel, forecast: DataFrame, by: list[str]) -> DataFrame:
    """(by, encontradas, series, pertenece): how many series of a forecast exist in the data."""
    known = panel.monthly.select(*SERIES).distinct().withColumn("_known", F.lit(1))
    counts = forecast.join(known, SERIES, "left").groupBy(*by).agg(F.count("_known").alias("encontradas"), F.count(F.lit(1)).alias("series"))
    return counts.withColumn("pertenece", F.col("encontradas") / F.col("series") >= MIN_COVERAGE)


# ---- scores --------------------------------------------------------------------------------------------------------------


def with_real(panel: Panel, forecast: DataFrame) -> DataFrame:
    """The forecast rows with the real of their month (0 when the series has none)."""
    real = panel.known().select(*SERIES, "mi", F.col("y").alias("real"))
    rows = forecast.withColumn("mi", (label_number(F.col("mes")) - F.lit(panel.first_ym)).cast("int"))
    return rows.join(real, [*SERIES, "mi"], "left").withColumn("real", F.coalesce("real", F.lit(0.0)))


def without_forecast(panel: Panel, forecast: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, real_TO): series that consumed in the month and have no forecast."""
    runs = forecast.select(*by, (label_number(F.col("mes")) - F.lit(panel.first_ym)).cast("int").alias("mi")).distinct()
    alive = panel.known().where(F.col("y") > 0).select(*SERIES, "mi", "y").join(runs, "mi")
    gone = alive.join(forecast.select(*by, *SERIES), [*by, *SERIES], "left_anti")
    sums = gone.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("real_TO"))
    return runs.drop("mi").join(sums, by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("real_TO", F.lit(0.0)).alias("real_TO"))


def _scored(sums: DataFrame, by: list[str]) -> DataFrame:
    wape = ratio(F.col("abs_error"), F.col("real"))
    return sums.select(
        *by, "nivel", "planta", "modelo", finite(1.0 - wape).alias("acierto"), finite(wape).alias("wape"),
        finite(ratio(F.col("error"), F.col("real")) * 100.0).alias("bias_pct"), F.col("n"), F.col("real").alias("real_TO"), F.col("pronostico").alias("pronostico_TO"),
    )


def month_scores(panel: Panel, forecast: DataFrame, models: list[str] = MODELS, by: list[str] | None = None) -> DataFrame:
    """How good each model was, at each level of detail. Rows of level `sku` pool the forecast series; `planta` rows are one
    per planta and one, with an empty name, for all of them; a `sin_pronostico` row says what nobody forecast. What the
    plantas and the total really consumed includes the series without a forecast."""
    by = by or ["mes"]
    models = [m for m in models if m in forecast.columns]
    rows = with_real(panel, forecast).select(*by, "planta", "mi", "real", *models)
    long = rows.unpivot([*by, "planta", "mi", "real"], models, "modelo", "p")
    cells = long.groupBy(*by, "mi", "planta", "modelo").agg(*error_sums(F.col("real"), F.col("p")))

    # Every planta of the month, with the sums of its run and model carried along, then both groupings at once.
    runs = cells.groupBy(*by, "mi", "modelo").agg(F.struct(*add_up()).alias("sku"))
    real = panel.planta_months().select("planta", "mi", F.col("y").alias("real"))
    grid = real.join(runs, "mi").join(cells.select(*by, "planta", "modelo", F.col("pronostico").alias("p")), [*by, "planta", "modelo"], "left")
    keys = [F.col(c) for c in (*by, "modelo")]
    sets = grid.withColumn("p", F.coalesce("p", F.lit(0.0))).groupingSets([[*keys, F.col("planta")], keys], *keys, F.col("planta")).agg(
        *error_sums(F.col("real"), F.col("p")), F.first("sku").alias("sku"), F.grouping("planta").alias("_pooled")
    )
    gap = F.col("real") - F.col("sku.pronostico")
    own = [F.col(c) for c in ERROR_SUMS]
    pooled = F.array(
        F.struct(F.lit("sku").alias("nivel"), F.lit("").alias("lugar"), *[F.col(f"sku.{c}") for c in ERROR_SUMS]),
        F.struct(F.lit("planta").alias("nivel"), F.lit("").alias("lugar"), *own),
        F.struct(
            F.lit("total").alias("nivel"), F.lit("").alias("lugar"), F.lit(1).cast("bigint").alias("n"), F.abs(gap).alias("abs_error"),
            gap.alias("error"), F.col("real").alias("real"), F.col("sku.pronostico").alias("pronostico"),
        ),
    )
    single = F.array(F.struct(F.lit("planta").alias("nivel"), F.col("planta").alias("lugar"), *own))
    levels = sets.where((F.col("_pooled") == 1) | (F.col("real") > 0)).select(*keys, F.explode(F.when(F.col("_pooled") == 1, pooled).otherwise(single)).alias("l"))
    scored = _scored(levels.select(*keys, "l.*").withColumnRenamed("lugar", "planta"), by)

    nothing = [F.lit(None).cast("double").alias(c) for c in ("acierto", "wape", "bias_pct")]
    gone = without_forecast(panel, forecast, by).select(
        *by, F.lit("sin_pronostico").alias("nivel"), F.lit("").alias("planta"), F.lit("-").alias("modelo"), *nothing, "n", "real_TO", F.lit(0.0).alias("pronostico_TO")
    )
    return scored.unionByName(gone)


# ---- alerts --------------------------------------------------------------------------------------------------------------


def threshold(strategy: Column, key: str) -> Column:
    return F.when(strategy == "h1", F.lit(THRESHOLDS[key])).otherwise(F.lit(THRESHOLDS_TWO_MONTHS[key]))


def find_alerts(scores: DataFrame, by: list[str] | None = None, strategy: Column | None = None) -> DataFrame:
    """One row for each accuracy of the mean forecast that does not reach its threshold: (by, codigo, tipo, nivel, planta, valor, umbral)."""
    by = by or ["mes"]
    strategy = strategy if strategy is not None else (F.col("estrategia") if "estrategia" in scores.columns else F.lit("h1"))
    ml = scores.where(F.col("modelo") == "ml_mean").withColumn("_s", strategy)
    limit = F.coalesce(*[F.when(F.col("nivel") == level, threshold(F.col("_s"), level)) for level in LEVELS])
    low = ml.where((F.col("planta") == "") & (F.col("acierto") < limit)).select(
        *by, F.concat("nivel", F.lit("_bajo")).alias("codigo"), F.lit("alerta").alias("tipo"), "nivel", "planta", F.col("acierto").alias("valor"), limit.alias("umbral")
    )
    both = scores.where((F.col("nivel") == "sku") & F.col("modelo").isin("ml_mean", "naive")).groupBy(*by).agg(
        F.max(F.when(F.col("modelo") == "ml_mean", F.col("acierto"))).alias("valor"), F.max(F.when(F.col("modelo") == "naive", F.col("acierto"))).alias("umbral")
    )
    worse = both.where(F.col("valor") < F.col("umbral")).select(
        *by, F.lit("peor_que_naive").alias("codigo"), F.lit("alerta").alias("tipo"), F.lit("sku").alias("nivel"), F.lit("").alias("planta"), "valor", "umbral"
    )
    review = threshold(F.col("_s"), "planta_revisar")
    check = ml.where((F.col("nivel") == "planta") & (F.col("planta") != "") & (F.col("acierto") < review)).select(
        *by, F.lit("planta_revisar").alias("codigo"), F.lit("info").alias("tipo"), "nivel", "planta", F.col("acierto").alias("valor"), review.alias("umbral")
    )
    return low.unionByName(worse).unionByName(check)


def tracking_rows(scores: DataFrame, alerts: DataFrame, by: list[str], created_at: Column, cutoff: Column | None = None) -> DataFrame:
    """The scores as stored: the alert codes on the `ml_mean` row they refer to."""
    place = F.array_position(F.array(*[F.lit(c) for c in ALERT_ORDER]), F.col("codigo"))
    listed = F.array_sort(F.collect_list(F.struct(place.alias("orden"), "codigo")))
    codes = alerts.groupBy(*by, "nivel", "planta").agg(F.array_join(F.transform(listed, lambda x: x["codigo"]), ";").alias("alerta"))
    codes = codes.withColumn("modelo", F.lit("ml_mean"))
    rows = scores.join(codes, [*by, "nivel", "planta", "modelo"], "left").withColumn("alerta", F.coalesce("alerta", F.lit("")))
    corte = cutoff if cutoff is not None else F.lit(None).cast("int")
    if "estrategia" not in rows.columns:
        rows = rows.withColumn("estrategia", F.lit("h1"))
    return rows.withColumn("creado_en", created_at).withColumn("corte", corte).select(*TRACKING_COLUMNS)


def with_defaults(rows: DataFrame) -> DataFrame:
    """A stored history of any age in the current shape: strategy h1, empty texts, no infinities."""
    for name, value in (("estrategia", F.lit("h1")), ("corte", F.lit(None).cast("int"))):
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    kinds = dict(rows.dtypes)
    clean = {c: finite(F.col(c)) for c in rows.columns if kinds[c] in ("double", "float")}
    clean |= {c: F.coalesce(c, F.lit("")) for c in ("planta", "alerta")}
    clean["estrategia"] = F.coalesce("estrategia", F.lit("h1"))
    return rows.withColumns(clean).select(*TRACKING_COLUMNS)


def replace_tracking(old: DataFrame, new: DataFrame) -> DataFrame:
    """The history with every (run_id, mes) of `new` replaced."""
    keys = new.select("run_id", "mes").distinct()
    return with_defaults(old).join(keys, ["run_id", "mes"], "left_anti").unionByName(with_defaults(new))


# ---- history and detail --------------------------------------------------------------------------------------------------


def is_backtest() -> Column:
    return F.startswith(F.col("run_id"), F.lit(BACKTEST_PREFIX))


def shown(table: DataFrame) -> DataFrame:
    return table.where(F.col("estrategia").isin(STRATEGY_ORDER))


def production(table: DataFrame) -> DataFrame:
    return table.where(~is_backtest())


def newest_runs(table: DataFrame, keys: list[str]) -> DataFrame:
    """The run to show for each key: the newest by creation time, the first name when two are equal. Aggregated, not a
    window, so a long history of one month does not meet in one task."""
    runs = table.groupBy(*keys, "run_id").agg(F.max("creado_en").alias("creado_en"))
    newest = runs.groupBy(*keys).agg(F.max("creado_en").alias("creado_en"))
    return runs.join(newest, [*keys, "creado_en"]).groupBy(*keys).agg(F.min("run_id").alias("run_id"))


def percent(value: Column) -> Column:
    return F.bround(finite(value) * 100, 1)


def history(table: DataFrame) -> DataFrame:
    """(origen, mes, estrategia, corte, run_id, sku, planta, total, alertas): accuracy of `ml_mean` in percent; every
    backtest, and the newest production run of each (mes, estrategia)."""
    table = shown(table).withColumn("origen", F.when(is_backtest(), "backtest").otherwise("produccion"))
    ml = table.where((F.col("modelo") == "ml_mean") & (F.col("planta") == "") & F.col("nivel").isin(LEVELS))
    keep = newest_runs(production(ml), ["mes", "estrategia"]).unionByName(ml.where(is_backtest()).select("mes", "estrategia", "run_id").distinct())
    keys = ["origen", "mes", "estrategia", "run_id"]
    scores = ml.groupBy(*keys).agg(F.max("corte").alias("corte"), *[percent(F.max(F.when(F.col("nivel") == level, F.col("acierto")))).alias(level) for level in LEVELS])
    codes = table.where(F.col("alerta") != "").select("run_id", "mes", F.explode(F.split("alerta", ";")).alias("c"))
    codes = codes.groupBy("run_id", "mes").agg(F.array_join(F.array_sort(F.collect_set("c")), ", ").alias("alertas"))
    out = scores.join(keep, ["mes", "estrategia", "run_id"]).join(codes, ["run_id", "mes"], "left")
    return out.select(*keys, "corte", *LEVELS, F.coalesce("alertas", F.lit("")).alias("alertas"))


def strategy_comparison(rows: DataFrame) -> DataFrame:
    """Mean of the monthly accuracies of each strategy and origin; a month counts once."""
    return rows.groupBy("estrategia", "origen").agg(F.count(F.lit(1)).alias("meses"), *[F.bround(F.avg(level), 1).alias(level) for level in LEVELS])


def chosen_run(table: DataFrame, mes: str, origin: str = "produccion", strategy: str = "h1") -> DataFrame:
    """The rows of one run: the newest of a month, origin and strategy."""
    rows = shown(table).where((F.col("mes") == mes) & (F.col("estrategia") == strategy))
    rows = rows.where(is_backtest()) if origin == "backtest" else production(rows)
    return rows.join(newest_runs(rows, ["mes", "estrategia"]), ["mes", "estrategia", "run_id"], "left_semi")


def detail_models(run: DataFrame) -> DataFrame:
    """One row per model: accuracy by level and the bias of the total, in percent."""
    pooled = run.where((F.col("planta") == "") & F.col("nivel").isin(LEVELS))
    return pooled.groupBy("modelo").agg(
        *[percent(F.max(F.when(F.col("nivel") == level, F.col("acierto")))).alias(level) for level in LEVELS],
        F.bround(F.max(F.when(F.col("nivel") == "total", F.col("bias_pct"))), 1).alias("sesgo_total_pct"),
    )


def detail_plantas(run: DataFrame) -> DataFrame:
    """The plantas of `ml_mean`, worst first."""
    rows = run.where((F.col("modelo") == "ml_mean") & (F.col("nivel") == "planta") & (F.col("planta") != ""))
    return rows.select("planta", percent(F.col("acierto")).alias("acierto"), "real_TO", "pronostico_TO", "bias_pct").orderBy("acierto", "planta")


def other_strategies(table: DataFrame, mes: str, origin: str, strategy: str) -> DataFrame:
    """How the other strategies did in the same month."""
    rows = shown(table).where((F.col("mes") == mes) & (F.col("estrategia") != strategy))
    rows = rows.where(is_backtest()) if origin == "backtest" else production(rows)
    kept = rows.join(newest_runs(rows, ["mes", "estrategia"]), ["mes", "estrategia", "run_id"], "left_semi")
    pooled = kept.where((F.col("modelo") == "ml_mean") & (F.col("planta") == ""))
    return pooled.groupBy("estrategia").agg(*[percent(F.max(F.when(F.col("nivel") == level, F.col("acierto")))).alias(level) for level in LEVELS])


def top_errors(panel: Panel, forecast: DataFrame, n: int = TOP_ERRORS) -> DataFrame:
    """The series a forecast missed most, in tonnes: a top-k, kept small in every task."""
    rows = with_real(panel, forecast).withColumn("error", F.col("ml_mean") - F.col("real"))
    return rows.orderBy(F.abs("error").desc(), *SERIES).limit(n).select(*SERIES, "real", "ml_mean", "error")


def to_measure(saved: DataFrame, tracked: DataFrame, closed: DataFrame) -> DataFrame:
    """Saved forecasts (mes, estrategia) whose month has closed (mes, cerrado) and that no production run has measured."""
    ready = saved.join(closed.where("cerrado").select("mes"), "mes", "left_semi")
    return ready.join(production(tracked).select("mes", "estrategia").distinct(), ["mes", "estrategia"], "left_anti")


def last_tracking(table: DataFrame) -> DataFrame:
    """The newest tracked month of the production runs (of the h1 backtest when there is none): one row."""
    ml = table.where((F.col("modelo") == "ml_mean") & (~is_backtest() | (F.col("run_id") == BACKTEST_PREFIX + "h1")))
    ml = ml.withColumn("origen", F.when(is_backtest(), "backtest").otherwise("produccion"))
    place = F.coalesce(*[F.when(F.col("estrategia") == s, F.lit(i)) for i, s in enumerate(STRATEGY_ORDER)], F.lit(99))
    runs = ml.groupBy("origen", "mes", "estrategia", "run_id").agg(
        F.max("creado_en").alias("creado_en"), *[percent(F.max(F.when((F.col("nivel") == level) & (F.col("planta") == ""), F.col("acierto")))).alias(level) for level in LEVELS],
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("alerta") != "", F.split("alerta", ";")))))), ", ").alias("alertas"),
    )
    first = runs.orderBy(F.desc("origen"), F.desc("mes"), place, F.desc("creado_en"), "run_id").limit(1)
    return first.select("mes", "estrategia", "origen", *LEVELS, "alertas")


def forecast_tables(cache: DataFrame, panel: Panel, columns: dict[str, str]) -> DataFrame:
    """A backtest cache as forecast tables of every month: (planta, sku, mes, one column per model)."""
    return cache.select(*SERIES, panel.label(F.col("t")).alias("mes"), *[F.col(source).alias(model) for model, source in columns.items()])


def refused(df: DataFrame, panel: Panel, forecast: DataFrame, by: list[str]) -> DataFrame:
    """(by, mes, motivo): forecasts that can't be measured, because their month is still open or because they were made for
    other data. A forecast may have both rows."""
    months = month_closed(df, forecast.select("mes")).where(~F.col("cerrado")).select("mes")
    runs = list(dict.fromkeys([*by, "mes"]))
    made = forecast.select(*runs).distinct()
    still_open = made.join(months, "mes", "left_semi").withColumn("motivo", F.lit("mes abierto"))
    foreign = forecast_coverage(panel, forecast, by).where(~F.coalesce("pertenece", F.lit(False))).select(*by)
    return still_open.select(*runs, "motivo").unionByName(made.join(foreign, by, "left_semi").withColumn("motivo", F.lit("otros datos")).select(*runs, "motivo"))


def track(df: DataFrame, panel: Panel, forecast: DataFrame, by: list[str], created_at: Column, cutoff: Column | None = None) -> DataFrame:
    """Scores and alerts of the saved forecasts that can be measured; `refused` lists the others and why."""
    rows = forecast.join(refused(df, panel, forecast, by).select(*by, "mes").distinct(), list(dict.fromkeys([*by, "mes"])), "left_anti")
    scores = month_scores(panel, rows, by=by)
    return tracking_rows(scores, find_alerts(scores, by), by, created_at, cutoff)


def strategy_of(files: DataFrame) -> DataFrame:
    """Strategy and cutoff day of saved forecasts (archivo, manifiesto): from the manifest, else the file name, else h1."""
    used = F.get_json_object("manifiesto", "$.strategy.used")
    named = F.nullif(F.regexp_extract("archivo", r"^forecast_\d{4}-\d{2}_([a-z_]+)$", 1), F.lit(""))
    cutoff = F.when(used.isNotNull(), F.get_json_object("manifiesto", "$.strategy.cutoff_day").cast("int"))
    return files.select("archivo", F.coalesce(used, named, F.lit("h1")).alias("estrategia"), cutoff.alias("corte"))

