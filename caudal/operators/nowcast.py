"""The month in progress: its first days, completions by mean and median, and their scores over past months.

All the months of a backtest are computed together, keyed by month; nothing after the cutoff day of a month enters its
forecast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.dates import is_sunday, month_number, working_days
from caudal.functions.numbers import ratio, sorted_median
from caudal.functions.scores import error_sums
from caudal.operators.panel import SERIES, Panel

TIE = 0.005
TARGETS = ["mes", "resto"]


def cutoff_date(panel: Panel, mi: Column, day: int) -> Column:
    """The last day seen: the cutoff day of the month, or the last day its calendar has."""
    return F.least(F.date_add(panel.first_day(mi), day - 1), panel.last_day(mi))


def days_seen(panel: Panel, mi: Column, day: int) -> Column:
    return working_days(panel.first_day(mi), cutoff_date(panel, mi, day))


def days_left(panel: Panel, mi: Column, day: int) -> Column:
    return working_days(F.date_add(cutoff_date(panel, mi, day), 1), panel.last_day(mi))


def first_days(df: DataFrame, panel: Panel, day: int, first: int, last: int) -> DataFrame:
    """What the first `day` days of every month first..last hold, and the rest of the month.

    Days are added up before they are listed, so the list of a month is at most as long as its days.
    """
    low, high = panel.label_of(first) + "-01", panel.label_of(last + 1) + "-01"
    rows = df.where((F.col("fecha") >= F.lit(low).cast("date")) & (F.col("fecha") < F.lit(high).cast("date")))
    daily = rows.groupBy(*SERIES, "fecha").agg(F.sum("consumo").alias("consumo"))
    seen, working = F.dayofmonth("fecha") <= day, ~is_sunday(F.col("fecha"))
    value = F.col("consumo")
    zero = F.lit(0.0)
    return daily.groupBy(*SERIES, (month_number(F.col("fecha")) - F.lit(panel.first_ym)).alias("mi")).agg(
        F.sum(F.when(seen, value).otherwise(zero)).alias("primeros"),
        F.sum(F.when(~seen, value).otherwise(zero)).alias("resto"),
        F.sum(F.when(seen & working, value).otherwise(zero)).alias("vistos"),
        F.collect_list(F.when(seen & working & (value != 0), value)).alias("valores"),
        F.count_if(seen & (value > 0)).alias("activos"),
    )


def alive_before(panel: Panel, first: int, last: int) -> DataFrame:
    """(planta, sku, mi, mes_anterior): the series that existed in the month before each month first..last.

    One aggregation per series with a column per month asked for; the panel is not densified for a few months."""
    months = range(max(first - 1, 0), last)
    value = lambda m: F.coalesce(F.sum(F.when(F.col("mi") == m, F.col("y"))), F.lit(0.0))
    past = panel.known().where(F.col("mi") < last)
    series = past.groupBy(*SERIES).agg(F.min("mi").alias("_first"), *[value(m).alias(f"_y{m}") for m in months])
    asked = F.array(*[F.struct(F.lit(m + 1).alias("mi"), F.col(f"_y{m}").alias("mes_anterior")) for m in months])
    kept = F.filter(asked, lambda x: x["mi"] > F.col("_first"))
    return series.select(*SERIES, F.explode(kept).alias("m")).select(*SERIES, "m.mi", "m.mes_anterior")


def completed(panel: Panel, base: DataFrame, seen: DataFrame, day: int) -> DataFrame:
    """`base` series with their first days, the mean and median completions and the completed month."""
    mi = F.col("mi")
    rows = base.join(seen, [*SERIES, "mi"], "left")
    fill = {c: F.coalesce(c, F.lit(0.0)) for c in ("primeros", "resto", "vistos")}
    rows = rows.withColumns({**fill, "activos": F.coalesce("activos", F.lit(0))})
    rows = rows.withColumn("dias_vistos", days_seen(panel, mi, day)).withColumn("dias_restantes", days_left(panel, mi, day))
    listed = F.coalesce("valores", F.array().cast("array<double>"))
    empty_days = F.array_repeat(F.lit(0.0), F.greatest(F.col("dias_vistos") - F.size(listed), F.lit(0)))
    median = sorted_median(F.array_sort(F.concat(listed, empty_days)))
    media = ratio(F.col("vistos"), F.col("dias_vistos")) * F.col("dias_restantes")
    business = panel.business_days(mi).cast("double")
    active = F.least(F.col("activos") / F.greatest(F.col("dias_vistos"), F.lit(1)) * business, business)
    return rows.withColumns({
        "resto_media": media,
        "resto_mediana": median * F.col("dias_restantes"),
        "mes_completado": F.col("primeros") + media,
        "dias_activos": active,
    }).drop("valores")


def completed_month(df: DataFrame, panel: Panel, mi: int, day: int) -> DataFrame:
    """(planta, sku, y, active_days): month `mi` completed from its first days, for the series alive the month before."""
    table = completed(panel, alive_before(panel, mi, mi), first_days(df, panel, day, mi, mi), day)
    return table.select(*SERIES, F.col("mes_completado").alias("y"), F.col("dias_activos").alias("active_days"))


def h1_reference(cache: DataFrame, members: list[str]) -> DataFrame:
    """(planta, sku, t, ml_mean_h1): the mean of the members one month ahead."""
    total = sum((F.col(f"p_{m}") for m in members), F.lit(0.0))
    return cache.select(*SERIES, "t", (total / float(len(members))).alias("ml_mean_h1"))


def nowcast_table(df: DataFrame, panel: Panel, first: int, last: int, day: int, h1: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """One row per month and series alive the month before: the real first days, rest and month, and every forecast of
    the rest (`resto_<model>`) and of the month (`mes_<model>`). `extra` adds `resto_<model>` columns by series and mi."""
    table = completed(panel, alive_before(panel, first, last), first_days(df, panel, day, first, last), day)
    models = ["media", "mediana"]
    if extra is not None:
        models += [c[len("resto_"):] for c in extra.columns if c.startswith("resto_")]
        table = table.join(extra, [*SERIES, "mi"], "left")
    out = [panel.label(F.col("mi")).alias("mes"), *SERIES, F.col("primeros").alias("real_primeros"), F.col("resto").alias("real_resto"), (F.col("primeros") + F.col("resto")).alias("real_mes")]
    for model in models:
        out += [F.col(f"resto_{model}"), (F.col("primeros") + F.col(f"resto_{model}")).alias(f"mes_{model}")]
    out.append(F.col("mes_anterior").alias("mes_mes_anterior"))
    if h1 is not None:
        reference = h1.withColumnRenamed("t", "mi").groupBy(*SERIES, "mi").agg(F.first("ml_mean_h1").alias("mes_ml_mean_h1"))
        table = table.join(reference, [*SERIES, "mi"], "left")
        out.append(F.col("mes_ml_mean_h1"))
    return table.select(*out)


# ---- scores --------------------------------------------------------------------------------------------------------------


def models_of(table: DataFrame, target: str) -> list[str]:
    return [c[len(target) + 1:] for c in table.columns if c.startswith(f"{target}_")]


def long_nowcast(table: DataFrame, target: str = "mes") -> DataFrame:
    """(mes, planta, sku, modelo, real, f) without missing forecasts."""
    models = models_of(table, target)
    wide = table.select("mes", *SERIES, F.col(f"real_{target}").alias("real"), *[F.col(f"{target}_{m}").alias(m) for m in models])
    return wide.unpivot(["mes", *SERIES, "real"], models, "modelo", "f").where(F.col("f").isNotNull())


def nowcast_cells(table: DataFrame, target: str = "mes") -> DataFrame:
    return long_nowcast(table, target).groupBy("mes", "planta", "modelo").agg(*error_sums(F.col("real"), F.col("f")))


def _each_and_pooled(rows: DataFrame) -> DataFrame:
    """Every month, and all of them under the label `todos`."""
    return rows.withColumn("mes", F.explode(F.array("mes", F.lit("todos"))))


def _pooled(gap: str) -> Column:
    return F.when(F.col("real") > 0, 1.0 - F.col(gap) / F.col("real"))


def global_scores(table: DataFrame, target: str = "mes") -> DataFrame:
    """Accuracy of every model by month and pooled: series, planta totals and month totals; bias = forecast / real - 1."""
    months = nowcast_cells(table, target).groupBy("mes", "modelo").agg(
        F.sum("n").alias("series"), F.sum("abs_error").alias("sku"), F.sum(F.abs(F.col("real") - F.col("pronostico"))).alias("plantas"),
        F.sum("real").alias("real"), F.sum("pronostico").alias("f"),
    )
    sums = _each_and_pooled(months.withColumn("totales", F.abs(F.col("real") - F.col("f")))).groupBy("mes", "modelo").agg(
        *[F.sum(c).alias(c) for c in ("series", "sku", "plantas", "totales", "real", "f")]
    )
    return sums.select(
        "mes", F.lit(target).alias("objetivo"), "modelo", _pooled("sku").alias("acierto_SKU"), _pooled("plantas").alias("acierto_planta"),
        _pooled("totales").alias("acierto_total"), F.when(F.col("real") > 0, F.col("f") / F.col("real") - 1.0).alias("sesgo_total"),
        F.col("f").alias("pronostico_TO"), F.col("real").alias("real_TO"), "series",
    )


def planta_scores(table: DataFrame, target: str = "mes") -> DataFrame:
    """The same per planta; plantas without real consumption are left out."""
    rows = nowcast_cells(table, target).withColumn("total", F.abs(F.col("real") - F.col("pronostico")))
    sums = _each_and_pooled(rows).groupBy("planta", "mes", "modelo").agg(
        F.sum("n").alias("series"), F.sum("abs_error").alias("sku"), F.sum("total").alias("total"), F.sum("real").alias("real"), F.sum("pronostico").alias("f")
    )
    return sums.where(F.col("real") > 0).select(
        "planta", "mes", F.lit(target).alias("objetivo"), "modelo", _pooled("total").alias("acierto_planta"), _pooled("sku").alias("acierto_SKU"),
        (F.col("f") / F.col("real") - 1.0).alias("sesgo"), F.col("f").alias("pronostico_TO"), F.col("real").alias("real_TO"), "series",
    )


def series_summary(table: DataFrame, target: str = "mes") -> DataFrame:
    """Per series over the months: real, and forecast, accuracy and bias of every model (where it has a forecast)."""
    real = F.col(f"real_{target}")
    models = models_of(table, target)
    aggregates = [F.count(F.lit(1)).alias("meses"), F.sum(real).alias(f"real_{target}_TO")]
    for m in models:
        f = F.col(f"{target}_{m}")
        aggregates += [F.sum(f).alias(f"f_{m}"), F.sum(F.abs(f - real)).alias(f"e_{m}"), F.sum(F.when(f.isNotNull(), real)).alias(f"r_{m}")]
    sums = table.groupBy(*SERIES).agg(*aggregates)
    out = [*SERIES, F.col("meses"), F.col(f"real_{target}_TO")]
    for m in models:
        some = F.col(f"r_{m}") > 0
        out += [
            F.col(f"f_{m}").alias(f"pron_{m}_TO"),
            F.when(some, 1.0 - F.col(f"e_{m}") / F.col(f"r_{m}")).alias(f"acierto_{m}"),
            F.when(some, F.col(f"f_{m}") / F.col(f"r_{m}") - 1.0).alias(f"sesgo_{m}"),
        ]
    return sums.select(*out)


def closer_counts(table: DataFrame, a: str, b: str, target: str = "mes") -> DataFrame:
    """Rows where `a` is closer to the real than `b`, where `b` is, and ties, as one row."""
    real = F.col(f"real_{target}")
    both = table.where(F.col(f"{target}_{a}").isNotNull() & F.col(f"{target}_{b}").isNotNull())
    ea, eb = F.abs(F.col(f"{target}_{a}") - real), F.abs(F.col(f"{target}_{b}") - real)
    return both.agg(F.count_if(ea < eb).alias(a), F.count_if(eb < ea).alias(b), F.count_if(ea == eb).alias("empates"), F.count(F.lit(1)).alias("total"))


def decision_criteria(rest: DataFrame, month: DataFrame, planta: DataFrame, rivals: list[str]) -> DataFrame:
    """The four criteria as (criterio, resultado, detalle), from the global scores of the rest and of the month and the
    planta scores of the month. All the inputs are tables of scores."""
    levels = ["acierto_SKU", "acierto_planta", "acierto_total"]
    pooled = rest.where(F.col("mes") == "todos")
    of = lambda test, c: F.max(F.when(test, F.col(c)))
    wins = [(of(F.col("modelo") == "media", c) >= of(F.col("modelo").isin(rivals), c) - TIE).alias(c) for c in levels]
    one = pooled.agg(*wins)
    first = one.select(F.lit(1).alias("criterio"), (F.col(levels[0]) & F.col(levels[1]) & F.col(levels[2])).alias("resultado"), F.to_json(F.struct(*levels)).alias("detalle"))

    monthly = month.where(F.col("mes") != "todos")
    media = monthly.where(F.col("modelo") == "media").select("mes", F.col("acierto_planta").alias("p"), F.col("acierto_total").alias("t"), "sesgo_total")
    ref = monthly.where(F.col("modelo") == "ml_mean_h1").select("mes", F.col("acierto_planta").alias("rp"), F.col("acierto_total").alias("rt"))
    counts = media.join(ref, "mes", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") >= F.col("rp")).alias("planta"), F.count_if(F.col("t") >= F.col("rt")).alias("total"),
        F.count_if(F.abs("sesgo_total") <= 0.05).alias("dentro"),
    )
    need = F.ceil(2 * F.col("n") / 3)
    second = counts.select(F.lit(2).alias("criterio"), ((F.col("planta") >= need) & (F.col("total") >= need)).alias("resultado"), F.format_string("planta %d/%d, total %d/%d", "planta", "n", "total", "n").alias("detalle"))
    third = counts.select(F.lit(3).alias("criterio"), (F.col("dentro") > F.col("n") / 2).alias("resultado"), F.format_string("%d/%d meses", "dentro", "n").alias("detalle"))

    by_planta = planta.where((F.col("mes") == "todos") & F.col("modelo").isin("media", "ml_mean_h1")).groupBy("planta").pivot("modelo", ["media", "ml_mean_h1"]).agg(F.first("acierto_planta"))
    worse = by_planta.agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("media") < F.col("ml_mean_h1"), F.col("planta")))), ", ").alias("d"))
    fourth = worse.select(F.lit(4).alias("criterio"), F.lit(None).cast("boolean").alias("resultado"), F.when(F.col("d") == "", "ninguna").otherwise(F.col("d")).alias("detalle"))
    return first.unionByName(second).unionByName(third).unionByName(fourth)


def volume_coverage(table: DataFrame, panel: Panel) -> DataFrame:
    """Share of each month's volume that the compared series hold."""
    compared = table.groupBy("mes").agg(F.sum("real_mes").alias("real_mes"), F.count(F.lit(1)).alias("series"))
    total = panel.total_months().select(panel.label(F.col("mi")).alias("mes"), F.col("y").alias("total"))
    return compared.join(total, "mes").withColumn("cobertura", ratio(F.col("real_mes"), F.col("total")))


def prorata_references(df: DataFrame, panel: Panel, first: int, last: int, day: int) -> DataFrame:
    """(planta, sku, mi, resto_prorata, resto_hist_rate): the first days stretched, and the rate of the last six months."""
    table = completed(panel, alive_before(panel, first, last), first_days(df, panel, day, first, last), day)
    order = Window.partitionBy(*SERIES).orderBy("mi")
    six = panel.dense().select(*SERIES, (F.col("mi") + 1).alias("mi"), F.sum("y").over(order.rowsBetween(-5, 0)).alias("seis"))
    mi = F.col("mi")
    days = sum((panel.business_days(mi - k) for k in range(1, 7)), F.lit(0))
    return table.join(six, [*SERIES, "mi"], "left").select(
        *SERIES, "mi",
        (F.col("primeros") / F.greatest(F.col("dias_vistos"), F.lit(1)) * F.col("dias_restantes")).alias("resto_prorata"),
        (F.col("seis") / days * F.col("dias_restantes")).alias("resto_hist_rate"),
    )


def cutoff_sweep(df: DataFrame, panel: Panel, first: int, last: int, days: list[int], h1: DataFrame | None = None) -> DataFrame:
    """Pooled scores of the mean and the median for several cutoff days: (objetivo, corte, modelo, scores)."""
    out = None
    for day in days:
        table = nowcast_table(df, panel, first, last, day, h1)
        for target in TARGETS:
            scores = global_scores(table, target).where((F.col("mes") == "todos") & F.col("modelo").isin("media", "mediana"))
            part = scores.select("objetivo", F.lit(day).alias("corte"), "modelo", "acierto_SKU", "acierto_planta", "acierto_total", "sesgo_total")
            out = part if out is None else out.unionByName(part)
    return out


def rest_by_planta(table: DataFrame, models: list[str]) -> DataFrame:
    """Per planta and month: series, real rest, and for every model the accuracy of the planta total and of its SKUs."""
    scores = planta_scores(table, "resto").where(F.col("mes") != "todos")
    wide = [F.max(F.when(F.col("modelo") == m, F.col(c))).alias(f"{name}_{m}") for m in models for name, c in (("planta", "acierto_planta"), ("SKU", "acierto_SKU"))]
    return scores.groupBy("mes", "planta").agg(F.max("series").alias("series"), F.max("real_TO").alias("real_resto_TO"), *wide)
