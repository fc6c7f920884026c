"""Selections, series, top-k reports and forecast details."""

from __future__ import annotations

from pyspark.sql import functions as F

from caudal.catalog.domain import OPEN, closed, closed_panel, consumption, open_panel
from caudal.catalog.loading import last_forecast, stored
from caudal.catalog.registry import query, r, rounded, with_
from caudal.catalog.tracking import rows as tracking_history_rows
from caudal.functions.text import normalized
from caudal.operators import explore as xp
from caudal.operators import tracking as tr
from caudal.operators.month_state import month_state
from caudal.sources import store as st

PLANTA = "EUROPE"


@query("select_planta", with_("consumption", f"select sku, count(*) as filas, sum(consumo) as consumo from consumption where planta = '{PLANTA}' group by sku"))
def select_planta(spark, sf):
    return xp.select(consumption(spark, sf), PLANTA).groupBy("sku").agg(F.count(F.lit(1)).alias("filas"), F.sum("consumo").alias("consumo"))


@query("selection_monthly", with_("pm cal", f"select mi::int as mi, cal.mes, {r('y', 'consumo')} from pm join cal using (mi) where planta = '{PLANTA}'", **OPEN))
def selection_monthly(spark, sf):
    return rounded(xp.monthly(open_panel(spark, sf), PLANTA))


@query("selection_summary", with_("pm cal span state", f"""
select round_even(sum(y), 1) as "total_TO", round_even(avg(y) filter (where done), 1) as "promedio_mensual_TO", max_by(mes, mi) filter (where done) as ultimo_mes_completo,
       round_even(max_by(y, mi) filter (where done), 1) as "ultimo_mes_TO", round_even((max_by(y, mi) filter (where done) / max_by(prev, mi) filter (where done) - 1) * 100, 1) as cambio_vs_mes_anterior_pct, min(mes) as primer_mes
from (select pm.y, pm.mi, cal.mes, lag(pm.y) over (order by pm.mi) as prev, not (days_left > 0 and pm.mi = last_mi) as done from pm join cal on cal.mi = pm.mi cross join span cross join state where planta = '{PLANTA}')""", **OPEN))
def selection_summary(spark, sf):
    return xp.monthly_summary(open_panel(spark, sf), PLANTA)


@query("daily_range", with_("fact", f"""
select d as fecha, coalesce(sum(f.consumo), 0)::double as consumo
from (select cast(unnest(generate_series(max(fecha) - interval 89 day, max(fecha)::timestamp, interval 1 day)) as date) as d from fact) k left join fact f on f.fecha = k.d and f.planta = '{PLANTA}' group by d""", **OPEN))
def daily_range(spark, sf):
    return xp.daily(consumption(spark, sf), open_panel(spark, sf), PLANTA)


@query("top_series_otros", with_("monthly", f"""
select case when pos <= 7 then m.sku else 'Otros' end as nombre, mi::int as mi, {r('sum(y)', 'consumo')}
from monthly m join (select sku, row_number() over (order by sum(y) desc, sku) as pos from monthly where planta = '{PLANTA}' group by sku) k on k.sku = m.sku
where m.planta = '{PLANTA}' group by 1, 2""", **OPEN))
def top_series_otros(spark, sf):
    return rounded(xp.breakdown(open_panel(spark, sf), PLANTA))


@query("top_plantas_otros", with_("monthly", f"""
select case when pos <= 3 then m.planta else 'Otros' end as nombre, mi::int as mi, {r('sum(y)', 'consumo')}
from monthly m join (select planta, row_number() over (order by sum(y) desc, planta) as pos from monthly group by planta) k on k.planta = m.planta group by 1, 2""", **OPEN))
def top_plantas_otros(spark, sf):
    return rounded(xp.breakdown(open_panel(spark, sf), top=3))


@query("data_overview", with_("consumption state", """
select count(*) as filas, count(distinct planta || '|' || sku) as series, count(distinct planta) as plantas, min(fecha) as primer_dia, max(fecha) as ultimo_dia,
       max(case when days_left > 0 then strftime(state.last_day, '%Y-%m') end) as mes_parcial, max(strftime(complete_end, '%Y-%m')) as ultimo_mes_completo
from consumption cross join state"""))
def data_overview(spark, sf):
    return xp.overview(consumption(spark, sf))


# Every month that the given tables can hold, so that both sides have the same columns at every size.
PIVOT_MONTHS = [f"{year}-{month:02d}" for year in range(1992, 2004) for month in range(1, 13)]


@query("monthly_pivot", with_("panel cal", f"""
select planta, sku, {', '.join(f"round_even(sum(y) filter (where mes = '{m}'), 3) as \"{m}\"" for m in PIVOT_MONTHS)}
from (select planta, sku, cal.mes, y from panel join cal using (mi)) group by planta, sku"""))
def monthly_pivot(spark, sf):
    return xp.monthly_pivot(closed_panel(spark, sf), labels=PIVOT_MONTHS)


@query("month_actuals", with_("firsts monthly span", f"select f.planta, f.sku, {r('coalesce(m.y, 0)', 'real')} from firsts f cross join span left join monthly m on m.planta = f.planta and m.sku = f.sku and m.mi = last_mi"))
def month_actuals(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(xp.month_actuals(panel, panel.last_mi))


@query("distinct_names", with_("consumption", f"select distinct planta as nombre, 'planta' as tipo from consumption union all select distinct sku, 'sku' from consumption where planta = '{PLANTA}'"))
def distinct_names(spark, sf):
    df = consumption(spark, sf)
    return xp.names(df, "planta").withColumn("tipo", F.lit("planta")).unionByName(xp.names(df, "sku", PLANTA).withColumn("tipo", F.lit("sku")))


@query("normalized_names", with_("consumption", "select distinct sku as nombre, trim(regexp_replace(lower(sku), '[^a-z0-9]+', ' ', 'g')) as limpio from consumption"))
def normalized_names(spark, sf):
    return xp.names(consumption(spark, sf), "sku").withColumn("limpio", normalized(F.col("nombre")))


@query("name_suggestions", with_("consumption", """
select nombre, round(puntos + 3e-10, 6) + 0.0::double as puntos from (
  select nombre, case when starts_with(n, 'b13 01') then 900 - length(n) / 1000 when n like '%b13%' and n like '%01%' then 700 - length(n) / 1000 end as puntos
  from (select distinct sku as nombre, trim(regexp_replace(lower(sku), '[^a-z0-9]+', ' ', 'g')) as n from consumption))
where puntos is not null order by puntos desc, nombre limit 8"""))
def name_suggestions(spark, sf):
    return rounded(xp.suggest(xp.names(consumption(spark, sf), "sku"), "B13/01"))


@query("name_suggestions_typo", with_("consumption", f"""
select nombre, {r('500 * max(s)', 'puntos')} from (
  select nombre, 1 - levenshtein('eurpoe', w) / greatest(6, length(w))::double as s from (select nombre, unnest(string_split(lower(nombre), ' ')) as w from (select distinct planta as nombre from consumption)))
group by nombre having max(s) >= 0.6"""))
def name_suggestions_typo(spark, sf):
    return rounded(xp.suggest(xp.names(consumption(spark, sf), "planta"), "eurpoe"))


@query("resolve_name", with_("consumption", "select distinct planta as nombre from consumption where lower(planta) = 'middle east'"))
def resolve_name(spark, sf):
    return xp.resolve(xp.names(consumption(spark, sf), "planta"), "Míddle  East")


@query("retune_state", with_("consumption", """
select planta, sku, cast(l + interval 6 month as date) as proximo, (cast(l + interval 6 month as date) - hoy)::int as dias_restantes,
       case when cast(l + interval 6 month as date) < hoy then 'vencido' when cast(l + interval 6 month as date) - hoy <= 30 then 'por_vencer' else 'al_dia' end as estado
from (select planta, sku, max(fecha) as l, (select max(fecha) from consumption) as hoy from consumption group by 1, 2)"""))
def retune_state(spark, sf):
    last = consumption(spark, sf).groupBy("planta", "sku").agg(F.max("fecha").alias("l"))
    today = open_panel(spark, sf).calendar_end
    return last.select("planta", "sku", *xp.retune_state(F.col("l"), F.lit(today)))


# ---- forecasts -----------------------------------------------------------------------------------------------------------


@query("forecast_totals", with_("lastf", f"select {', '.join(r(f'sum({m})', m) for m in ('lgbm', 'xgb', 'rf', 'ml_mean', 'naive'))}, count(*) as series, {r('least(sum(lgbm), sum(xgb), sum(rf))', 'minimo')}, {r('greatest(sum(lgbm), sum(xgb), sum(rf))', 'maximo')} from lastf"))
def forecast_totals(spark, sf):
    return rounded(xp.forecast_totals(last_forecast(spark, sf)))


@query("forecast_by_planta", with_("lastf pm span", f"""
select f.planta, {', '.join(r(f'sum({m})', m) for m in ('ml_mean', 'lgbm', 'xgb', 'rf'))}, count(*) as series, {r('max(p.y)', 'real')}, {r('case when max(p.y) <> 0 then (sum(ml_mean) / max(p.y) - 1) * 100 end', 'cambio_pct')}
from lastf f cross join span join pm p on p.planta = f.planta and p.mi = last_mi - 1 group by f.planta"""))
def forecast_by_planta(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(xp.forecast_by_planta(last_forecast(spark, sf), panel, panel.last_mi - 1))


_BY_SKU = f"""
select f.planta, f.sku, {r('ml_mean', 'ml_mean')}, {r('least(lgbm, xgb, rf)', 'minimo')}, {r('greatest(lgbm, xgb, rf)', 'maximo')}, {r('naive', 'naive')}, {r('coalesce(m.y, 0)', 'real')},
       {r('case when coalesce(m.y, 0) <> 0 then (ml_mean / m.y - 1) * 100 end', 'cambio_pct')}
from lastf f cross join span left join monthly m on m.planta = f.planta and m.sku = f.sku and m.mi = last_mi - 1"""


@query("forecast_top_skus", with_("lastf monthly span", f"{_BY_SKU} order by f.ml_mean desc, f.planta, f.sku limit 50"))
def forecast_top_skus(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(xp.forecast_by_sku(last_forecast(spark, sf), panel, panel.last_mi - 1))


@query("forecast_export", with_("lastf monthly span", _BY_SKU))
def forecast_export(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(xp.forecast_by_sku(last_forecast(spark, sf), panel, panel.last_mi - 1, limit=None))


@query("forecast_against_real", with_("lastf monthly span", f"""
select f.planta, count(*) as series, {r('sum(ml_mean)', 'ml_mean')}, {r('sum(coalesce(m.y, 0))', 'real')}, {r('sum(abs(coalesce(m.y, 0) - ml_mean))', 'error_abs')}
from lastf f cross join span left join monthly m on m.planta = f.planta and m.sku = f.sku and m.mi = last_mi group by f.planta"""))
def forecast_against_real(spark, sf):
    """A forecast made as of an earlier month against the real that came later."""
    rows = tr.with_real(closed_panel(spark, sf), last_forecast(spark, sf))
    gap = F.abs(F.col("real") - F.col("ml_mean"))
    return rounded(rows.groupBy("planta").agg(F.count(F.lit(1)).alias("series"), F.sum("ml_mean").alias("ml_mean"), F.sum("real").alias("real"), F.sum(gap).alias("error_abs")))


@query("forecast_history", with_("storep hist", f"""
select s.mes, s.estrategia, {r('s.total', 'total_TO')}, s.series, s.creado_en, h.sku, h.planta, h.total
from (select mes_objetivo as mes, estrategia, sum(valor) as total, count(*) as series, max(creado_en) as creado_en from storep where modelo = 'ml_mean' group by 1, 2) s
     left join hist h on h.mes = s.mes and h.estrategia = s.estrategia and h.origen = 'produccion'"""))
def forecast_history(spark, sf):
    saved = st.catalogue(st.read_predictions(spark, stored(spark, sf)))
    return rounded(xp.forecast_history(saved, tr.history(tracking_history_rows(spark, sf))))


@query("reference_months", with_("cal span state", """
select mes, case when before <= strftime(complete_end, '%Y-%m') then before else strftime(complete_end, '%Y-%m') end as referencia
from (select c.mes, p.mes as before from cal c join cal p on p.mi = c.mi - 1 cross join span where c.mi <= last_mi + 2) cross join state""", **OPEN))
def reference_months(spark, sf):
    panel = open_panel(spark, sf)
    last = month_state(consumption(spark, sf)).first()["last_complete"]
    months = panel.months(ahead=2).where(F.col("mi") >= 1)
    return months.select("mes", xp.reference_month(F.col("mes"), F.lit(last)).alias("referencia"))


@query("home_summary", with_("consumption state storep hist", """
select (select count(*) from consumption) as filas, strftime(complete_end, '%Y-%m') as ultimo_mes_completo, (select max(mes_objetivo) from storep where modelo = 'ml_mean') as ultimo_pronostico,
       (select max(mes) from hist where origen = 'produccion' and estrategia = 'h1') as ultimo_seguimiento from state"""))
def home_summary(spark, sf):
    """The one-row summaries of the data, the forecasts and the tracking side by side."""
    key = F.lit(1).alias("_k")
    data = xp.overview(consumption(spark, sf)).select(key, "filas", "ultimo_mes_completo")
    saved = st.catalogue(st.read_predictions(spark, stored(spark, sf))).agg(F.max("mes").alias("ultimo_pronostico")).select(key, "ultimo_pronostico")
    tracked = tr.last_tracking(tr.shown(tracking_history_rows(spark, sf))).select(key, F.col("mes").alias("ultimo_seguimiento"))
    return data.join(saved, "_k", "left").join(tracked, "_k", "left").drop("_k")
