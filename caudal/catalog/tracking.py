"""Tracking of forecast runs: several runs of the members over the test months, scored against the real."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.catalog.domain import TEST_MONTHS, brand, closed, closed_panel, consumption, open_panel, shared, written_once
from caudal.catalog.registry import cte, query, r, rounded, with_
from caudal.catalog.scoring import combined
from caudal.operators import tracking as tr
from caudal.operators.month_state import detect_month_state
from caudal.operators.tracking import LEVELS, MODELS
from caudal.session import checkpoint_dir
from caudal.sources import store as st

BY = ["mes", "run_id", "estrategia"]
# (run, strategy, created, cutoff day, the member that plays ml_mean)
RUNS = [
    ("run-a", "h1", "2002-01-01 00:00:00", None, "base_mean"),
    ("run-b", "h1", "2002-02-01 00:00:00", None, "mean12"),
    ("run-c", "nowcast_media", "2002-01-15 00:00:00", 15, "mean6"),
    ("backtest-h1", "h1", "2001-12-01 00:00:00", None, "mean3"),
    ("backtest-directa", "directa", "2001-12-02 00:00:00", None, "naive"),
]
WITHOUT_BRAND, UNKNOWN_BRAND = 12, 21
RENAMED = {"lgbm": "mean3", "xgb": "mean6", "rf": "mean12", "naive": "naive"}


def forecasts(spark, sf) -> DataFrame:
    """(planta, sku, mes, run_id, estrategia, models): one brand is not forecast, another has names the data lacks."""
    panel = closed_panel(spark, sf)
    b = brand(F.col("sku"))
    sku = F.when(b == UNKNOWN_BRAND, F.concat("sku", F.lit("-X"))).otherwise(F.col("sku"))
    runs = F.explode(F.array(*[F.struct(F.lit(n).alias("run_id"), F.lit(s).alias("estrategia"), F.col(f"p_{m}").alias("ml_mean")) for n, s, _, _, m in RUNS]))
    rows = combined(spark, sf).where(b != WITHOUT_BRAND)
    return rows.select("planta", sku.alias("sku"), panel.label(F.col("t")).alias("mes"), *[F.col(f"p_{m}").alias(k) for k, m in RENAMED.items()], runs.alias("r")).select(
        "planta", "sku", "mes", "r.*", *RENAMED
    )


def when_created() -> F.Column:
    return F.coalesce(*[F.when(F.col("run_id") == n, F.lit(c)) for n, _, c, _, _ in RUNS])


def cutoff() -> F.Column:
    return F.coalesce(*[F.when(F.col("run_id") == n, F.lit(d).cast("int")) for n, _, _, d, _ in RUNS])


def scores(spark, sf) -> DataFrame:
    return written_once(spark, sf, "tracking_scores", lambda: tr.month_scores(closed_panel(spark, sf), forecasts(spark, sf), by=BY))


def rows(spark, sf) -> DataFrame:
    def build() -> DataFrame:
        found = scores(spark, sf)
        return tr.tracking_rows(found, tr.find_alerts(found, BY), BY, when_created(), cutoff())

    return written_once(spark, sf, "tracking_rows", build)


# ---- check SQL -----------------------------------------------------------------------------------------------------------

_RUNS_SQL = " union all ".join(
    f"select planta, case when starts_with(sku, 'B{UNKNOWN_BRAND}/') then sku || '-X' else sku end as sku, t, '{n}' as run_id, '{s}' as estrategia, '{c}' as creado_en, {d or 'null'}::int as corte, p_{m} as ml_mean, "
    f"{', '.join(f'p_{v} as {k}' for k, v in RENAMED.items())} from ensembled where not starts_with(sku, 'B{WITHOUT_BRAND}/')"
    for n, s, c, d, m in RUNS
)
cte("fc", ("ensembled", "cal"), f"select f.*, c.mes from ({_RUNS_SQL}) f join cal c on c.mi = f.t")
cte("fl", ("fc", "monthly"), "select f.*, coalesce(m.y, 0) as real from (" + " union all ".join(f"select planta, sku, mes, t, run_id, estrategia, '{m}' as modelo, {m} as p from fc" for m in MODELS) + ") f left join monthly m on m.planta = f.planta and m.sku = f.sku and m.mi = f.t")
cte("tp", ("fl", "pm"), """
select k.run_id, k.estrategia, k.mes, k.modelo, pm.planta, pm.y as real, coalesce(s.p, 0) as p
from (select distinct run_id, estrategia, mes, t, modelo from fl) k join pm on pm.mi = k.t
     left join (select run_id, mes, modelo, planta, sum(p) as p from fl group by 1, 2, 3, 4) s on s.run_id = k.run_id and s.mes = k.mes and s.modelo = k.modelo and s.planta = pm.planta""")
cte("tl", ("fl", "tp"), """
select 'sku' as nivel, run_id, estrategia, mes, modelo, '' as planta, real, p from fl
union all select 'planta', run_id, estrategia, mes, modelo, '', real, p from tp
union all select 'planta', run_id, estrategia, mes, modelo, planta, real, p from tp where real > 0
union all select 'total', a.run_id, a.estrategia, a.mes, a.modelo, '', a.real, b.p
from (select run_id, estrategia, mes, modelo, sum(real) as real from tp group by 1, 2, 3, 4) a join (select run_id, mes, modelo, sum(p) as p from fl group by 1, 2, 3) b using (run_id, mes, modelo)""")
cte("tsin", ("fc", "monthly"), """
select k.run_id, k.estrategia, k.mes, count(m.sku) as n, coalesce(sum(m.y), 0) as real
from (select distinct run_id, estrategia, mes, t from fc) k left join monthly m on m.mi = k.t and m.y > 0
     and not exists (select 1 from fc f where f.run_id = k.run_id and f.t = m.mi and f.planta = m.planta and f.sku = m.sku) group by 1, 2, 3""")
cte("ts", ("tl", "tsin"), """
select mes, run_id, estrategia, nivel, planta, modelo, 1 - sum(abs(real - p)) / nullif(sum(real), 0) as acierto, sum(abs(real - p)) / nullif(sum(real), 0) as wape,
       sum(real - p) / nullif(sum(real), 0) * 100 as bias_pct, count(*) as n, sum(real) as real_TO, sum(p) as pronostico_TO
from tl group by 1, 2, 3, 4, 5, 6
union all select mes, run_id, estrategia, 'sin_pronostico', '', '-', null, null, null, n, real, 0.0::double from tsin""")
cte("ta", ("ts",), f"""
select mes, run_id, estrategia, nivel || '_bajo' as codigo, 'alerta' as tipo, nivel, planta, acierto as valor, th as umbral
from (select *, case when estrategia = 'h1' then case nivel when 'sku' then 0.64 when 'planta' then 0.85 else 0.90 end else case nivel when 'sku' then 0.60 when 'planta' then 0.83 else 0.87 end end::double as th
      from ts where modelo = 'ml_mean' and planta = '') where acierto < th
union all
select a.mes, a.run_id, a.estrategia, 'peor_que_naive', 'alerta', 'sku', '', a.acierto, b.acierto
from ts a join ts b on b.run_id = a.run_id and b.mes = a.mes and b.nivel = 'sku' and b.modelo = 'naive' where a.nivel = 'sku' and a.modelo = 'ml_mean' and a.acierto < b.acierto
union all select mes, run_id, estrategia, 'planta_revisar', 'info', nivel, planta, acierto, 0.6::double from ts where modelo = 'ml_mean' and nivel = 'planta' and planta <> '' and acierto < 0.6""")
_CREATED = " ".join(f"when '{n}' then '{c}'" for n, _, c, _, _ in RUNS)
_CUT = " ".join(f"when '{n}' then {d or 'null'}" for n, _, _, d, _ in RUNS)
cte("tr", ("ts", "ta"), f"""
select ts.*, case ts.run_id {_CREATED} end as creado_en, (case ts.run_id {_CUT} end)::int as corte,
       coalesce((select string_agg(a.codigo, ';' order by list_position(['sku_bajo', 'planta_bajo', 'total_bajo', 'peor_que_naive', 'planta_revisar'], a.codigo))
                 from ta a where a.run_id = ts.run_id and a.mes = ts.mes and a.nivel = ts.nivel and a.planta = ts.planta and ts.modelo = 'ml_mean'), '') as alerta
from ts""")

_NUMBERS = ", ".join([r("acierto", "acierto"), r("wape", "wape"), r("bias_pct", "bias_pct"), "n", r("real_TO", "real_TO"), r("pronostico_TO", "pronostico_TO")])


@query("tracking_scores", with_("ts", f"select mes, run_id, estrategia, nivel, planta, modelo, {_NUMBERS} from ts"))
def tracking_scores(spark, sf):
    return rounded(scores(spark, sf))


@query("tracking_alerts", with_("ta", f"select mes, run_id, estrategia, codigo, tipo, nivel, planta, {r('valor', 'valor')}, {r('umbral', 'umbral')} from ta"))
def tracking_alerts(spark, sf):
    return rounded(tr.find_alerts(scores(spark, sf), BY))


@query("tracking_rows", with_("tr", f"select run_id, mes, nivel, planta, modelo, {_NUMBERS}, alerta, creado_en, estrategia, corte from tr"))
def tracking_rows(spark, sf):
    return rounded(rows(spark, sf))


@query("without_forecast", with_("tsin", f"select mes, run_id, estrategia, n, {r('real', 'real_TO')} from tsin"))
def without_forecast(spark, sf):
    return rounded(tr.without_forecast(closed_panel(spark, sf), forecasts(spark, sf), BY))


@query("forecast_coverage", with_("fc monthly", """
select mes, run_id, estrategia, count(m.sku) as encontradas, count(*) as series, count(m.sku) / count(*) >= 0.5 as pertenece
from fc f left join (select distinct planta, sku from monthly) m on m.planta = f.planta and m.sku = f.sku group by 1, 2, 3"""))
def forecast_coverage(spark, sf):
    return tr.forecast_coverage(closed_panel(spark, sf), forecasts(spark, sf), BY)


@query("months_closed", with_("consumption state", """
select strftime(m, '%Y-%m') as mes, l is not null as presente, n::int as dias_faltantes, coalesce(n, 1) = 0 as cerrado
from (select m, l, case when l is not null then len(list_filter(generate_series(l + interval 1 day, last_day(m)::timestamp, interval 1 day), lambda d: isodow(d) <> 7)) end as n
      from (select m, (select max(fecha) from consumption c where date_trunc('month', c.fecha) = m) as l
            from (select unnest(generate_series((month_first - interval 5 month)::timestamp, (month_first + interval 1 month)::timestamp, interval 1 month)) as m from state)))"""))
def months_closed(spark, sf):
    panel = open_panel(spark, sf)
    months = panel.months(ahead=1).where(F.col("mi") >= panel.last_mi - 5).select("mes")
    return tr.month_closed(consumption(spark, sf), months)


_PCT = {level: f"round_even(max(acierto) filter (where nivel = '{level}') * 100, 1) as {level}" for level in LEVELS}
_SHOWN = "estrategia in ('h1', 'nowcast_media', 'iterada')"
cte("hist", ("tr",), f"""
select origen, mes, estrategia, run_id, max(corte) as corte, {', '.join(_PCT.values())},
       coalesce((select string_agg(distinct c, ', ' order by c) from (select unnest(string_split(x.alerta, ';')) as c from tr x where x.run_id = k.run_id and x.mes = k.mes and x.alerta <> '')), '') as alertas
from (select *, case when starts_with(run_id, 'backtest-') then 'backtest' else 'produccion' end as origen from tr) k
where modelo = 'ml_mean' and planta = '' and {_SHOWN} and nivel in ('sku', 'planta', 'total')
      and (origen = 'backtest' or not exists (select 1 from tr z where z.mes = k.mes and z.estrategia = k.estrategia and not starts_with(z.run_id, 'backtest-') and z.creado_en > k.creado_en))
group by origen, mes, estrategia, run_id""")


@query("tracking_history", with_("hist", "select * from hist"))
def tracking_history(spark, sf):
    return tr.history(rows(spark, sf))


@query("strategy_comparison", with_("hist", f"select estrategia, origen, count(*) as meses, {', '.join(f'round_even(avg({level}), 1) as {level}' for level in LEVELS)} from hist group by 1, 2"))
def strategy_comparison(spark, sf):
    return tr.strategy_comparison(tr.history(rows(spark, sf)))


@query("tracking_production_rows", with_("tr", f"select estrategia, count(*) as filas from tr where not starts_with(run_id, 'backtest-') and {_SHOWN} group by 1"))
def tracking_production_rows(spark, sf):
    return tr.production(tr.shown(rows(spark, sf))).groupBy("estrategia").agg(F.count(F.lit(1)).alias("filas"))


def last_label(spark, sf) -> str:
    panel = closed_panel(spark, sf)
    return panel.label_of(panel.last_mi)


@query("tracking_detail_models", with_("tr", f"""
select modelo, {', '.join(_PCT.values())}, round_even(max(bias_pct) filter (where nivel = 'total'), 1) as sesgo_total_pct
from tr where run_id = 'run-b' and mes = (select max(mes) from tr) and planta = '' and nivel <> 'sin_pronostico' group by modelo"""))
def tracking_detail_models(spark, sf):
    return tr.detail_models(tr.chosen_run(rows(spark, sf), last_label(spark, sf)))


@query("tracking_detail_plantas", with_("tr", f"""
select planta, round_even(acierto * 100, 1) as acierto, {r('real_TO', 'real_TO')}, {r('pronostico_TO', 'pronostico_TO')}, {r('bias_pct', 'bias_pct')}
from tr where run_id = 'run-b' and mes = (select max(mes) from tr) and planta <> '' and modelo = 'ml_mean'"""))
def tracking_detail_plantas(spark, sf):
    return rounded(tr.detail_plantas(tr.chosen_run(rows(spark, sf), last_label(spark, sf))))


@query("tracking_other_strategies", with_("tr", f"""
select estrategia, {', '.join(_PCT.values())} from tr where run_id = 'run-c' and mes = (select max(mes) from tr) and planta = '' and modelo = 'ml_mean' group by 1"""))
def tracking_other_strategies(spark, sf):
    return tr.other_strategies(rows(spark, sf), last_label(spark, sf), "produccion", "h1")


@query("top_errors", with_("fl span", f"""
select planta, sku, {r('real', 'real')}, {r('p', 'ml_mean')}, {r('p - real', 'error')} from fl, span where t = last_mi and run_id = 'run-a' and modelo = 'ml_mean' order by abs(p - real) desc, planta, sku limit 15"""))
def top_errors(spark, sf):
    mine = forecasts(spark, sf).where((F.col("run_id") == "run-a") & (F.col("mes") == last_label(spark, sf)))
    return rounded(tr.top_errors(closed_panel(spark, sf), mine))


@query("tracking_replace", with_("tr", f"""
select run_id, mes, nivel, planta, modelo, {_NUMBERS}, alerta, creado_en, estrategia, corte from tr where not (run_id = 'run-a' and mes = (select max(mes) from tr))
union all
select run_id, mes, nivel, planta, modelo, {_NUMBERS}, 'nuevo', creado_en, 'h1', null::int from tr where run_id = 'run-a' and mes = (select max(mes) from tr)"""))
def tracking_replace(spark, sf):
    old = rows(spark, sf)
    new = old.where((F.col("run_id") == "run-a") & (F.col("mes") == last_label(spark, sf))).withColumn("alerta", F.lit("nuevo")).drop("estrategia", "corte")
    return rounded(tr.replace_tracking(old, new))


@query("tracking_scan", with_("tr", f"""
select run_id, mes, nivel, planta, modelo, {r("case when nivel <> 'total' then acierto end", 'acierto')}, {r('wape', 'wape')}, {r('bias_pct', 'bias_pct')}, n, {r('real_TO', 'real_TO')}, {r('pronostico_TO', 'pronostico_TO')},
       alerta, creado_en, 'h1' as estrategia, null::int as corte from tr"""))
def tracking_scan(spark, sf):
    """A history from before the strategies, with infinities and missing texts, read in the current shape."""
    old = rows(spark, sf).drop("estrategia", "corte").withColumns({
        "acierto": F.when(F.col("nivel") == "total", F.lit(float("inf"))).otherwise(F.col("acierto")),
        "planta": F.nullif(F.col("planta"), F.lit("")), "alerta": F.nullif(F.col("alerta"), F.lit("")),
    })
    return rounded(tr.with_defaults(old))


@query("last_tracking", with_("hist", """
select mes, estrategia, origen, sku, planta, total, alertas from hist where origen = 'produccion' and estrategia = 'h1' order by mes desc limit 1"""))
def last_tracking(spark, sf):
    return tr.last_tracking(tr.shown(rows(spark, sf)))


def saved(spark, sf) -> DataFrame:
    """(mes, estrategia) of the saved forecasts: the test months and the open month."""
    panel = open_panel(spark, sf)
    months = panel.months().where(F.col("mi") > panel.last_mi - TEST_MONTHS - 2).select("mes")
    return months.select("mes", F.explode(F.array(F.lit("h1"), F.lit("iterada"))).alias("estrategia"))


@query("tracking_pending", with_("tr cal span state", f"""
select c.mes, e.estrategia from cal c cross join span cross join state cross join (values ('h1'), ('iterada')) e(estrategia)
where c.mi > span.last_mi - {TEST_MONTHS + 1} - case when days_left > 0 then 0 else 1 end and c.mi <= span.last_mi
      and not exists (select 1 from tr where tr.mes = c.mes and tr.estrategia = e.estrategia and not starts_with(run_id, 'backtest-'))"""))
def tracking_pending(spark, sf):
    mine = saved(spark, sf)
    last = detect_month_state(consumption(spark, sf)).last_complete
    return tr.to_measure(mine, rows(spark, sf), mine.select("mes", (F.col("mes") <= last).alias("cerrado")))


@query("backtest_forecast_tables", with_("ensembled cal", f"""
select e.planta, e.sku, c.mes, {r('p_base_mean', 'ml_mean')}, {r('p_naive', 'naive')} from ensembled e join cal c on c.mi = e.t"""))
def backtest_forecast_tables(spark, sf):
    return rounded(tr.forecast_tables(combined(spark, sf), closed_panel(spark, sf), {"ml_mean": "p_base_mean", "naive": "p_naive"}))


@query("tracking_end_to_end", with_("tr closed", f"""select run_id, mes, nivel, planta, modelo, {_NUMBERS}, alerta, creado_en, estrategia, corte from tr
where run_id = 'run-c' and (select len(list_filter(generate_series(max(fecha) + interval 1 day, last_day(max(fecha))::timestamp, interval 1 day), lambda d: isodow(d) <> 7)) from closed where strftime(fecha, '%Y-%m') = tr.mes) = 0"""))
def tracking_end_to_end(spark, sf):
    mine = forecasts(spark, sf).where(F.col("run_id") == "run-c")
    return rounded(tr.track(closed(spark, sf), closed_panel(spark, sf), mine, BY, when_created(), cutoff()))


@query("strategy_of_saved", with_("tr", """
select distinct archivo, case when n = 1 then 'parcial' when n = 2 then 'nowcast_media' else 'h1' end as estrategia, case when n = 1 then 15 end::int as corte
from (select 'forecast_' || mes || case when run_id = 'run-c' then '_nowcast_media' else '' end as archivo,
             case when run_id = 'run-b' and mes = (select max(mes) from tr) then 1 when run_id = 'run-c' then 2 else 0 end as n from tr)"""))
def strategy_of_saved(spark, sf):
    last = last_label(spark, sf)
    files = rows(spark, sf).select("run_id", "mes").distinct().select(
        F.concat(F.lit("forecast_"), "mes", F.when(F.col("run_id") == "run-c", F.lit("_nowcast_media")).otherwise(F.lit(""))).alias("archivo"),
        F.when((F.col("run_id") == "run-b") & (F.col("mes") == last), F.to_json(F.struct(F.struct(F.lit("parcial").alias("used"), F.lit(15).alias("cutoff_day")).alias("strategy")))).alias("manifiesto"),
    ).distinct()
    return tr.strategy_of(files)


# A written history in which the bias of the total of one run is no number and the rows of a month have lost their model.
_DAMAGED = "(run_id = 'run-a' and nivel = 'total') or (run_id = 'run-b' and mes = (select min(mes) from tr))"


def damaged_csv(spark, sf) -> str:
    def build() -> str:
        history = rows(spark, sf)
        first = history.agg(F.min("mes")).first()[0]
        text = history.select(*[F.col(c).cast("string").alias(c) for c in history.columns]).withColumns({
            "bias_pct": F.when((F.col("run_id") == "run-a") & (F.col("nivel") == "total"), F.lit("no es un número")).otherwise(F.col("bias_pct")),
            "modelo": F.when((F.col("run_id") == "run-b") & (F.col("mes") == first), F.lit(None)).otherwise(F.col("modelo")),
        })
        path = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{sf.rstrip('/').rsplit('/', 1)[-1]}/tracking.csv"
        text.write.mode("overwrite").option("header", True).csv(path)
        return path

    return shared(spark, sf, "tracking_csv", build)


@query("tracking_from_csv", with_("tr", f"select run_id, mes, nivel, planta, modelo, {_NUMBERS}, alerta, creado_en, estrategia, corte from tr where not ({_DAMAGED})"))
def tracking_from_csv(spark, sf):
    return rounded(st.tracking_from_csv(spark, damaged_csv(spark, sf))[0])


@query("tracking_csv_lines", with_("tr", f"select count(*) as lineas from tr where {_DAMAGED}"))
def tracking_csv_lines(spark, sf):
    return st.tracking_from_csv(spark, damaged_csv(spark, sf))[1].agg(F.count(F.lit(1)).alias("lineas"))
