"""Month in progress: state, strategy, completions, backtest scores and the expected rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from caudal.catalog.domain import OPEN, closed, closed_panel, consumption, members, open_panel, written_once
from caudal.catalog.registry import cte, query, r, rounded, with_
from caudal.operators import nowcast as nc
from caudal.operators import scenarios as sc
from caudal.operators.month_state import month_state, resolve_columns, up_to_month

MONTHS = 9
DAY = 15
H1 = ["naive", "mean3", "mean6"]
NC_MODELS = ["media", "mediana", "mes_anterior", "ml_mean_h1"]


def backtest(spark, sf):
    """The nowcast table of the last months, kept for the queries that score it."""

    def build():
        panel = closed_panel(spark, sf)
        table = nc.nowcast_table(closed(spark, sf), panel, panel.last_mi - MONTHS + 1, panel.last_mi, DAY, nc.h1_reference(members(spark, sf), H1))
        return table

    return written_once(spark, sf, "nowcast_backtest", build)


def nc_ctes(day: int = DAY, months: str = f"c.mi > span.last_mi - {MONTHS}") -> dict:
    return {
        "ncw": (("days",), f"select mi, count(*) filter (where isodow(d) <> 7 and day(d) <= {day}) as nseen, count(*) filter (where isodow(d) <> 7 and day(d) > {day}) as nleft from days group by mi"),
        "nc0": (("panel", "cal", "ncw", "fact", "span"), f"""
select p.planta, p.sku, c.mi, c.mes, c.b, p.y as anterior, w.nseen, w.nleft,
       coalesce(sum(f.consumo) filter (where day(f.fecha) <= {day}), 0) as primeros, coalesce(sum(f.consumo) filter (where day(f.fecha) > {day}), 0) as resto,
       coalesce(sum(f.consumo) filter (where day(f.fecha) <= {day} and isodow(f.fecha) <> 7), 0) as vistos,
       coalesce(list(f.consumo) filter (where day(f.fecha) <= {day} and isodow(f.fecha) <> 7), []) as valores,
       count(*) filter (where day(f.fecha) <= {day} and f.consumo > 0) as activos
from panel p cross join span join cal c on c.mi = p.mi + 1 join ncw w on w.mi = c.mi
     left join fact f on f.planta = p.planta and f.sku = p.sku and year(f.fecha) * 12 + month(f.fecha) - 1 - span.y0 = c.mi
where {months} and c.mi <= span.last_mi
group by all"""),
        "nc": (("nc0",), """
select *, vistos / nseen * nleft as media,
       list_aggregate(list_concat(valores, list_transform(range(nseen - len(valores)), lambda x: 0.0::double)), 'median') * nleft as mediana from nc0"""),
    }


def _register(ctes: dict) -> None:
    for name, (needs, body) in ctes.items():
        cte(name, needs, body)


_register(nc_ctes())
cte("nct", ("nc", "members"), f"""
select nc.*, primeros + resto as real_mes, primeros + media as mes_media, primeros + mediana as mes_mediana, anterior as mes_mes_anterior,
       ({' + '.join('m.p_' + m for m in H1)}) / {len(H1)} as mes_ml_mean_h1
from nc left join members m on m.planta = nc.planta and m.sku = nc.sku and m.t = nc.mi""")


def nl(target: str) -> dict:
    models = NC_MODELS if target == "mes" else ["media", "mediana"]
    real = "real_mes" if target == "mes" else "resto"
    column = (lambda m: f"mes_{m}") if target == "mes" else (lambda m: m)
    return {"nl": (("nct",), " union all ".join(f"select mes, planta, sku, '{m}' as modelo, {real} as real, {column(m)} as f from nct where {column(m)} is not null" for m in models))}


cte("lab", ("nl",), "select *, mes as label from nl union all select *, 'todos' from nl")
_GLOBAL = f"""
select s.label as mes, '{{target}}' as objetivo, s.modelo, {r('case when s.real > 0 then 1 - s.ae / s.real end', 'acierto_SKU')}, {r('case when s.real > 0 then 1 - p.ae / s.real end', 'acierto_planta')},
       {r('case when s.real > 0 then 1 - t.ae / s.real end', 'acierto_total')}, {r('case when s.real > 0 then s.f / s.real - 1 end', 'sesgo_total')},
       {r('s.f', 'pronostico_TO')}, {r('s.real', 'real_TO')}, s.series
from (select label, modelo, sum(abs(real - f)) as ae, sum(real) as real, sum(f) as f, count(*) as series from lab group by 1, 2) s
     join (select label, modelo, sum(abs(x)) as ae from (select label, modelo, mes, planta, sum(real) - sum(f) as x from lab group by 1, 2, 3, 4) group by 1, 2) p using (label, modelo)
     join (select label, modelo, sum(abs(x)) as ae from (select label, modelo, mes, sum(real) - sum(f) as x from lab group by 1, 2, 3) group by 1, 2) t using (label, modelo)"""
_PLANTA = f"""
select s.planta, s.label as mes, '{{target}}' as objetivo, s.modelo, {r('1 - p.ae / s.real', 'acierto_planta')}, {r('1 - s.ae / s.real', 'acierto_SKU')}, {r('s.f / s.real - 1', 'sesgo')},
       {r('s.f', 'pronostico_TO')}, {r('s.real', 'real_TO')}, s.series
from (select planta, label, modelo, sum(abs(real - f)) as ae, sum(real) as real, sum(f) as f, count(*) as series from lab group by 1, 2, 3) s
     join (select planta, label, modelo, sum(abs(x)) as ae from (select planta, label, modelo, mes, sum(real) - sum(f) as x from lab group by 1, 2, 3, 4) group by 1, 2, 3) p using (planta, label, modelo)
where s.real > 0"""

_STATE = """
select case when days_left = 0 then 'complete' else 'in_progress' end as status, last_day as last_date, strftime(last_day, '%Y-%m') as month,
       strftime(complete_end, '%Y-%m') as last_complete, case when days_left > 0 then day(last_day)::int end as cutoff_day,
       len(list_filter(generate_series(month_first::timestamp, last_day::timestamp, interval 1 day), lambda d: isodow(d) <> 7))::int as days_seen, days_left::int as days_left
from state"""


@query("month_state", with_("state", _STATE))
def month_state_(spark, sf):
    return month_state(consumption(spark, sf))


@query("month_state_closed", with_("closed", """
select 'complete' as status, (select max(fecha) from closed) as last_date, strftime(complete_end, '%Y-%m') as month, strftime(complete_end, '%Y-%m') as last_complete from state"""))
def month_state_closed(spark, sf):
    return month_state(closed(spark, sf)).select("status", "last_date", "month", "last_complete")


@query("month_state_by_planta", with_("consumption", """
select planta, case when n = 0 then 'complete' else 'in_progress' end as status, l as last_date, strftime(l, '%Y-%m') as month, n::int as days_left
from (select planta, max(fecha) as l, len(list_filter(generate_series(max(fecha) + interval 1 day, last_day(max(fecha))::timestamp, interval 1 day), lambda d: isodow(d) <> 7)) as n
      from consumption group by planta)"""))
def month_state_by_planta(spark, sf):
    return month_state(consumption(spark, sf), ["planta"]).select("planta", "status", "last_date", "month", "days_left")


@query("strategy_plan", with_("state", """
select case when days_left > 0 then 'nowcast_media' else 'h1' end as strategy, case when days_left > 0 then day(last_day)::int end as plan_cutoff_day,
       strftime(complete_end, '%Y-%m') as origin, strftime(complete_end + case when days_left > 0 then interval 35 day else interval 5 day end, '%Y-%m') as target,
       days_left > 0 and day(last_day) < 10 as few_days, true as cutoff_ok
from state"""))
def strategy_plan(spark, sf):
    return month_state(consumption(spark, sf)).select(*resolve_columns())


@query("as_of_month", with_("closed", "select planta, count(*) as filas, max(fecha) as ultimo, sum(consumo) as consumo from closed where fecha <= date '1999-06-30' group by planta"))
def as_of_month(spark, sf):
    return up_to_month(closed(spark, sf), "1999-06").groupBy("planta").agg(F.count(F.lit(1)).alias("filas"), F.max("fecha").alias("ultimo"), F.sum("consumo").alias("consumo"))


_TABLE = ", ".join([r("primeros", "real_primeros"), r("resto", "real_resto"), r("real_mes", "real_mes"), r("media", "resto_media"), r("mes_media", "mes_media"),
                    r("mediana", "resto_mediana"), r("mes_mediana", "mes_mediana"), r("mes_mes_anterior", "mes_mes_anterior"), r("mes_ml_mean_h1", "mes_ml_mean_h1")])


@query("nowcast_table", with_("nct", f"select mes, planta, sku, {_TABLE} from nct"))
def nowcast_table(spark, sf):
    return rounded(backtest(spark, sf))


@query("nowcast_completed_month", with_("nc", f"""
select planta, sku, {r('primeros + media', 'y')}, {r('least(activos / greatest(nseen, 1) * b, b)', 'active_days')} from nc""", **nc_ctes(months="c.mi = span.last_mi")))
def nowcast_completed_month(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(nc.completed_month(closed(spark, sf), panel, panel.last_mi, DAY))


@query("pseudo_month_panel", with_("nc monthly span", f"""
select planta, mi, {r('sum(y)', 'y')}
from (select planta, mi, y from monthly, span where mi < last_mi union all select planta, mi, primeros + media from nc) group by planta, mi""", **nc_ctes(months="c.mi = span.last_mi")))
def pseudo_month_panel(spark, sf):
    panel = closed_panel(spark, sf)
    estimate = nc.completed_month(closed(spark, sf), panel, panel.last_mi, DAY)
    filled = panel.with_month(panel.last_mi, estimate)
    present = filled.known().select("planta", "mi").distinct()
    return rounded(filled.planta_months().join(present, ["planta", "mi"], "left_semi"))


@query("month_in_progress", with_("state consumption", f"""
select planta, {r('coalesce(sum(consumo) filter (where fecha >= month_first), 0)', 'real_hasta_corte_TO')},
       {r("coalesce(sum(consumo) filter (where fecha >= month_first and isodow(fecha) <> 7), 0) / max(seen) * max(days_left)", 'resto_estimado_TO')}
from (select c.*, s.*, len(list_filter(generate_series(month_first::timestamp, s.last_day::timestamp, interval 1 day), lambda d: isodow(d) <> 7)) as seen
      from consumption c cross join state s where exists (select 1 from consumption a where a.planta = c.planta and a.sku = c.sku and a.fecha < s.month_first))
group by planta"""))
def month_in_progress(spark, sf):
    """The open month so far and the estimate of its rest, by planta, for the series known before it."""
    panel = open_panel(spark, sf).completed_calendar()
    mi, day = panel.last_mi, panel_day(open_panel(spark, sf))
    table = nc.completed(panel, nc.alive_before(panel, mi, mi), nc.first_days(consumption(spark, sf), panel, day, mi, mi), day)
    return rounded(table.groupBy("planta").agg(F.sum("primeros").alias("real_hasta_corte_TO"), F.sum("resto_media").alias("resto_estimado_TO")))


def panel_day(panel) -> int:
    return panel.calendar_end.day


for _target in nc.TARGETS:
    query(f"nowcast_global_scores_{_target}", with_("lab", _GLOBAL.format(target=_target), **nl(_target)))(
        lambda spark, sf, target=_target: rounded(nc.global_scores(backtest(spark, sf), target))
    )
    query(f"nowcast_planta_scores_{_target}", with_("lab", _PLANTA.format(target=_target), **nl(_target)))(
        lambda spark, sf, target=_target: rounded(nc.planta_scores(backtest(spark, sf), target))
    )


_SUMMARY = ", ".join(
    f"{r(f'sum(mes_{m})', f'pron_{m}_TO')}, {r(f'case when sum(real_mes) filter (where mes_{m} is not null) > 0 then 1 - sum(abs(mes_{m} - real_mes)) / sum(real_mes) filter (where mes_{m} is not null) end', f'acierto_{m}')}, "
    f"{r(f'case when sum(real_mes) filter (where mes_{m} is not null) > 0 then sum(mes_{m}) / sum(real_mes) filter (where mes_{m} is not null) - 1 end', f'sesgo_{m}')}"
    for m in NC_MODELS
)


@query("nowcast_series_summary", with_("nct", f"select planta, sku, count(*) as meses, {r('sum(real_mes)', 'real_mes_TO')}, {_SUMMARY} from nct group by planta, sku"))
def nowcast_series_summary(spark, sf):
    return rounded(nc.series_summary(backtest(spark, sf)))


@query("nowcast_closer_counts", with_("nct", """
select count(*) filter (where round(abs(mes_media - real_mes), 9) < round(abs(mes_ml_mean_h1 - real_mes), 9)) as media, count(*) filter (where round(abs(mes_media - real_mes), 9) > round(abs(mes_ml_mean_h1 - real_mes), 9)) as ml_mean_h1,
       count(*) filter (where round(abs(mes_media - real_mes), 9) = round(abs(mes_ml_mean_h1 - real_mes), 9)) as empates, count(*) as total
from nct where mes_ml_mean_h1 is not null"""))
def nowcast_closer_counts(spark, sf):
    return nc.closer_counts(backtest(spark, sf), "media", "ml_mean_h1")


_DECISION = {
    "gs": (("lab",), """
select label as mes, modelo, 1 - sum(abs(x)) / sum(real) as p, 1 - abs(sum(x)) / sum(real) as t, sum(f) / sum(real) - 1 as s
from (select label, modelo, planta, sum(real) - sum(f) as x, sum(real) as real, sum(f) as f from lab where label <> 'todos' group by 1, 2, 3) group by 1, 2"""),
    "counted": (("gs",), """
select count(*) as n, count(*) filter (where a.p >= b.p) as planta, count(*) filter (where a.t >= b.t) as total, count(*) filter (where abs(a.s) <= 0.05) as dentro
from gs a left join gs b on b.mes = a.mes and b.modelo = 'ml_mean_h1' where a.modelo = 'media'"""),
}


@query("nowcast_decision_criteria", with_("counted", """
select 2 as criterio, planta >= ceil(2 * n / 3) and total >= ceil(2 * n / 3) as resultado, format('planta {}/{}, total {}/{}', planta, n, total, n) as detalle from counted
union all select 3, dentro > n / 2, format('{}/{} meses', dentro, n) from counted""", **nl("mes"), **_DECISION))
def nowcast_decision_criteria(spark, sf):
    table = backtest(spark, sf)
    all_four = nc.decision_criteria(nc.global_scores(table, "resto"), nc.global_scores(table, "mes"), nc.planta_scores(table, "mes"), ["mediana"])
    return all_four.where(F.col("criterio").isin(2, 3))


@query("nowcast_decision_all")
def nowcast_decision_all(spark, sf):
    """The four criteria with the expected rest among the rivals."""
    table = with_expected(spark, sf)
    return nc.decision_criteria(nc.global_scores(table, "resto"), nc.global_scores(table, "mes"), nc.planta_scores(table, "mes"), ["mediana", *EXPECTED])


_SWEEP = " union all ".join(
    f"""select 'resto' as objetivo, {day} as corte, '{m}' as modelo, resto as real, {f} as f, mes, planta from nc{day} union all
select 'mes', {day}, '{m}', primeros + resto, primeros + {f}, mes, planta from nc{day}"""
    for day in (10, 15, 20) for m, f in (("media", "media"), ("mediana", "mediana"))
)
_SWEEP_CTES = {}
for _day in (10, 15, 20):
    for _name, (_needs, _body) in nc_ctes(_day).items():
        _SWEEP_CTES[_name + str(_day)] = (tuple(n + str(_day) if n in ("nc0", "ncw") else n for n in _needs), _body.replace("ncw w", f"ncw{_day} w").replace("from nc0", f"from nc0{_day}"))


@query("nowcast_cutoff_sweep", with_("sw", f"""
select objetivo, corte, modelo, {r('1 - sum(ae) / sum(real)', 'acierto_SKU')}, {r('1 - sum(ap) / sum(real)', 'acierto_planta')}, {r('1 - sum(gt) / sum(real)', 'acierto_total')}, {r('sum(f) / sum(real) - 1', 'sesgo_total')}
from (select objetivo, corte, modelo, mes, sum(ae) as ae, sum(abs(real - f)) as ap, abs(sum(real) - sum(f)) as gt, sum(real) as real, sum(f) as f
      from (select objetivo, corte, modelo, mes, planta, sum(abs(real - f)) as ae, sum(real) as real, sum(f) as f from sw group by all) group by all) group by all""",
    sw=(("nc10", "nc15", "nc20"), _SWEEP), **_SWEEP_CTES))
def nowcast_cutoff_sweep(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(nc.cutoff_sweep(closed(spark, sf), panel, panel.last_mi - MONTHS + 1, panel.last_mi, [10, 15, 20]))


@query("nowcast_volume_coverage", with_("nct gm", f"""
select n.mes, {r('sum(real_mes)', 'real_mes')}, count(*) as series, {r('max(g.y)', 'total')}, {r('sum(real_mes) / max(g.y)', 'cobertura')} from nct n join gm g on g.mi = n.mi group by n.mes"""))
def nowcast_volume_coverage(spark, sf):
    return rounded(nc.volume_coverage(backtest(spark, sf), closed_panel(spark, sf)))


@query("nowcast_rest_by_planta", with_("nct", f"""
select mes, planta, count(*) as series, {r('sum(resto)', 'real_resto_TO')}, {r('1 - abs(sum(media) - sum(resto)) / sum(resto)', 'planta_media')}, {r('1 - sum(abs(media - resto)) / sum(resto)', 'SKU_media')},
       {r('1 - abs(sum(mediana) - sum(resto)) / sum(resto)', 'planta_mediana')}, {r('1 - sum(abs(mediana - resto)) / sum(resto)', 'SKU_mediana')}
from nct group by mes, planta having sum(resto) > 0"""))
def nowcast_rest_by_planta(spark, sf):
    return rounded(nc.rest_by_planta(backtest(spark, sf), ["media", "mediana"]))


@query("rest_references", with_("nc panel cal", f"""
select nc.planta, nc.sku, nc.mi, {r('primeros / greatest(nseen, 1) * nleft', 'resto_prorata')},
       {r('(select sum(p.y) from panel p where p.planta = nc.planta and p.sku = nc.sku and p.mi between nc.mi - 6 and nc.mi - 1) / (select sum(c.b) from cal c where c.mi between nc.mi - 6 and nc.mi - 1) * nleft', 'resto_hist_rate')}
from nc"""))
def rest_references(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(nc.prorata_references(closed(spark, sf), panel, panel.last_mi - MONTHS + 1, panel.last_mi, DAY))


# ---- expected rest --------------------------------------------------------------------------------------------------------

EXPECTED = ["esperado_historia_mes", "esperado_solo_mes"]
cte("cutd", ("span",), f"""
select cast(date_trunc('month', d1) as date) as start, cast(date_trunc('month', d1) + interval {DAY - 1} day as date) as cut,
       greatest(cast(date_trunc('month', d1) + interval {DAY - 1} day - interval 364 day as date), cast(date_trunc('month', d0) as date)) as low from span""")
cte("pworks", ("fact", "cutd"), "select planta, fecha from fact, cutd where fecha between low and cut group by planta, fecha having sum(consumo) > 0")
cte("profile", ("pworks", "cutd", "monthly"), """
select p.planta, w.dia, coalesce((select count(*) from pworks x where x.planta = p.planta and isodow(x.fecha) - 1 = w.dia) / w.n::double, 0) as share
from (select distinct planta from monthly) p cross join
     (select isodow(d) - 1 as dia, count(*) as n from (select unnest(generate_series(low::timestamp, cut::timestamp, interval 1 day)) as d from cutd) group by 1) w""")
cte("qshare", ("fact", "cutd", "pworks", "firsts"), """
select s.planta, s.sku, least(greatest((npos + 10 * lr) / greatest(nseen + 10, 1e-9), 0), 1) as q, total, cnt
from (select f.planta, f.sku, count(x.fecha) filter (where x.consumo > 0 and x.fecha >= start) as npos, max(w.nseen) as nseen, sum(x.consumo) filter (where x.consumo > 0) as total,
             count(x.fecha) filter (where x.consumo > 0) as cnt, count(x.fecha) filter (where x.consumo > 0) / greatest(coalesce(max(w.n), 0), 1)::double as lr
      from firsts f cross join cutd left join fact x on x.planta = f.planta and x.sku = f.sku and x.fecha between low and cut
           left join (select planta, count(*) as n, count(*) filter (where fecha >= (select start from cutd)) as nseen from pworks group by planta) w on w.planta = f.planta
      group by f.planta, f.sku) s""")


@query("working_day_profile", with_("profile", f"select planta, dia::int as dia, {r('share', 'share')} from profile"))
def working_day_profile(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(sc.working_day_profile(closed(spark, sf), panel, panel.last_mi, DAY))


@query("consumption_share", with_("qshare", f"select planta, sku, {r('q', 'q')}, cnt::int as tamanos, {r('total / nullif(cnt, 0)', 'tamano_medio')} from qshare"))
def consumption_share(spark, sf):
    panel = closed_panel(spark, sf)
    out = sc.consumption_share(closed(spark, sf), panel, panel.last_mi, DAY)
    total = F.aggregate("sizes", F.lit(0.0), lambda t, x: t + x)
    return rounded(out.select("planta", "sku", "q", F.size("sizes").alias("tamanos"), F.try_divide(total, F.size("sizes")).alias("tamano_medio")))


@query("expected_rest_of_month", with_("qshare profile panel span", f"""
select q.planta, q.sku, {r('coalesce(q.q * q.total / nullif(q.cnt, 0) * d.days, 0)', 'esperado')}
from qshare q cross join span join panel p on p.planta = q.planta and p.sku = q.sku and p.mi = span.last_mi - 1
     join (select f.planta, sum(f.share) as days from profile f
           join (select isodow(x) - 1 as dia from (select unnest(generate_series(date_trunc('month', d1) + interval {DAY} day, last_day(d1)::timestamp, interval 1 day)) as x from span)
                 where cast(x as date) <= (select d1 from span)) u on u.dia = f.dia group by f.planta) d on d.planta = q.planta"""))
def expected_rest_of_month(spark, sf):
    panel = closed_panel(spark, sf)
    return rounded(sc.expected_rest(closed(spark, sf), panel, panel.last_mi, DAY))


def with_expected(spark, sf):
    """The nowcast table of the last month with the expected rest after a year and after the month alone as rivals."""

    def build():
        panel = closed_panel(spark, sf)
        mi = panel.last_mi
        year = sc.expected_rest(closed(spark, sf), panel, mi, DAY).withColumnRenamed("esperado", f"resto_{EXPECTED[0]}")
        alone = sc.expected_rest(closed(spark, sf), panel, mi, DAY, lookback=DAY, shrink=0.0).withColumnRenamed("esperado", f"resto_{EXPECTED[1]}")
        extra = year.join(alone, ["planta", "sku"]).withColumn("mi", F.lit(mi))
        return nc.nowcast_table(closed(spark, sf), panel, mi, mi, DAY, nc.h1_reference(members(spark, sf), H1), extra)

    return written_once(spark, sf, "nowcast_expected", build)


@query("nowcast_month_benchmark")
def nowcast_month_benchmark(spark, sf):
    return rounded(nc.global_scores(with_expected(spark, sf), "resto"))
