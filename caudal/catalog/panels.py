"""Scan, panel, calendar, features and direct baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from caudal.catalog.domain import OPEN, closed, closed_panel, consumption, frame, frame_ctes, open_panel
from caudal.catalog.registry import cte, query, r, rounded, with_
from caudal.operators import features as ft
from caudal.operators import panel as pn
from caudal.operators.features import BASELINES, FEATURES


@query("consumption_scan", with_("consumption", "select * from consumption"))
def consumption_scan(spark, sf):
    return consumption(spark, sf)


@query("monthly_panel", with_("panel", "select planta, sku, mi, y, act as active_days from panel", **OPEN))
def monthly_panel(spark, sf):
    return open_panel(spark, sf).dense().select("planta", "sku", "mi", "y", "active_days")


@query("monthly_by_planta", with_("pm", "select planta, mi, y from pm", **OPEN))
def monthly_by_planta(spark, sf):
    return open_panel(spark, sf).planta_months()


@query("monthly_total", with_("gm", "select mi, y from gm", **OPEN))
def monthly_total(spark, sf):
    return open_panel(spark, sf).total_months()


@query("calendar_days", with_("cal span", """
select mi, mes, moy::int as month_of_year, b::int as business_days, cd::int as calendar_days, first_date as month_first_date from cal, span where mi <= last_mi""", **OPEN))
def calendar_days(spark, sf):
    return open_panel(spark, sf).months()


@query("calendar_extended", with_("cal span", """
select mi, mes, moy::int as month_of_year, b::int as business_days, cd::int as calendar_days from cal, span where mi <= last_mi + 2""", **OPEN))
def calendar_extended(spark, sf):
    return open_panel(spark, sf).months(ahead=2).drop("month_first_date")


@query("calendar_completed", with_("span", """
select year(last_day(d1)) * 12 + month(d1) - 1 - y0 as mi,
       len(generate_series(date_trunc('month', d1), last_day(d1)::timestamp, interval 1 day))::int as calendar_days,
       len(list_filter(generate_series(date_trunc('month', d1), last_day(d1)::timestamp, interval 1 day), lambda d: isodow(d) <> 7))::int as business_days
from span""", **OPEN))
def calendar_completed(spark, sf):
    panel = open_panel(spark, sf).completed_calendar()
    return panel.months().where(F.col("mi") == panel.last_mi).select("mi", "calendar_days", "business_days")


@query("monthly_view", with_("consumption", """
select planta, sku, strftime(fecha, '%Y-%m') as mes, sum(consumo) as consumo, count(*) as dias_con_consumo from consumption group by 1, 2, 3"""))
def monthly_view(spark, sf):
    return pn.monthly_view(consumption(spark, sf))


@query("panel_daily_check", with_("monthly", "select planta, count(*) as meses, 0::bigint as meses_que_no_cuadran from monthly group by planta", **OPEN))
def panel_daily_check(spark, sf):
    return pn.check_daily_sums(consumption(spark, sf), open_panel(spark, sf))


@query("series_positions", with_("consumption", """
select planta, sku, row_number() over (order by planta, sku) - 1 as series from (select distinct planta, sku from consumption)"""))
def series_positions(spark, sf):
    return pn.sorted_positions(open_panel(spark, sf))


@query("masked_panel", with_("panel span", """
select planta, sku, mi, case when mi <= last_mi - 2 then y end as y, case when mi <= last_mi - 2 then act end as active_days
from panel, span where f <= last_mi - 2"""))
def masked_panel(spark, sf):
    panel = closed_panel(spark, sf)
    return panel.masked(panel.last_mi - 2).dense(ahead=2).select("planta", "sku", "mi", "y", "active_days")


@query("extended_panel", with_("panel span", """
select planta, sku, mi, y from panel
union all
select planta, sku, last_mi + k, null from (select distinct planta, sku from panel), span, (values (1), (2)) v(k)"""))
def extended_panel(spark, sf):
    return closed_panel(spark, sf).dense(ahead=2).select("planta", "sku", "mi", "y")


_INTS = {"planta_code", "month_t", "n_days_t", "months_active"}


def _frame_select(columns: list[str]) -> str:
    parts = [f"{c}::int as {c}" if c in _INTS or c in ("o", "t") else c if c in ("planta", "sku") else r(c, c) for c in columns]
    return f"select {', '.join(parts)} from frame"


_FRAME_COLUMNS = ["planta", "sku", "o", "t", *FEATURES, "y"]


@query("frame_h1", with_("frame", _frame_select(_FRAME_COLUMNS)))
def frame_h1(spark, sf):
    return rounded(frame(spark, sf, 1).select(*_FRAME_COLUMNS))


@query("frame_h2", with_("frame", _frame_select(_FRAME_COLUMNS), **frame_ctes(2)))
def frame_h2(spark, sf):
    return rounded(frame(spark, sf, 2).select(*_FRAME_COLUMNS))


@query("frame_open_month", with_("frame", _frame_select(_FRAME_COLUMNS), **OPEN))
def frame_open_month(spark, sf):
    return rounded(ft.make_frame(open_panel(spark, sf), 1).select(*_FRAME_COLUMNS))


_BASE_COLUMNS = ["planta", "sku", "o", "t", "y", *[f"p_{b}" for b in BASELINES]]


@query("baselines_h1", with_("frame", _frame_select(_BASE_COLUMNS)))
def baselines_h1(spark, sf):
    return rounded(frame(spark, sf, 1).select(*_BASE_COLUMNS))


_MTD = """
select f.planta, f.sku, f.o, f.t, coalesce(m.mtd, 0.0) as mtd, coalesce(m.act, 0) as act, e.elapsed, c.b
from frame f join cal c on c.mi = f.o + 1
     join (select mi, count(*) filter (where isodow(d) <> 7) as elapsed from days where day(d) <= {day} group by mi) e on e.mi = f.o + 1
     left join (select planta, sku, year(fecha) * 12 + month(fecha) - 1 - y0 as mi, sum(consumo) as mtd, count(*) filter (where consumo > 0) as act
                from fact, span where day(fecha) <= {day} group by 1, 2, 3) m on m.planta = f.planta and m.sku = f.sku and m.mi = f.o + 1"""
cte("mtd15", ("frame", "cal", "days", "fact", "span"), _MTD.format(day=15))


@query("partial_features_d15", with_("mtd15", f"""
select planta, sku, o, t, {r('mtd', 'mtd')}, {r('mtd / nullif(elapsed, 0)', 'mtd_rate')}, {r('act / nullif(elapsed, 0)', 'mtd_occ')},
       {r('mtd / nullif(elapsed, 0) * b', 'mtd_proj')} from mtd15""", **frame_ctes(2)))
def partial_features_d15(spark, sf):
    out = ft.add_partial_features(frame(spark, sf, 2).select("planta", "sku", "o", "t"), closed(spark, sf), closed_panel(spark, sf), 15)
    return rounded(out)


def _direct_sql(source: str, planta: str, h: int) -> str:
    part = "partition by planta " if planta == "planta" else ""
    on = "a.planta = x.planta and " if planta == "planta" else ""
    mean = lambda k: f"avg(y) over ({part}order by mi rows between {k - 1} preceding and current row)"
    rate = f"sum(y) over ({part}order by mi rows between 5 preceding and current row) / nullif(sum(b) over ({part}order by mi rows between 5 preceding and current row), 0)"
    ly = f"(select a.y from {source} a where {on}a.mi = x.mi + {h - 12})"
    level = f"(select avg(a.y) from {source} a where {on}a.mi between x.mi - 17 and x.mi - 12)"
    return f"""
select planta, o, t, {r('naive', 'naive')}, {r('mean3', 'mean3')}, {r('mean6', 'mean6')}, {r('mean12', 'mean12')}, {r('perday6', 'perday6')},
       {r('coalesce(ly, mean6)', 'seasonal_naive')}, {r('case when o >= 17 then coalesce(mean6 * ly / nullif(level, 0), mean6) else mean6 end', 'mean6_x_seasonal')}
from (select {planta} as planta, x.mi::int as o, (x.mi + {h})::int as t, y as naive, {mean(3)} as mean3, {mean(6)} as mean6, {mean(12)} as mean12,
             {rate} * c.b2 as perday6, {ly} as ly, {level} as level
      from {source} x join (select mi as cmi, b as b2 from cal) c on c.cmi = x.mi + {h})"""


@query("direct_baselines_planta", with_("pm cal", _direct_sql("pm", "planta", 1)))
def direct_baselines_planta(spark, sf):
    return rounded(ft.direct_forecasts(closed_panel(spark, sf), 1))


@query("direct_baselines_total", with_("gm cal", _direct_sql("gm", "''", 2)))
def direct_baselines_total(spark, sf):
    return rounded(ft.direct_forecasts(closed_panel(spark, sf), 2, level="total"))
