"""The given tables seen as a consumption fact, and the shared tables most queries start from.

planta = region name, sku = a description built from the part brand and type, fecha = ship date, consumo = quantity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.catalog.registry import cte
from caudal.operators.features import make_frame
from caudal.operators.month_state import detect_month_state, up_to_month
from caudal.operators.panel import Panel, build_panel
from caudal.session import written

TEST_MONTHS = 12
MEMBERS = ["naive", "mean3", "mean6", "mean12", "perday6"]

_SHARED: dict[tuple, object] = {}


def shared(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], object]):
    """One object per session, data folder and name, as a long-running service keeps its loaded panel."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def written_once(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A shared table, written by the first query that needs it."""
    folder = sf_dir.rstrip("/").rsplit("/", 1)[-1]
    return shared(spark, sf_dir, what, lambda: written(build(), f"{folder}/{what}"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand(sku: Column) -> Column:
    """The brand number inside a description (`B12/01/...` gives 12)."""
    return F.regexp_extract(sku, r"(?i)^\s*B(\d+)", 1).cast("int")


def raw_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items joined to their part and region and added up by day.

    Only the region and nation tables, which have a fixed size, are hinted; part and supplier grow with the data and
    Spark decides from their size (adaptive joins split hot keys).
    """
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    number = F.expr("substr(p_brand, 7)")
    gsm = 80 + 5 * (number.cast("int") % 8)
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("B"), number, F.lit("/01/"), gsm.cast("string"), F.lit("gsm/2100mm/"), F.col("p_type")).alias("sku"),
    )
    places = (
        table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        .join(F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("planta"))), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    suppliers = (
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        .join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "planta")
    )
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("planta", "sku", F.col("l_shipdate").cast("date").alias("fecha"))
        .agg(F.sum("l_quantity").cast("double").alias("consumo"))
    )


def consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact, written once and sorted by day inside its files so that date filters skip row groups."""
    return written_once(spark, sf_dir, "consumption", lambda: raw_consumption(spark, sf_dir).sortWithinPartitions("fecha"))


def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consumption up to the last complete month."""

    def build() -> DataFrame:
        df = consumption(spark, sf_dir)
        return up_to_month(df, detect_month_state(df).last_complete)

    return shared(spark, sf_dir, "closed", build)


def open_panel(spark: SparkSession, sf_dir: str) -> Panel:
    return shared(spark, sf_dir, "open_panel", lambda: build_panel(consumption(spark, sf_dir)))


def closed_panel(spark: SparkSession, sf_dir: str) -> Panel:
    return shared(spark, sf_dir, "closed_panel", lambda: build_panel(closed(spark, sf_dir)))


def frame(spark: SparkSession, sf_dir: str, horizon: int = 1) -> DataFrame:
    return written_once(spark, sf_dir, f"frame_h{horizon}", lambda: make_frame(closed_panel(spark, sf_dir), horizon))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baselines as ensemble members over the last test months: (planta, sku, o, t, y, p_<member>)."""
    first = closed_panel(spark, sf_dir).last_mi - TEST_MONTHS + 1
    return frame(spark, sf_dir).where(F.col("t") >= first).select("planta", "sku", "o", "t", "y", *[f"p_{m}" for m in MEMBERS])


# ---- the same tables in the check SQL -----------------------------------------------------------------------------------

cte("consumption", (), """
select r_name as planta,
       concat('B', substr(p_brand, 7), '/01/', cast(80 + 5 * (cast(substr(p_brand, 7) as int) % 8) as varchar), 'gsm/2100mm/', p_type) as sku,
       cast(l_shipdate as date) as fecha, cast(sum(l_quantity) as double) as consumo
from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
     join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by 1, 2, 3
""")
cte("state", ("consumption",), """
select last_day, month_first, month_end, days_left,
       case when days_left = 0 then month_end else cast(month_first - interval 1 day as date) end as complete_end
from (select last_day, month_first, month_end,
             len(list_filter(generate_series(last_day + interval 1 day, month_end::timestamp, interval 1 day), lambda d: isodow(d) <> 7)) as days_left
      from (select max(fecha) as last_day, cast(date_trunc('month', max(fecha)) as date) as month_first, last_day(max(fecha)) as month_end from consumption))
""")
cte("closed", ("consumption", "state"), "select c.* from consumption c, state where c.fecha <= complete_end")
cte("fact", ("closed",), "select * from closed")
OPEN = {"fact": (("consumption",), "select * from consumption")}
cte("span", ("fact",), """
select min(year(fecha) * 12 + month(fecha) - 1) as y0, max(year(fecha) * 12 + month(fecha) - 1) - min(year(fecha) * 12 + month(fecha) - 1) as last_mi,
       min(fecha) as d0, max(fecha) as d1
from fact
""")
cte("days", ("span",), """
select cast(d as date) as d, year(d) * 12 + month(d) - 1 - y0 as mi
from (select y0, unnest(generate_series(date_trunc('month', d0), d1::timestamp, interval 1 day)) as d from span)
union all
select cast(d as date), year(d) * 12 + month(d) - 1 - y0
from (select y0, unnest(generate_series((last_day(d1) + interval 1 day)::timestamp, (last_day(d1) + interval 120 day)::timestamp, interval 1 day)) as d from span)
""")
cte("cal", ("days",), """
select mi, strftime(min(d), '%Y-%m') as mes, month(min(d)) as moy, count(*) as cd, count(*) filter (where isodow(d) <> 7) as b, min(d) as first_date
from days group by mi
""")
cte("monthly", ("fact", "span"), """
select planta, sku, year(fecha) * 12 + month(fecha) - 1 - y0 as mi, sum(consumo) as y,
       count(*) filter (where consumo > 0) as act, count(*) as filas
from fact, span group by planta, sku, 3
""")
cte("firsts", ("monthly",), "select planta, sku, min(mi) as f from monthly group by planta, sku")
cte("panel", ("firsts", "monthly", "cal", "span"), """
select f.planta, f.sku, c.mi, coalesce(m.y, 0.0)::double as y, coalesce(m.act, 0)::double as act, f.f, c.b
from firsts f cross join span join cal c on c.mi >= f.f and c.mi <= span.last_mi
     left join monthly m on m.planta = f.planta and m.sku = f.sku and m.mi = c.mi
""")
cte("pm", ("monthly", "cal", "span"), """
select p.planta, c.mi, coalesce(s.y, 0.0)::double as y, c.b
from (select distinct planta from monthly) p cross join span join cal c on c.mi <= span.last_mi
     left join (select planta, mi, sum(y) as y from monthly group by 1, 2) s on s.planta = p.planta and s.mi = c.mi
""")
cte("gm", ("pm",), "select mi, sum(y) as y, min(b) as b from pm group by mi")
cte("codes", ("monthly",), "select planta, (row_number() over (order by planta) - 1)::int as planta_code from (select distinct planta from monthly)")


def frame_ctes(h: int) -> dict[str, tuple[tuple[str, ...], str]]:
    """The forecasting frame by windows over the dense panel, one pass for each table."""

    def window(value: str, lo: int, hi: int) -> str:
        return f"{value} over (partition by planta, sku order by mi rows between {-lo} preceding and {hi} following)" if hi > 0 else (
            f"{value} over (partition by planta, sku order by mi rows between {-lo} preceding and {f'{-hi} preceding' if hi < 0 else 'current row'})")

    means = ", ".join(f"{window('avg(y)', -k + 1, 0)} as mean{k}" for k in (3, 6, 12))
    rates = ", ".join(
        f"{window('sum(y)', -k + 1, 0)} / nullif({window('sum(b)', -k + 1, 0)}, 0) as rate{k}, {window('sum(act)', -k + 1, 0)} / nullif({window('sum(b)', -k + 1, 0)}, 0) as occ{k}"
        for k in (3, 6, 12)
    )

    def seasonal(source: str, keys: str, name: str) -> str:
        by = f"{'partition by planta ' if keys else ''}order by mi"
        past = lambda far, near: f"nullif(avg(y) over ({by} rows between {far} preceding and {near} preceding), 0)"
        return f"""
select {'planta, ' if keys else ''}mi as o,
       case when mi + {h} >= 12 and mi >= 17 then lag(y, {12 - h}) over ({by}) / {past(17, 12)} end as ratio_{name},
       case when mi + {h} >= 15 then lag(y, {12 - h}) over ({by}) / {past(15 - h, 9 - h)} end as lyrel_{name}
from {source}"""

    return {
        "rp": (("pm",), seasonal("pm", "planta", "planta")),
        "rg": (("gm",), seasonal("gm", "", "global")),
        "wide": (("panel",), f"""
select planta, sku, mi as o, mi + {h} as t, y as lag1, {window('avg(y)', -5, 0).replace('avg(y)', 'stddev_pop(y)')} as std6,
       lag(y, 1) over own as lag2, lag(y, 2) over own as lag3, lag(y, {12 - h}) over own as ly, lag(b, {12 - h}) over own as ly_b, lead(y, {h}) over own as y,
       {means}, {rates}, {window('avg((y = 0)::int)', -11, 0)} as zero_share12, mi - f + 1 as months_active
from panel window own as (partition by planta, sku order by mi)"""),
        "frame": (("wide", "rp", "rg", "cal", "codes", "span"), f"""
select w.planta, w.sku, w.o, w.t, w.lag1, lag2, lag3, mean3, mean6, mean12, std6, zero_share12, months_active, ly, planta_code,
       ct.moy as month_t, ratio_planta, ratio_global, lyrel_planta, lyrel_global, ct.b as n_days_t, rate3, rate6, rate12, occ3, occ6, occ12,
       case when occ6 > 0 then rate6 / occ6 end as size6, ly / nullif(ly_b, 0) as ly_rate, w.y as y,
       w.lag1 as p_naive, mean3 as p_mean3, mean6 as p_mean6, mean12 as p_mean12, rate6 * ct.b as p_perday6, coalesce(ly, mean6) as p_seasonal_naive,
       coalesce(mean6 * ratio_global, mean6) as p_mean6_x_global, coalesce(mean6 * ratio_planta, mean6) as p_mean6_x_planta
from wide w cross join span join codes using (planta) join cal ct on ct.mi = w.t
     left join rp on rp.planta = w.planta and rp.o = w.o left join rg on rg.o = w.o
where w.o >= 3 and w.t <= span.last_mi"""),
    }


for _name, (_needs, _body) in frame_ctes(1).items():
    cte(_name, _needs, _body)
cte("members", ("frame", "span"), f"select planta, sku, o, t, y, {', '.join('p_' + m for m in MEMBERS)} from frame, span where t > last_mi - {TEST_MONTHS}")
