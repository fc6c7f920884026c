"""Validation rules over a deterministically damaged copy of the consumption, change tables and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.catalog.domain import OPEN, brand, closed, consumption, open_panel, written_once
from caudal.catalog.registry import cte, query, r, rounded, with_
from caudal.operators import changes, checks
from caudal.operators.checks import Limits


def damaged(spark, sf) -> DataFrame:
    """The consumption with missing values, negatives, copies, untidy keys, gaps and peaks put in by rule."""

    def build() -> DataFrame:
        df = consumption(spark, sf).withColumn("b", brand(F.col("sku"))).withColumn("d", F.dayofmonth("fecha"))
        b, d, fecha = F.col("b"), F.col("d"), F.col("fecha")
        last = open_panel(spark, sf).label_of(open_panel(spark, sf).last_mi)
        month = F.date_format("fecha", "yyyy-MM")
        df = df.where(
            ~fecha.between(F.lit("1997-03-04").cast("date"), F.lit("1997-03-12").cast("date"))
            & (month != "1998-06") & ~((month == "1999-02") & (d > 5)) & ~((month == last) & (F.col("planta") == "AFRICA"))
        )
        planta = (
            F.when((d == 5) & (b % 20 == 3), F.concat(F.lower("planta"), F.lit(" ")))
            .when((month == last) & (F.col("planta") == "ASIA") & (b % 3 == 0), F.lit("NUEVA"))
            .otherwise(F.col("planta"))
        )
        sku = (
            F.when((d == 7) & (b % 20 == 7), F.concat("sku", F.lit(" ")))
            .when((d == 9) & (b % 20 == 9), F.upper("sku"))
            .when((d == 11) & (b % 20 == 12), F.replace("sku", F.lit("/01/"), F.lit("-01-")))
            .when((d == 22) & (b % 10 == 5), F.lit("  "))
            .otherwise(F.col("sku"))
        )
        consumo = (
            F.when((d == 13) & (b % 10 == 1), F.lit(None).cast("double")).when((d == 14) & (b % 10 == 2), -F.col("consumo"))
            .when((d == 15) & (b % 10 == 3), F.col("consumo") * 30).otherwise(F.col("consumo"))
        )
        day = F.when((d == 21) & (b % 10 == 4), F.lit(None).cast("date")).otherwise(fecha)
        copies = F.when((d == 10) & (b % 10 == 2), 2).otherwise(1)
        out = df.select(planta.alias("planta"), sku.alias("sku"), day.alias("fecha"), consumo.alias("consumo"), F.explode(F.sequence(F.lit(1), copies)).alias("_"))
        return out.drop("_")

    return written_once(spark, sf, "damaged", build)


cte("damaged", ("consumption",), """
select planta2 as planta, sku2 as sku, case when d = 21 and b % 10 = 4 then null else fecha end as fecha,
       case when d = 13 and b % 10 = 1 then null when d = 14 and b % 10 = 2 then -consumo when d = 15 and b % 10 = 3 then consumo * 30 else consumo end as consumo
from (select *, case when d = 5 and b % 20 = 3 then lower(planta) || ' ' when mes = ultimo and planta = 'ASIA' and b % 3 = 0 then 'NUEVA' else planta end as planta2,
             case when d = 7 and b % 20 = 7 then sku || ' ' when d = 9 and b % 20 = 9 then upper(sku) when d = 11 and b % 20 = 12 then replace(sku, '/01/', '-01-')
                  when d = 22 and b % 10 = 5 then '  ' else sku end as sku2
      from (select *, cast(regexp_extract(sku, '^B([0-9]+)', 1) as int) as b, day(fecha) as d, strftime(fecha, '%Y-%m') as mes,
                   (select strftime(max(fecha), '%Y-%m') from consumption) as ultimo from consumption)
      where not (fecha between date '1997-03-04' and date '1997-03-12') and mes <> '1998-06' and not (mes = '1999-02' and d > 5) and not (mes = ultimo and planta = 'AFRICA')) x
     cross join lateral (select unnest(generate_series(1, case when d = 10 and b % 10 = 2 then 2 else 1 end))) u(i)
""")
cte("good", ("damaged",), "select * from damaged where planta is not null and trim(planta) <> '' and sku is not null and trim(sku) <> '' and fecha is not null and consumo is not null")

_MISSING = "select planta, sku, fecha, consumo from damaged where planta is null or trim(planta) = '' or sku is null or trim(sku) = '' or fecha is null or consumo is null"
_DUPLICATE = "select planta, sku, fecha, consumo, copias from (select *, count(*) over (partition by planta, sku, fecha) as copias from good) where copias > 1"
_NEAR = """
select planta, sku from (select distinct planta, sku from good) a
where exists (select 1 from (select distinct planta, sku from good) z where upper(trim(z.planta)) = upper(trim(a.planta))
              and regexp_replace(lower(z.sku), '\\s+', '', 'g') = regexp_replace(lower(a.sku), '\\s+', '', 'g') and (z.planta <> a.planta or z.sku <> a.sku))"""
_MONTH_GAP = """
select strftime(m, '%Y-%m') as mes from (select unnest(generate_series(date_trunc('month', min(fecha)), date_trunc('month', max(fecha)), interval 1 month)) as m from good)
where strftime(m, '%Y-%m') not in (select strftime(fecha, '%Y-%m') from good)"""
_DAY_GAP = """
select min(d) as desde, max(d) as hasta, count(*)::int as dias_habiles
from (select d, pos - row_number() over (order by d) as island
      from (select d, row_number() over (order by d) as pos, d in (select fecha from good) as here
            from (select cast(unnest(generate_series(min(fecha)::timestamp, max(fecha)::timestamp, interval 1 day)) as date) as d from good) where isodow(d) <> 7)
      where not here)
group by island having count(*) >= 3"""
_LAST = """
select ultimo, d as dia from (select max(fecha) as ultimo, cast(unnest(generate_series(max(fecha) + interval 1 day, last_day(max(fecha))::timestamp, interval 1 day)) as date) as d from {0})
where isodow(d) <> 7"""
_SPIKE = """
select g.planta, g.sku, fecha, consumo, round_even(consumo / m.med, 1) as veces_mediana
from good g join (select planta, sku, median(consumo) as med from good where consumo > 0 group by 1, 2) m on g.planta = m.planta and g.sku = m.sku
where consumo > 0 and consumo / m.med > 20"""
_ROWS_DROP = """
select mes, filas, previas as filas_mes_anterior
from (select mes, filas, lag(filas) over (order by mes) as previas
      from (select strftime(m, '%Y-%m') as mes, (select count(*) from good g where strftime(g.fecha, '%Y-%m') = strftime(m, '%Y-%m')) as filas
            from (select unnest(generate_series(date_trunc('month', min(fecha)), date_trunc('month', max(fecha)), interval 1 month)) as m from good)))
where previas > 0 and filas > 0 and filas < previas * 0.6"""
_PLANTAS = """
select planta, 'desaparece' as estado from (select planta from good where date_trunc('month', fecha) < (select date_trunc('month', max(fecha)) from good) except
                                            select planta from good where date_trunc('month', fecha) = (select date_trunc('month', max(fecha)) from good))
union all
select planta, 'nueva' from (select planta from good where date_trunc('month', fecha) = (select date_trunc('month', max(fecha)) from good) except
                             select planta from good where date_trunc('month', fecha) < (select date_trunc('month', max(fecha)) from good))"""
_FORMAT = "select distinct sku from good where not regexp_matches(sku, '^[^/]+/[^/]+/[0-9]+gsm/[0-9]+mm(/[^/]+(/.+)?)?$', 'i')"


def good(spark, sf) -> DataFrame:
    return checks.present(damaged(spark, sf))


@query("check_missing", with_("damaged", _MISSING))
def check_missing(spark, sf):
    return checks.missing(damaged(spark, sf))


@query("check_negative", with_("good", "select * from good where consumo < 0"))
def check_negative(spark, sf):
    return checks.negative(good(spark, sf))


@query("check_duplicates", with_("good", _DUPLICATE))
def check_duplicates(spark, sf):
    return checks.duplicate(good(spark, sf))


@query("check_keys", with_("good", "select * from good where planta <> upper(trim(planta)) or sku <> trim(sku)"))
def check_keys(spark, sf):
    return checks.keys(good(spark, sf))


@query("check_near_duplicate_keys", with_("good", _NEAR))
def check_near_duplicate_keys(spark, sf):
    return checks.near_duplicate_keys(good(spark, sf))


@query("check_month_gap", with_("good", _MONTH_GAP))
def check_month_gap(spark, sf):
    return checks.month_gap(good(spark, sf))


@query("check_day_gap", with_("good", _DAY_GAP))
def check_day_gap(spark, sf):
    return checks.day_gap(good(spark, sf))


@query("check_last_month", with_("consumption", _LAST.format("consumption")))
def check_last_month(spark, sf):
    return checks.last_month(consumption(spark, sf))


@query("check_daily_peak", with_("good", "select planta, sku, fecha, consumo from good where consumo > 100"))
def check_daily_peak(spark, sf):
    return checks.daily_peak(good(spark, sf)).orderBy(F.desc("consumo"), "planta", "sku", "fecha")


@query("check_spike", with_("good", _SPIKE))
def check_spike(spark, sf):
    return checks.spike(good(spark, sf))


@query("check_rows_drop", with_("good", _ROWS_DROP))
def check_rows_drop(spark, sf):
    return checks.rows_drop(good(spark, sf))


@query("check_planta_set", with_("good", _PLANTAS))
def check_planta_set(spark, sf):
    return checks.planta_set(good(spark, sf))


@query("check_sku_format", with_("good", _FORMAT))
def check_sku_format(spark, sf):
    return checks.sku_format(good(spark, sf))


_RULES = (
    ("error", "missing", _MISSING), ("error", "negative", "select * from good where consumo < 0"), ("error", "duplicate", _DUPLICATE),
    ("error", "keys", "select * from good where planta <> upper(trim(planta)) or sku <> trim(sku)"), ("error", "near_duplicate_keys", _NEAR),
    ("error", "month_gap", _MONTH_GAP), ("error", "day_gap", _DAY_GAP), ("error", "last_month", _LAST.format("good")),
    ("warning", "daily_peak", "select * from good where consumo > 100"), ("warning", "spike", _SPIKE), ("warning", "rows_drop", _ROWS_DROP),
    ("warning", "planta_set", _PLANTAS), ("warning", "sku_format", _FORMAT),
)
_COUNTS = " union all ".join(f"select '{severity}' as severity, '{code}' as code, count(*) as n from ({sql})" for severity, code, sql in _RULES)


@query("check_summary", with_("good", f"select * from ({_COUNTS}) where n > 0"))
def check_summary(spark, sf):
    return checks.summary(checks.violations(damaged(spark, sf), Limits(require_complete_last_month=True)))


# Every finding of every code with the columns that its rule has.
_FOUND = " union all by name ".join(f"select '{code}' as code, * from ({sql})" for _, code, sql in _RULES)


@query("check_examples", with_("good", f"""
select code, planta, sku, cast(fecha as date) as fecha, cast(consumo as double) as consumo, orden::int as orden
from (select *, row_number() over (partition by code order by planta nulls last, sku nulls last, fecha nulls last, consumo nulls last) as orden from ({_FOUND}))
where orden <= 5"""))
def check_examples(spark, sf):
    """The first findings of every code."""
    found = checks.violations(damaged(spark, sf), Limits(require_complete_last_month=True))
    return checks.examples(found).select("code", "planta", "sku", "fecha", "consumo", "orden")


@query("check_duplicate_surplus", with_("good", """
select count(*) as claves, coalesce(sum(n), 0)::bigint as filas, coalesce(sum(n - 1), 0)::bigint as sobrantes from (select count(*) as n from good group by planta, sku, fecha having count(*) > 1)"""))
def check_duplicate_surplus(spark, sf):
    return checks.duplicate_surplus(good(spark, sf))


@query("sunday_rows", with_("good", "select * from good where isodow(fecha) = 7"))
def sunday_rows(spark, sf):
    from caudal.operators.panel import sunday_rows as rows

    return rows(good(spark, sf))


_CHANGE = ", ".join([r("prev", "consumo_mes_anterior"), r("cur", "consumo_mes"), r("cur - prev", "cambio_TO"), r("case when prev > 0 then (cur - prev) / prev * 100 end", "cambio_pct")])


@query("change_planta_sku", with_("monthly cal span", f"""
select c.mes, g.planta, g.sku, {_CHANGE}, case when prev = 0 then 'nuevo' when cur = 0 then 'sin consumo' else 'cambia' end as estado
from (select k.planta, k.sku, c.mi, coalesce(m.y, 0) as cur, coalesce(p.y, 0) as prev
      from (select distinct planta, sku from monthly) k cross join span join cal c on c.mi between 1 and span.last_mi
           left join monthly m on m.planta = k.planta and m.sku = k.sku and m.mi = c.mi
           left join monthly p on p.planta = k.planta and p.sku = k.sku and p.mi = c.mi - 1) g join cal c on c.mi = g.mi
where cur > 0 or prev > 0""", **OPEN))
def change_planta_sku(spark, sf):
    return rounded(changes.change_by_sku(open_panel(spark, sf)))


@query("change_planta", with_("pm monthly cal span", f"""
select c.mes, g.planta, {_CHANGE}, (select count(*) from monthly m where m.planta = g.planta and m.mi = g.mi and m.y > 0) as skus_con_consumo
from (select a.planta, a.mi, a.y as cur, p.y as prev from pm a join pm p on p.planta = a.planta and p.mi = a.mi - 1) g join cal c on c.mi = g.mi""", **OPEN))
def change_planta(spark, sf):
    return rounded(changes.change_by_planta(open_panel(spark, sf)))


@query("eda_series", with_("fact", """
select planta, sku, count(consumo) as n_obs, min(fecha) as fecha_min, max(fecha) as fecha_max, round_even(avg(consumo), 3) as mean, round_even(stddev_samp(consumo), 3) as std,
       min(consumo) as min, max(consumo) as max, round_even(avg((consumo = 0)::int) * 100, 1) as pct_zero, (max(fecha) - min(fecha) + 1)::bigint as span_days,
       round_even(count(consumo) / (max(fecha) - min(fecha) + 1) * 100, 1) as coverage_pct, round_even(round_even(stddev_samp(consumo), 3) / round_even(avg(consumo), 3), 3) as cv
from fact group by planta, sku"""))
def eda_series(spark, sf):
    return changes.describe_series(closed(spark, sf))


@query("eda_planta", with_("fact", """
select planta, count(distinct sku) as n_sku, count(*) as n_obs, min(fecha) as fecha_min, max(fecha) as fecha_max, round_even(sum(consumo), 1) as consumo_total,
       round_even(avg(consumo), 3) as consumo_mean, round_even(stddev_samp(consumo), 3) as consumo_std, min(consumo) as consumo_min, max(consumo) as consumo_max,
       round_even(avg((consumo = 0)::int) * 100, 1) as pct_zero, round_even(round_even(stddev_samp(consumo), 3) / round_even(avg(consumo), 3), 3) as cv,
       round_even(count(*) / count(distinct sku), 1) as obs_por_sku
from fact group by planta"""))
def eda_planta(spark, sf):
    return changes.describe_plantas(closed(spark, sf)).orderBy(F.desc("consumo_total"))
