"""Planner and internal forecasts against the models. Both sources are derived from last month's consumption by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.catalog.domain import TEST_MONTHS, brand, closed, closed_panel, written_once
from caudal.catalog.registry import cte, query, r, rounded, with_
from caudal.catalog.scoring import combined
from caudal.functions.skus import MONTH_NAMES, alt_key, dataset_key, planner_key
from caudal.operators import compare as cp
from caudal.sources import planner as src

MIN_HISTORY = 3
NO_FORECAST_BRAND = 22
SOURCES = ["planner", "ml_mean", "internal"]
MODELS = ["ml_mean", "naive", "mean6"]
PLANTA = "EUROPE"


def last_values(spark, sf) -> DataFrame:
    """(planta, b, gsm, mi, y): consumption of each planner key in the month before each test month."""
    panel = closed_panel(spark, sf)
    number = brand(F.col("sku"))
    gsm = F.regexp_extract("sku", r"(\d+)gsm", 1).cast("int")
    rows = panel.known().where(F.col("mi").between(panel.last_mi - TEST_MONTHS, panel.last_mi - 1))
    return rows.groupBy("planta", number.alias("b"), gsm.alias("gsm"), F.col("mi")).agg(F.sum("y").alias("y"))


def planner_rows(spark, sf) -> DataFrame:
    """Planner forecasts, with some SKUs under another sub-grade and some that never existed."""

    def build() -> DataFrame:
        panel = closed_panel(spark, sf)
        b, gsm = F.col("b").cast("string"), F.col("gsm").cast("string")
        name = lambda sub, grams: F.concat(F.lit("B"), b, F.lit(f"/{sub}/"), grams, F.lit("gsm/2100mm"))
        names = F.array_compact(F.array(
            name("01/1", gsm), F.when(F.col("b") % 11 == 0, name("02", gsm)), F.when(F.col("b") % 13 == 0, name("01", F.lit("999")))
        ))
        value = F.col("y") * (1.0 + (F.col("b") % 5 - 2) * F.lit(0.05))
        out = last_values(spark, sf).select(
            "planta", panel.label(F.col("mi") + 1).alias("mes"), F.explode(names).alias("sku_planner"), (F.col("b") + 100000).alias("product_sap"),
            F.when(F.col("b") % 3 > 0, "VMI").otherwise("NO VMI").alias("strategy"), value.alias("forecast_to"), "b", "gsm",
        )
        return out

    return written_once(spark, sf, "planner", build)


def internal_rows(spark, sf) -> DataFrame:
    """Internal forecasts before the all-zero SKUs are blanked: some brands are 0, some are absent."""
    panel = closed_panel(spark, sf)
    b = F.col("b")
    value = F.when(b % 10 == 0, 0.0).otherwise(F.col("y") * (1.0 + (b % 7 - 3) * F.lit(0.1)))
    return last_values(spark, sf).where(b % 12 != 0).select(
        "planta", panel.label(F.col("mi") + 1).alias("mes"),
        F.concat(F.lit("B"), b.cast("string"), F.lit("/01/1/"), F.col("gsm").cast("string"), F.lit("gsm/2100mm")).alias("sku_planner"),
        (b + 100000).alias("product_sap"), value.alias("forecast_to"), "b", "gsm",
    )


def internal_marked(spark, sf) -> DataFrame:
    return src.mark_missing(internal_rows(spark, sf)).select(*src.LONG_INTERNAL)


def forecasts(spark, sf) -> DataFrame:
    """The ensembles with `ml_mean` standing for the mean of the members; one brand has no forecast."""
    return combined(spark, sf).where(brand(F.col("sku")) != NO_FORECAST_BRAND).withColumn("p_ml_mean", F.col("p_base_mean"))


def audited(spark, sf) -> DataFrame:
    build = lambda: cp.audit(planner_rows(spark, sf), forecasts(spark, sf), closed_panel(spark, sf), MODELS, MIN_HISTORY, ["VMI"])
    return written_once(spark, sf, "audited", build)


def table(spark, sf) -> DataFrame:
    build = lambda: cp.add_internal(cp.compared(audited(spark, sf)), internal_marked(spark, sf))[0]
    return written_once(spark, sf, "three_sources", build)


# ---- check SQL -----------------------------------------------------------------------------------------------------------

cte("prevs", ("monthly", "span"), f"""
select planta, cast(regexp_extract(sku, '^B([0-9]+)', 1) as int) as b, cast(regexp_extract(sku, '([0-9]+)gsm', 1) as int) as gsm, mi, sum(y) as y
from monthly, span where mi between last_mi - {TEST_MONTHS} and last_mi - 1 group by 1, 2, 3, 4""")
cte("plan", ("prevs", "cal"), """
select p.planta, c.mes, c.mi as t, p.b, p.gsm, n.sku, 100000 + b as product_sap, case when b % 3 > 0 then 'VMI' else 'NO VMI' end as strategy,
       y * (1.0::double + (b % 5 - 2) * 0.05::double) as f
from prevs p join (select mi, mes from cal) c on c.mi = p.mi + 1
     cross join lateral (select unnest(list_filter([format('B{}/01/1/{}gsm/2100mm', b, gsm), case when b % 11 = 0 then format('B{}/02/{}gsm/2100mm', b, gsm) end,
                                                    case when b % 13 = 0 then format('B{}/01/999gsm/2100mm', b) end], lambda x: x is not null)) as sku) n""")
cte("inte", ("prevs", "cal"), """
select p.planta, c.mes, p.b, p.gsm, format('B{}/01/1/{}gsm/2100mm', b, gsm) as sku, 100000 + b as product_sap,
       case when b % 10 = 0 then 0.0::double else y * (1.0::double + (b % 7 - 3) * 0.1::double) end as f
from prevs p join (select mi, mes from cal) c on c.mi = p.mi + 1 where b % 12 <> 0""")
cte("intm", ("inte",), "select i.* exclude (f), case when (select max(z.f) from inte z where z.planta = i.planta and z.sku = i.sku) > 0 then f end as f from inte i")
cte("serk", ("firsts",), "select *, array_to_string(string_split(lower(sku), '/')[1:4], '/') as key from firsts")
cte("resk", ("ensembled",), f"""
select planta, array_to_string(string_split(lower(sku), '/')[1:4], '/') as key, t, sum(y) as real, sum(p_base_mean) as ml_mean, sum(p_naive) as naive, sum(p_mean6) as mean6
from ensembled where not starts_with(sku, 'B{NO_FORECAST_BRAND}/') group by 1, 2, 3""")
cte("aud", ("plan", "serk", "resk"), f"""
select p.*, k.first, k.n, p.t - 1 - k.first + 1 as history, r.real, r.ml_mean, r.naive, r.mean6, near.cerca,
       case when k.n is null and near.cerca is not null then '{cp.SUBGRADE}' when k.n is null then '{cp.NO_SERIES}' when p.t - k.first < {MIN_HISTORY} then '{cp.LOW_HISTORY}'
            when r.t is null then '{cp.NO_MODEL}' end as reason
from (select *, replace(lower(sku), '/01/1/', '/01/') as key from plan where strategy = 'VMI') p
     left join (select planta, key, min(f) as first, count(*) as n from serk group by 1, 2) k on k.planta = p.planta and k.key = p.key
     left join (select planta, regexp_replace(key, '^([^/]+)/[^/]+/', '\\1/') as alt, string_agg(distinct array_to_string(string_split(sku, '/')[1:4], '/'), ', ' order by array_to_string(string_split(sku, '/')[1:4], '/')) as cerca from serk group by 1, 2) near
       on near.planta = p.planta and near.alt = regexp_replace(p.key, '^([^/]+)/[^/]+/', '\\1/')
     left join resk r on r.planta = p.planta and r.key = p.key and r.t = p.t""")
cte("cmp", ("aud", "intm"), """
select a.planta, a.mes, a.sku, a.strategy, a.n as series, a.history, a.real, a.f as planner, a.ml_mean, a.naive, a.mean6, i.f as internal
from aud a left join intm i on i.planta = a.planta and i.mes = a.mes and i.sku = a.sku where a.reason is null""")
cte("exc", ("aud",), f"""
select planta, mes, sku, strategy, f as planner, reason,
       case when reason = '{cp.SUBGRADE}' then 'en los datos: ' || cerca when reason = '{cp.LOW_HISTORY}' then greatest(history, 0) || ' meses antes del origen' else '' end as detail
from aud where reason is not null""")
cte("gone", ("cmp", "inte"), f"""
select c.planta, c.mes, c.sku, c.strategy, c.planner, '{cp.MISSING_INTERNAL}' as reason,
       case when exists (select 1 from inte i where i.planta = c.planta and i.sku = c.sku) then '{cp.ZERO_DETAIL}' else '{cp.ABSENT_DETAIL}' end as detail
from cmp c where internal is null""")


@query("planner_compare", with_("cmp", f"select planta, mes, sku, strategy, series, history::int as history, {', '.join(r(c, c) for c in ('real', 'planner', 'ml_mean', 'naive', 'mean6'))} from cmp"))
def planner_compare(spark, sf):
    return rounded(cp.compared(audited(spark, sf)))


@query("planner_excluded", with_("exc", f"select planta, mes, sku, strategy, {r('planner', 'planner')}, reason, detail from exc"))
def planner_excluded(spark, sf):
    return rounded(cp.excluded(audited(spark, sf)))


@query("planner_unmatched", with_("plan serk", """
select planta, mes, sku from (select *, replace(lower(sku), '/01/1/', '/01/') as key from plan) p where not exists (select 1 from serk s where s.planta = p.planta and s.key = p.key)"""))
def planner_unmatched(spark, sf):
    return cp.unmatched(cp.audit(planner_rows(spark, sf), forecasts(spark, sf), closed_panel(spark, sf), ["naive"]))


@query("internal_status", with_("cmp", f"select planta, mes, sku, {r('internal', 'internal')}, case when internal is null then 'faltante' else 'ok' end as internal_status from cmp"))
def internal_status(spark, sf):
    return rounded(table(spark, sf).select("planta", "mes", "sku", "internal", "internal_status"))


@query("internal_missing", with_("gone", f"select planta, mes, sku, strategy, {r('planner', 'planner')}, reason, detail from gone"))
def internal_missing(spark, sf):
    return rounded(cp.add_internal(cp.compared(audited(spark, sf)), internal_marked(spark, sf))[1])


@query("internal_marked", with_("intm", f"select planta, mes, sku as sku_planner, product_sap::int as product_sap, {r('f', 'forecast_to')} from intm"))
def internal_marked_query(spark, sf):
    return rounded(internal_marked(spark, sf))


def _acc(source: str, columns: list[str], where: str = "true") -> tuple[tuple[str, ...], str]:
    return (source,), " union all ".join(f"select mes, planta, '{c}' as modelo, real, {c} as f from {source} where {c} is not null and {where}" for c in columns)


_SCORES = ", ".join(["n", r("ae / n", "mae"), r("ae / nullif(real, 0)", "wape"), r("1 - ae / nullif(real, 0)", "accuracy"), r("e / nullif(real, 0) * 100", "bias_pct")])
_RANKED = f"""
select modelo, rank() over (order by round(ae / real, 10))::int as rank, {_SCORES}
from (select modelo, count(*) as n, sum(abs(real - f)) as ae, sum(real - f) as e, sum(real) as real from lg group by modelo)"""


@query("planner_accuracy", with_("lg", _RANKED, lg=_acc("cmp", [*SOURCES, "naive"], "internal is not null")))
def planner_accuracy(spark, sf):
    return rounded(cp.accuracy_table(cp.in_all_sources(table(spark, sf)), [*SOURCES, "naive"]))


@query("planner_accuracy_by_month", with_("lg", f"""
select mes, {', '.join(r(f"(1 - sum(abs(real - f)) filter (where modelo = '{c}') / sum(real) filter (where modelo = '{c}')) * 100", c) for c in [*SOURCES, 'naive'])}
from lg group by mes""", lg=_acc("cmp", [*SOURCES, "naive"], "internal is not null")))
def planner_accuracy_by_month(spark, sf):
    return rounded(cp.accuracy_by(cp.in_all_sources(table(spark, sf)), [*SOURCES, "naive"], ["mes"]))


_ERRORS = "abs(planner - real) as a, abs(ml_mean - real) as b, abs(internal - real) as c"
_WINNER = "case when a < b and a < c then 'planner' when b < a and b < c then 'ml_mean' when c < a and c < b then 'internal' end"


@query("closest_counts", with_("cmp", f"select fuente, count(*) as n from (select {_WINNER} as fuente from (select *, {_ERRORS} from cmp where internal is not null)) where fuente is not null group by 1"))
def closest_counts(spark, sf):
    return cp.closest_counts(cp.in_all_sources(table(spark, sf)), SOURCES)


@query("planner_by_planta", with_("cmp", f"""
select planta, count(*) as rows, {r('sum(real)', '"real_TO"')}, {r('sum(planner)', '"planner_TO"')},
       {', '.join(r(f'(1 - sum(abs({c} - real)) / sum(real)) * 100', f'acc_{c}') for c in [*SOURCES, 'naive'])},
       {', '.join(f"count(*) filter (where w = '{c}') as closest_{c}" for c in SOURCES)}
from (select *, {_WINNER} as w from (select *, {_ERRORS} from cmp where internal is not null)) group by planta"""))
def planner_by_planta(spark, sf):
    return rounded(cp.by_planta(cp.in_all_sources(table(spark, sf)), SOURCES, ["naive"]))


@query("planner_closer", with_("cmp", " union all ".join(
    f"select '{c}' as modelo, count(*) as n, count(*) filter (where abs(real - {c}) < abs(real - planner)) as gana from cmp" for c in ("ml_mean", "naive", "mean6"))))
def planner_closer(spark, sf):
    return cp.closer_than(table(spark, sf), ["ml_mean", "naive", "mean6"], "planner")


@query("planner_summary", with_("cmp", f"""
select coalesce(planta, 'Todas') as planta, count(*) as skus, {r('sum(real)', 'real')}, {', '.join(r(f'sum({c})', c) for c in SOURCES)},
       {', '.join(r(f'sum(abs({c} - real)) / sum(real)', f'wape_{c}') for c in SOURCES)}, {', '.join(r(f'1 - sum(abs({c} - real)) / sum(real)', f'acierto_{c}') for c in SOURCES)},
       {', '.join(r(f'sum({c}) / sum(real) - 1', f'sesgo_{c}') for c in SOURCES)}
from cmp where internal is not null group by grouping sets ((planta), ())"""))
def planner_summary(spark, sf):
    return rounded(cp.summary_by_planta(table(spark, sf), SOURCES))


@query("planner_errors", with_("cmp", f"""
select planta, mes, sku, {', '.join(r(f'{c} - real', f'error_{c}') for c in SOURCES)}, {', '.join(r(f'abs({c} - real)', f'abs_{c}') for c in SOURCES)},
       {', '.join(r(f'case when real <> 0 then ({c} - real) / real end', f'pct_{c}') for c in SOURCES)} from cmp"""))
def planner_errors(spark, sf):
    out = cp.with_errors(table(spark, sf), SOURCES)
    return rounded(out.select("planta", "mes", "sku", *[f"{k}_{c}" for k in ("error", "abs", "pct") for c in SOURCES]))


_TITLES = " ".join(f"when '{k}' then '{v}'" for k, v in cp.REASON_TITLES.items())


@query("excluded_report", with_("exc gone", f"""
select planta, mes, sku, {r('planner', 'planner')}, case reason {_TITLES} end as motivo, replace(detail, ' antes del origen', '') as detalle
from (select * from exc union all select * from gone)"""))
def excluded_report(spark, sf):
    missing = cp.add_internal(cp.compared(audited(spark, sf)), internal_marked(spark, sf))[1]
    return rounded(cp.excluded_with_titles(cp.excluded(audited(spark, sf)).unionByName(missing)))


@query("short_history", with_("aud fact", f"""
select a.planta, a.sku, case when a.first_reason = '{cp.LOW_HISTORY}' then coalesce(strftime((select min(fecha) from fact f where f.planta = a.planta and array_to_string(string_split(lower(f.sku), '/')[1:4], '/') = a.key), '%Y-%m-%d'), '') else '' end as primera_fecha_consumo
from (select planta, sku, key, min_by(reason, mes) as first_reason from aud where reason in ('{cp.LOW_HISTORY}', '{cp.NO_SERIES}') group by 1, 2, 3) a"""))
def short_history(spark, sf):
    return cp.short_history(audited(spark, sf), closed(spark, sf))


@query("planner_section", with_("lg", _RANKED, lg=_acc("cmpall", ["planner", *MODELS], f"planta = '{PLANTA}'"), cmpall=(("plan", "serk", "resk"), """
select p.planta, p.mes, p.sku, p.f as planner, r.real, r.ml_mean, r.naive, r.mean6
from (select *, replace(lower(sku), '/01/1/', '/01/') as key from plan) p join resk r on r.planta = p.planta and r.key = p.key and r.t = p.t""")))
def planner_section(spark, sf):
    """One planta, every planner strategy, all the months both sides have."""
    mine = planner_rows(spark, sf).where(F.col("planta") == PLANTA)
    full = cp.compared(cp.audit(mine, forecasts(spark, sf), closed_panel(spark, sf), MODELS))
    return rounded(cp.accuracy_table(full, ["planner", *MODELS]))


def _internal_comparison(spark, sf) -> DataFrame:
    """The internal forecast as the compared source, real above 0, with the planner forecast attached."""
    as_planner = internal_rows(spark, sf).withColumn("strategy", F.lit(""))
    full = cp.compared(cp.audit(as_planner, forecasts(spark, sf), closed_panel(spark, sf), MODELS)).withColumnRenamed("planner", "internal")
    return cp.attach_source(full.where(F.col("real") > 0), planner_rows(spark, sf).where(F.col("strategy") == "VMI"), "planner")


cte("intcmp", ("inte", "resk", "cal", "plan"), """
select i.planta, i.mes, i.sku, r.real, i.f as internal, r.ml_mean, r.naive, r.mean6, p.f as planner
from inte i join cal c on c.mes = i.mes join resk r on r.planta = i.planta and r.t = c.mi and r.key = replace(lower(i.sku), '/01/1/', '/01/')
     left join (select * from plan where strategy = 'VMI') p on p.planta = i.planta and p.mes = i.mes and p.sku = i.sku
where r.real > 0""")


@query("internal_comparison_a", with_("lg", _RANKED, lg=_acc("intcmp", ["internal", *MODELS])))
def internal_comparison_a(spark, sf):
    return rounded(cp.accuracy_table(_internal_comparison(spark, sf), ["internal", *MODELS]))


@query("internal_comparison_b", with_("lg", _RANKED, lg=_acc("intcmp", ["planner", "internal", *MODELS], "planner is not null")))
def internal_comparison_b(spark, sf):
    both = _internal_comparison(spark, sf).where(F.col("planner").isNotNull())
    return rounded(cp.accuracy_table(both, ["planner", "internal", *MODELS]))


@query("planner_keys", with_("plan fact", """
select distinct sku, replace(lower(sku), '/01/1/', '/01/') as clave, regexp_replace(replace(lower(sku), '/01/1/', '/01/'), '^([^/]+)/[^/]+/', '\\1/') as alterna, 'planner' as fuente from plan
union all
select distinct sku, array_to_string(string_split(lower(sku), '/')[1:4], '/'), regexp_replace(array_to_string(string_split(lower(sku), '/')[1:4], '/'), '^([^/]+)/[^/]+/', '\\1/'), 'datos' from fact"""))
def planner_keys(spark, sf):
    a = planner_rows(spark, sf).select(F.col("sku_planner").alias("sku")).distinct().withColumn("clave", planner_key(F.col("sku"))).withColumn("fuente", F.lit("planner"))
    b = closed(spark, sf).select("sku").distinct().withColumn("clave", dataset_key(F.col("sku"))).withColumn("fuente", F.lit("datos"))
    return a.unionByName(b).withColumn("alterna", alt_key(F.col("clave")))


# ---- source tables -------------------------------------------------------------------------------------------------------


def raw_assignment(spark, sf, mes: str) -> DataFrame:
    """The planner table of one month with the columns of its source."""
    name = next(k for k, v in MONTH_NAMES.items() if v == int(mes[5:7]))
    rows = planner_rows(spark, sf).where(F.col("mes") == mes)
    return rows.select(
        F.concat(F.col("planta"), F.lit(" ")).alias("Customer"), F.concat(F.lit("B"), F.col("b").cast("string")).alias("Grade"), F.regexp_extract("sku_planner", r"^[^/]+/(\d+)/", 1).cast("int").alias("Sub-grade"),
        F.regexp_extract("sku_planner", r"(\d+)gsm", 1).cast("int").alias("Grammage"), F.lit(2100).alias("Width"), F.col("product_sap").alias("Product"), F.col("strategy").alias("Strategy"),
        F.col("forecast_to").cast("string").alias("Plant Forecast"), F.lit("X").alias(f"{name}´{mes[2:4]} allocation"),
    )


@query("planner_assignment_scan", with_("plan span", f"""
select planta, mes, regexp_replace(sku, '^([^/]+)/([0-9]+)/1/', '\\1/\\2/') as sku_planner, product_sap::int as product_sap, strategy, {r('f', 'forecast_to')} from plan"""))
def planner_assignment_scan(spark, sf):
    """The tables of all months, every sub-grade, each read from its own source."""
    panel = closed_panel(spark, sf)
    tables = [src.read_assignment(raw_assignment(spark, sf, panel.label_of(mi))) for mi in range(panel.last_mi - TEST_MONTHS + 1, panel.last_mi + 1)]
    out = tables[0]
    for one in tables[1:]:
        out = out.unionByName(one)
    return rounded(out)


def raw_internal(spark, sf) -> DataFrame:
    """The internal table of all the months it has, one column per month, with its Result row."""
    panel = closed_panel(spark, sf)
    months = [panel.label_of(mi) for mi in range(panel.last_mi - TEST_MONTHS + 1, panel.last_mi + 1)]
    rows = internal_rows(spark, sf).where(F.col("mes").isin(months))
    wide = rows.groupBy("planta", "b", "gsm", "product_sap").pivot("mes", months).agg(F.sum("forecast_to"))
    names = {m: f"{m[5:7]}.{m[:4]}" for m in months}
    keys = [
        F.col("planta").alias("Customer"), F.concat(F.lit("B"), F.col("b").cast("string")).alias("Grade"), F.lit(1).alias("Sub-grade"),
        F.col("gsm").alias("Grammage"), F.lit(2100).alias("Width"), F.col("product_sap").alias("Product"),
    ]
    body = wide.select(*keys, *[F.coalesce(F.col(f"`{m}`"), F.lit(0.0)).alias(names[m]) for m in months])
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("Grade", "string"), ("Sub-grade", "int"), ("Grammage", "int"), ("Width", "int"), ("Product", "int"))]
    total = body.agg(*[F.sum(F.col(f"`{names[m]}`")).alias(names[m]) for m in months]).select(F.lit("Result").alias("Customer"), *nothing, *[F.col(f"`{names[m]}`") for m in months])
    return body.unionByName(total)


_LAST4 = """
select k.planta, m.mes, format('B{}/01/{}gsm/2100mm', k.b, k.gsm) as sku_planner, k.product_sap::int as product_sap, coalesce(i.f, 0) as f
from (select distinct planta, b, gsm, product_sap from inte where mes in (select mes from cal, span where mi between last_mi - 11 and last_mi)) k
     cross join (select mes from cal, span where mi between last_mi - 11 and last_mi) m
     left join inte i on i.planta = k.planta and i.b = k.b and i.gsm = k.gsm and i.mes = m.mes"""


@query("internal_forecast_scan", with_("inte cal span", f"select planta, mes, sku_planner, product_sap, {r('f', 'forecast_to')} from ({_LAST4})"))
def internal_forecast_scan(spark, sf):
    return rounded(src.read_internal(raw_internal(spark, sf)))


@query("internal_result_row", with_("inte cal span", f"""
select strftime(strptime(mes || '-01', '%Y-%m-%d'), '%m.%Y') as columna, {r('sum(f)', 'suma')}, {r('sum(f)', 'total')}, true as cuadra from ({_LAST4}) group by mes"""))
def internal_result_row(spark, sf):
    return rounded(src.internal_totals(raw_internal(spark, sf)))


def dictionary(spark, sf) -> DataFrame:
    """Product code to SKU over the monthly planner tables; the earliest month wins. Codes ending in 7 are left out."""
    files = planner_rows(spark, sf).where(F.col("b") % 10 != 7).select("product_sap", "sku_planner", F.col("mes").alias("archivo"), F.col("sku_planner").alias("fila"))
    return src.product_to_sku(files)


cte("dict", ("plan",), "select product_sap, min_by(sku, mes || sku) as sku_planner from plan where b % 10 <> 7 group by product_sap")


@query("product_dictionary", with_("dict", "select product_sap::int as product_sap, sku_planner from dict"))
def product_dictionary(spark, sf):
    return dictionary(spark, sf)


def internal_wide(spark, sf) -> tuple[DataFrame, list[str]]:
    panel = closed_panel(spark, sf)
    months = [panel.label_of(mi) for mi in range(panel.last_mi - TEST_MONTHS + 1, panel.last_mi + 1)]
    rows = internal_rows(spark, sf).where(F.col("mes").isin(months))
    return rows.groupBy("planta", "product_sap").pivot("mes", months).agg(F.sum("forecast_to")), months


_CODES = """
(select k.planta, k.product_sap, m.mes, i.f from (select distinct planta, product_sap from inte where mes in (select mes from cal, span where mi between last_mi - 11 and last_mi)) k
 cross join (select mes from cal, span where mi between last_mi - 11 and last_mi) m left join inte i on i.planta = k.planta and i.product_sap = k.product_sap and i.mes = m.mes)"""


@query("internal_by_code", with_("inte cal span dict", f"""
select w.planta, w.mes, d.sku_planner, w.product_sap::int as product_sap, '' as strategy, {r('w.f', 'forecast_to')} from {_CODES} w join dict d on d.product_sap = w.product_sap"""))
def internal_by_code(spark, sf):
    wide, months = internal_wide(spark, sf)
    return rounded(src.internal_by_code(wide, dictionary(spark, sf), months)[0])


@query("internal_by_code_unmatched", with_("inte cal span dict", f"select distinct planta, product_sap::int as product_sap from {_CODES} w where product_sap not in (select product_sap from dict)"))
def internal_by_code_unmatched(spark, sf):
    wide, months = internal_wide(spark, sf)
    return src.internal_by_code(wide, dictionary(spark, sf), months)[1].select("planta", "product_sap")


@query("internal_replace_planta", with_("intm plan", f"""
select planta, mes, sku as sku_planner, product_sap::int as product_sap, {r('f', 'forecast_to')} from intm where planta <> '{PLANTA}'
union all select planta, mes, sku, product_sap::int, {r('f', 'forecast_to')} from plan where planta = '{PLANTA}'"""))
def internal_replace_planta(spark, sf):
    other = planner_rows(spark, sf).select(*src.LONG_INTERNAL)
    return rounded(src.replace_planta(internal_marked(spark, sf), other, PLANTA))


@query("internal_all_zero_plantas", with_("inte", "select planta, bool_and(f = 0) as todo_cero from inte where b % 10 = 0 or planta <> 'ASIA' group by planta"))
def internal_all_zero_plantas(spark, sf):
    rows = internal_rows(spark, sf).where((F.col("b") % 10 == 0) | (F.col("planta") != "ASIA"))
    return src.all_zero_plantas(rows)
