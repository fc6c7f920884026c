"""Exports, incremental loads, the star schema, stored predictions and run records."""

from __future__ import annotations

import datetime as dt
from calendar import monthrange

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.catalog.domain import MEMBERS, OPEN, brand, closed, closed_panel, consumption, frame, members, open_panel, shared, written_once
from caudal.catalog.registry import cte, query, r, rounded, with_
from caudal.catalog.scoring import combined
from caudal.functions.skus import column_month, header_month
from caudal.operators import loading as ld
from caudal.plans.strategies import common_series
from caudal.session import checkpoint_dir
from caudal.sources import exports as ex
from caudal.sources import store as st

# ---- exports -------------------------------------------------------------------------------------------------------------


def with_total(wide: DataFrame, days: list[str]) -> DataFrame:
    """A spacer column and the subtotal row of an export."""
    wide = wide.withColumn("#", F.lit(None).cast("double"))
    total = wide.groupBy().agg(*[F.sum(F.col(f"`{d}`")).alias(d) for d in days]).select(F.lit("Result").alias("planta"), F.lit("x").alias("sku"), *[F.col(f"`{d}`") for d in days], F.lit(None).cast("double").alias("#"))
    return wide.unionByName(total)


def every_wide_export(spark, sf, drop_zeros: bool = False) -> DataFrame:
    """All closed months, in a wide export for each year: one column per day, corrections below zero, subtotal row and spacer."""
    panel = closed_panel(spark, sf)
    first, last = closed(spark, sf).agg(F.min("fecha"), F.max("fecha")).first()
    year, month = map(int, panel.label_of(panel.last_mi).split("-"))
    last = max(last, dt.date(year, month, monthrange(year, month)[1]))
    out = None
    for year in range(first.year, last.year + 1):
        start, end = max(first, dt.date(year, 1, 1)), min(last, dt.date(year, 12, 31))
        days = [f"{start + dt.timedelta(days=k):%d.%m.%Y}" for k in range((end - start).days + 1)]
        rows = closed(spark, sf).where(F.col("fecha").between(F.lit(start), F.lit(end))).withColumn("d", F.date_format("fecha", "dd.MM.yyyy"))
        part = ex.read_export(with_total(rows.groupBy("planta", "sku").pivot("d", days).agg(F.sum(F.col("consumo") - 20.0)), days), drop_zeros)
        out = part if out is None else out.unionByName(part)
    return out


@query("wide_export_long", with_("closed", "select planta, sku, fecha, greatest(consumo - 20, 0) as consumo from closed"))
@query("wide_export_long_every_month", with_("closed", "select planta, sku, fecha, greatest(consumo - 20, 0) as consumo from closed"))
def wide_export_long_every_month(spark, sf):
    return every_wide_export(spark, sf)


@query("wide_export_without_zeros", with_("closed", "select planta, sku, fecha, greatest(consumo - 20, 0) as consumo from closed where consumo <> 20"))
@query("wide_export_without_zeros_every_month", with_("closed", "select planta, sku, fecha, greatest(consumo - 20, 0) as consumo from closed where consumo <> 20"))
def wide_export_without_zeros_every_month(spark, sf):
    return every_wide_export(spark, sf, drop_zeros=True)


@query("long_export_long", with_("closed", "select planta, sku, fecha, greatest(consumo - 20, 0) as consumo from closed where consumo <> 20 and day(fecha) <> 31"))
def long_export_long(spark, sf):
    day = F.when(F.dayofmonth("fecha") != 31, F.date_format("fecha", "dd.MM.yyyy")).otherwise(F.lit("#"))
    raw = closed(spark, sf).select(
        F.lit("R").alias("Sales Region"), F.col("planta").alias("Customer"), F.lit(1).alias("Material"), F.col("sku").alias("Descripción"), day.alias("Day"), (F.col("consumo") - 20.0).alias("TO")
    )
    return ex.read_export(raw, drop_zeros=True)


def overlapping(spark, sf) -> list[DataFrame]:
    """Two exports that share a year; one brand differs there."""
    df = closed(spark, sf)
    year = F.year("fecha")
    second = df.where(year >= 1999).withColumn("consumo", F.when((year == 1999) & (brand(F.col("sku")) == 22), F.col("consumo") + 1).otherwise(F.col("consumo")))
    return [df.where(year <= 1999), second]


@query("combined_exports", with_("closed", "select planta, sku, fecha, case when year(fecha) = 1999 and starts_with(sku, 'B22/') then consumo + 1 else consumo end as consumo from closed"))
def combined_exports(spark, sf):
    return ex.merged(overlapping(spark, sf)).select(*ex.KEYS, "consumo")


@query("export_conflicts", with_("closed", "select planta, sku, fecha, consumo as minimo, consumo + 1 as maximo from closed where year(fecha) = 1999 and starts_with(sku, 'B22/')"))
def export_conflicts(spark, sf):
    return ex.conflicts(ex.merged(overlapping(spark, sf))).select(*ex.KEYS, "minimo", "maximo")


@query("header_months", with_("closed", """
select distinct strftime(fecha, '%m.%Y') as columna, strftime(fecha, '%Y-%m') as mes_columna, list_extract(['ENE','FEB','MAR','ABR','MAY','JUN','JUL','AGO','SEPT','OCT','NOV','DIC'], month(fecha)) || '´' || strftime(fecha, '%y') || ' allocation' as cabecera,
       '20' || strftime(fecha, '%y-%m') as mes_cabecera from closed"""))
def header_months(spark, sf):
    names = F.array(*[F.lit(n) for n in ("ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEPT", "OCT", "NOV", "DIC")])
    rows = closed(spark, sf).select(
        F.date_format("fecha", "MM.yyyy").alias("columna"), F.concat(F.get(names, F.month("fecha") - 1), F.lit("´"), F.date_format("fecha", "yy"), F.lit(" allocation")).alias("cabecera")
    ).distinct()
    return rows.withColumn("mes_columna", column_month(F.col("columna"))).withColumn("mes_cabecera", header_month(F.col("cabecera")))


# ---- incremental load ----------------------------------------------------------------------------------------------------


def load_review(spark, sf) -> DataFrame:
    """Master before July 2001, new rows from June 2001 with other values for one brand."""

    def build() -> DataFrame:
        df = consumption(spark, sf)
        new = df.where(F.col("fecha") >= F.lit("2001-06-01").cast("date")).withColumn("consumo", F.when(brand(F.col("sku")) == 22, F.col("consumo") + 1).otherwise(F.col("consumo")))
        return ld.compare_load(df.where(F.col("fecha") < F.lit("2001-07-01").cast("date")), new)

    return written_once(spark, sf, "load_review", build)


cte("newr", ("consumption",), "select planta, sku, fecha, case when starts_with(sku, 'B22/') then consumo + 1 else consumo end as consumo from consumption where fecha >= date '2001-06-01'")
cte("mast", ("consumption",), "select * from consumption where fecha < date '2001-07-01'")


@query("load_conflicts", with_("newr mast", "select m.planta, m.sku, m.fecha, m.consumo as actual, n.consumo as nuevo from mast m join newr n using (planta, sku, fecha) where m.consumo <> n.consumo"))
def load_conflicts(spark, sf):
    return ld.load_conflicts(load_review(spark, sf))


@query("load_merged", with_("newr mast", "select * from newr union all select m.* from mast m where not exists (select 1 from newr n where n.planta = m.planta and n.sku = m.sku and n.fecha = m.fecha)"))
def load_merged(spark, sf):
    return ld.combined(load_review(spark, sf))


_BOTH = "mast m join newr n on n.planta = m.planta and n.sku = m.sku and n.fecha = m.fecha"
_LOAD_SUMMARY = f"""
select (select count(*) from mast) as filas_actuales, (select count(*) from newr) - (select count(*) from {_BOTH}) as filas_nuevas,
       (select count(*) from {_BOTH} where m.consumo = n.consumo) as filas_repetidas_iguales, (select count(*) from {_BOTH} where m.consumo <> n.consumo) as conflictos,
       (select count(*) from consumption) as filas_resultado, (select max(fecha) from mast) as ultimo_dia_actual, (select min(fecha) from consumption) as primer_dia_resultado,
       (select max(fecha) from consumption) as ultimo_dia_resultado"""


@query("load_summary", with_("newr mast", _LOAD_SUMMARY))
def load_summary(spark, sf):
    return ld.load_summary(load_review(spark, sf))


@query("load_findings", with_("newr mast", f"select 'error' as nivel, 'conflictos' as codigo, count(*) as n from {_BOTH} where m.consumo <> n.consumo having count(*) > 0"))
def load_findings(spark, sf):
    return ld.review_findings(ld.load_summary(load_review(spark, sf)))


@query("load_new_months", with_("newr mast", "select distinct strftime(fecha, '%Y-%m') as mes from newr where strftime(fecha, '%Y-%m') not in (select strftime(fecha, '%Y-%m') from mast)"))
def load_new_months(spark, sf):
    return ld.new_months(load_review(spark, sf))


@query("load_new_plantas", with_("consumption", "select distinct planta from consumption where planta = 'ASIA'"))
def load_new_plantas(spark, sf):
    df = consumption(spark, sf)
    return ld.new_plantas(ld.compare_load(df.where(F.col("planta") != "ASIA"), df))


# ---- star schema ---------------------------------------------------------------------------------------------------------


def star(spark, sf):
    return shared(spark, sf, "star", lambda: tuple(t.persist() for t in st.star_tables(consumption(spark, sf))))


@query("star_scan", with_("consumption", "select * from consumption"))
def star_scan(spark, sf):
    return st.read_star(*star(spark, sf))


@query("star_dims", with_("consumption", """
select 'plantas' as tabla, count(distinct planta) as filas, 1::bigint as primero, count(distinct planta) as ultimo from consumption
union all select 'skus', count(distinct sku), 1, count(distinct sku) from consumption"""))
def star_dims(spark, sf):
    p, s, _ = star(spark, sf)
    count = lambda t, name, i: t.agg(F.lit(name).alias("tabla"), F.count_distinct(i).alias("filas"), F.min(i).alias("primero"), F.max(i).alias("ultimo"))
    return count(p, "plantas", "planta_id").unionByName(count(s, "skus", "sku_id"))


@query("star_stable_ids", with_("consumption", "select count(distinct sku) as iguales, 0::bigint as distintos from consumption where fecha < date '1998-01-01'"))
def star_stable_ids(spark, sf):
    """Dims built from the first years keep their ids when the whole table is loaded after them."""
    df = consumption(spark, sf)
    old = st.star_tables(df.where(F.col("fecha") < F.lit("1998-01-01").cast("date")))[1]
    new = st.star_tables(df, skus=old)[1].select("descripcion", F.col("sku_id").alias("nuevo"))
    same = F.col("sku_id") == F.col("nuevo")
    return old.join(new, "descripcion").agg(F.count_if(same).alias("iguales"), F.count_if(~same).alias("distintos"))


@query("parse_sku", with_("consumption", """
select sku as descripcion, string_split(sku, '/')[1] as grade, string_split(sku, '/')[2] as subgrade, cast(replace(string_split(sku, '/')[3], 'gsm', '') as int) as gsm,
       cast(replace(string_split(sku, '/')[4], 'mm', '') as int) as ancho_mm, string_split(sku, '/')[5] as ancho_core, null::varchar as sufijo,
       array_to_string(string_split(lower(sku), '/')[1:4], '/') as clave_planificador
from (select distinct sku from consumption)"""))
def parse_sku(spark, sf):
    return st.describe_skus(consumption(spark, sf).select(F.col("sku").alias("descripcion")).distinct())


@query("store_roundtrip", with_("consumption", "select count(*) as filas, sum(consumo) as total, 0::bigint as diferencias from consumption"))
def store_roundtrip(spark, sf):
    """The fact rebuilt from the star tables against the fact: rows, total and planta by month sums that differ."""
    back = st.read_star(*star(spark, sf))
    off = st.roundtrip_differences(consumption(spark, sf), back).agg(F.count(F.lit(1)).alias("diferencias")).withColumn("_k", F.lit(1))
    return back.agg(F.count(F.lit(1)).alias("filas"), F.sum("consumo").alias("total")).withColumn("_k", F.lit(1)).join(off, "_k").drop("_k")


# ---- predictions ---------------------------------------------------------------------------------------------------------

CACHE_COLUMNS = {f"p_{m}": ("h1", m) for m in MEMBERS} | {"p_base_mean": ("directa", "ml_mean")}


def cache_predictions(spark, sf) -> DataFrame:
    return st.predictions_from_cache(combined(spark, sf), closed_panel(spark, sf).label, CACHE_COLUMNS)


_CACHE_SQL = " union all ".join(
    f"select e.planta, e.sku, t.mes as mes_objetivo, o.mes as mes_origen, '{s}' as estrategia, '{m}' as modelo, {c} as valor from ensembled e join cal t on t.mi = e.t join cal o on o.mi = e.t - 1"
    for c, (s, m) in CACHE_COLUMNS.items()
)
cte("cachep", ("ensembled", "cal"), _CACHE_SQL)


@query("predictions_from_cache", with_("cachep", f"select planta, sku, mes_objetivo, mes_origen, estrategia, modelo, {r('valor', 'valor')} from cachep"))
def predictions_from_cache(spark, sf):
    return rounded(cache_predictions(spark, sf))


def last_forecast(spark, sf) -> DataFrame:
    """A forecast table of the last month: the members under the names of the models."""
    panel = closed_panel(spark, sf)
    rows = combined(spark, sf).where(F.col("t") == panel.last_mi)
    return rows.select(
        "planta", "sku", panel.label(F.col("t")).alias("mes"), F.col("p_mean3").alias("lgbm"), F.col("p_mean6").alias("xgb"), F.col("p_mean12").alias("rf"),
        F.col("p_base_mean").alias("ml_mean"), F.col("p_naive").alias("naive"),
    )


cte("lastf", ("ensembled", "cal", "span"), """
select e.planta, e.sku, c.mes, o.mes as origen, p_mean3 as lgbm, p_mean6 as xgb, p_mean12 as rf, p_base_mean as ml_mean, p_naive as naive
from ensembled e cross join span join cal c on c.mi = e.t join cal o on o.mi = e.t - 1 where e.t = span.last_mi""")


@query("predictions_from_forecast", with_("lastf", " union all ".join(f"select planta, sku, mes as mes_objetivo, origen as mes_origen, 'h1' as estrategia, '{m}' as modelo, {r(m, 'valor')} from lastf" for m in ("lgbm", "xgb", "rf", "ml_mean", "naive"))))
def predictions_from_forecast(spark, sf):
    return rounded(st.predictions_from_forecast(last_forecast(spark, sf)))


def stored(spark, sf) -> str:
    """The prediction store: a first load, then a second one that replaces two of its blocks."""

    def build() -> str:
        panel = closed_panel(spark, sf)
        path = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{sf.rstrip('/').rsplit('/', 1)[-1]}/predictions"
        plantas, skus, _ = star(spark, sf)
        preds = cache_predictions(spark, sf)
        st.replace_predictions(preds.withColumn("valor", F.col("valor") + 1), path, plantas, skus, F.lit("2002-01-01 00:00:00"), "run-1")
        newer = preds.where((F.col("estrategia") == "h1") & F.col("mes_objetivo").isin(panel.label_of(panel.last_mi), panel.label_of(panel.last_mi - 1)))
        st.replace_predictions(newer, path, plantas, skus, F.lit("2002-02-01 00:00:00"), "run-2")
        return path

    return shared(spark, sf, "stored", build)


cte("storep", ("cachep",), """
select c.* exclude (valor), case when newer then valor else valor + 1 end as valor, case when newer then '2002-02-01 00:00:00' else '2002-01-01 00:00:00' end as creado_en, case when newer then 'run-2' else 'run-1' end as run_id
from (select *, estrategia = 'h1' and mes_objetivo in (select distinct mes_objetivo from cachep order by 1 desc limit 2) as newer from cachep) c""")


@query("prediction_store_scan", with_("storep", f"select planta, sku, mes_objetivo, mes_origen, estrategia, modelo, {r('valor', 'valor')}, creado_en, run_id from storep"))
def prediction_store_scan(spark, sf):
    return rounded(st.read_predictions(spark, stored(spark, sf)))


@query("prediction_store_filtered", with_("storep", f"select planta, sku, mes_objetivo, mes_origen, estrategia, modelo, {r('valor', 'valor')}, creado_en, run_id from storep where estrategia = 'h1' and modelo = 'mean6'"))
def prediction_store_filtered(spark, sf):
    return rounded(st.read_predictions(spark, stored(spark, sf), "h1", "mean6"))


@query("forecast_catalogue", with_("storep", f"select mes_objetivo as mes, estrategia, {r('sum(valor)', 'total_TO')}, count(*) as series, max(creado_en) as creado_en from storep where modelo = 'ml_mean' group by 1, 2"))
def forecast_catalogue(spark, sf):
    return rounded(st.catalogue(st.read_predictions(spark, stored(spark, sf))))


@query("prediction_unknown_dims", with_("lastf", "select distinct 'sku' as tipo, sku || '-X' as nombre from lastf where starts_with(sku, 'B21/') union all select distinct 'planta', lower(planta) from lastf where planta = 'ASIA'"))
def prediction_unknown_dims(spark, sf):
    plantas, skus, _ = star(spark, sf)
    preds = last_forecast(spark, sf).select(
        F.when(F.col("planta") == "ASIA", F.lower("planta")).otherwise(F.col("planta")).alias("planta"), F.when(brand(F.col("sku")) == 21, F.concat("sku", F.lit("-X"))).otherwise(F.col("sku")).alias("sku")
    )
    return st.unknown_dims(preds, plantas, skus)


@query("prediction_problems", with_("lastf", "select 'claves repetidas' as problema, count(*) as n from lastf where starts_with(sku, 'B21/') having count(*) > 0 union all select 'valores no finitos', count(*) from lastf where starts_with(sku, 'B22/') having count(*) > 0"))
def prediction_problems(spark, sf):
    preds = st.predictions_from_forecast(last_forecast(spark, sf).select("planta", "sku", "mes", "naive"))
    b = brand(F.col("sku"))
    odd = preds.withColumn("valor", F.when(b == 22, F.lit(float("inf"))).otherwise(F.col("valor")))
    return st.prediction_problems(odd.unionByName(odd.where(b == 21)))


@query("cache_alignment", with_("ensembled", "select planta, count(*) as desalineadas from ensembled where starts_with(sku, 'B22/') group by planta"))
def cache_alignment(spark, sf):
    moved = members(spark, sf).withColumn("y", F.when(brand(F.col("sku")) == 22, F.col("y") + 5).otherwise(F.col("y")))
    return ld.alignment_problems(moved, closed_panel(spark, sf)).groupBy("planta").agg(F.count(F.lit(1)).alias("desalineadas"))


def _mark_sql(*keys: str, number: str) -> str:
    """The mark of all rows as `multiset_mark` makes it."""
    text = " || '|' || ".join([*keys, f"cast(round({number} * 1000000) as bigint)"])
    pieces = [f"cast(coalesce(sum(cast('0x' || substr(md5({text}), {1 + 15 * k}, 15) as hugeint)) % {ld.MARK_PRIME}, 0) as varchar)" for k in (0, 1)]
    return " || '-' || ".join(pieces)


@query("fingerprints", with_("consumption monthly cal", f"""
select count(*) as filas, round(sum(consumo), 6) as total, {_mark_sql('planta', 'sku', "strftime(fecha, '%Y-%m-%d')", number='consumo')} as huella, 'consumo' as tabla from consumption
union all select count(*), round(sum(y), 6), {_mark_sql('planta', 'sku', 'c.mes', number='y')}, 'panel' from monthly m join cal c on c.mi = m.mi""", **OPEN))
def fingerprints(spark, sf):
    fact = ld.fingerprint(consumption(spark, sf)).withColumn("tabla", F.lit("consumo"))
    return fact.unionByName(ld.panel_fingerprint(open_panel(spark, sf)).withColumn("tabla", F.lit("panel")))


@query("run_record", with_("lastf closed", f"""
select 'run-1' as run_id, '2024-01-01 00:00:00' as created_at, 'nowcast_media' as used, 15 as cutoff_day, (select count(*) from closed) as rows, (select min(fecha) from closed)::varchar as first_date,
       (select max(fecha) from closed)::varchar as last_date, (select count(*) from (select distinct planta, sku from closed)) as data_series,
       (select count(*) from closed where isodow(fecha) = 7) as sundays, count(*) as series, {r('sum(ml_mean)', 'total_ml_mean', 1)} from lastf"""))
def run_record(spark, sf):
    """The manifest of a run, built as JSON and read back."""
    df = closed(spark, sf)
    found = df.where(F.weekday("fecha") == 6).agg(F.count(F.lit(1)).alias("n")).select(F.lit("warning").alias("severity"), F.lit("sundays").alias("code"), "n")
    one = ld.run_record(df, last_forecast(spark, sf), "run-1", "2024-01-01 00:00:00", "nowcast_media", 15, warnings=found)
    get = lambda path: F.get_json_object("manifest", path)
    return one.select(
        get("$.run_id").alias("run_id"), get("$.created_at").alias("created_at"), get("$.strategy.used").alias("used"), get("$.strategy.cutoff_day").cast("int").alias("cutoff_day"),
        get("$.data.series").cast("bigint").alias("data_series"), get("$.warnings.sundays").cast("bigint").alias("sundays"),
        get("$.data.rows").cast("bigint").alias("rows"), get("$.data.first_date").alias("first_date"), get("$.data.last_date").alias("last_date"),
        get("$.output.rows").cast("bigint").alias("series"), F.round(get("$.output.total_ml_mean").cast("double"), 1).alias("total_ml_mean"),
    )


@query("prediction_batches", with_("cachep lastf", "select estrategia, modelo, count(*) as n, " + r("sum(valor)", "valor") + " from (select estrategia, modelo, valor from cachep union all " + " union all ".join(
    f"select 'guardado', '{m}', {m} from lastf" for m in ("lgbm", "xgb", "rf", "ml_mean", "naive")) + ") group by 1, 2"))
def prediction_batches(spark, sf):
    union = st.all_batches([cache_predictions(spark, sf), st.predictions_from_forecast(last_forecast(spark, sf), "guardado")])
    return rounded(union.groupBy("estrategia", "modelo").agg(F.count(F.lit(1)).alias("n"), F.sum("valor").alias("valor")))


@query("runs_upsert", with_("cachep", """
select mes_objetivo as run_id, count(*) as filas, case when mes_objetivo >= (select max(mes_objetivo) from cachep) then 'nueva' else 'vieja' end as origen from cachep group by 1"""))
def runs_upsert(spark, sf):
    """A table of runs where the newest one is stored again."""
    runs = cache_predictions(spark, sf).groupBy(F.col("mes_objetivo").alias("run_id")).agg(F.count(F.lit(1)).alias("filas")).withColumn("origen", F.lit("vieja"))
    panel = closed_panel(spark, sf)
    again = runs.where(F.col("run_id") == panel.label_of(panel.last_mi)).withColumn("origen", F.lit("nueva"))
    return st.upsert(runs, again, ["run_id"])


cte("h2", ("panel", "span"), "select planta, sku, mi + 2 as t, p_naive, y from (select planta, sku, mi, y as p_naive, lead(y, 2) over (partition by planta, sku order by mi) as y from panel) cross join span where mi >= 3 and mi + 2 <= last_mi")


@query("two_months_with_reference", with_("h2 ensembled", f"""
select h.planta, h.sku, h.t::int as t, {r('h.y', 'y')}, {r('h.p_naive', 'p_naive')}, {r('e.p_base_mean', 'p_ref_h1')} from h2 h join ensembled e on e.planta = h.planta and e.sku = h.sku and e.t = h.t"""))
def two_months_with_reference(spark, sf):
    """The two-month table with the one-month reference attached, on the rows both have."""
    reference = combined(spark, sf).select("planta", "sku", "t", F.col("p_base_mean").alias("p_ref_h1"))
    joined = frame(spark, sf, 2).select("planta", "sku", "t", "y", "p_naive").join(reference, ["planta", "sku", "t"], "left")
    return rounded(common_series(joined, ["naive", "ref_h1"]))
