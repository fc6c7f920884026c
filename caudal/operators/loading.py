"""Review of an incremental load against the master, and fingerprints of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.functions.dates import month_label, month_number
from caudal.operators.panel import Panel

KEYS = ["planta", "sku", "fecha"]
POLICIES = ("detener", "usar_nuevo")
TOLERANCE = 1e-9


def compare_load(master: DataFrame, new: DataFrame) -> DataFrame:
    """One row per key of either side: (keys, actual, nuevo, dentro, distinto). New copies collapse first, so a single
    shuffle join by key answers every question about the load."""
    grouped = new.groupBy(*KEYS).agg(F.max("consumo").alias("nuevo"), F.min("consumo").alias("_min"))
    grouped = grouped.select(*KEYS, "nuevo", (F.col("nuevo") - F.col("_min") > TOLERANCE).alias("dentro"))
    joined = master.select(*KEYS, F.col("consumo").alias("actual")).join(grouped, KEYS, "full")
    differs = F.coalesce(F.abs(F.col("actual") - F.col("nuevo")) > TOLERANCE, F.lit(False))
    return joined.select(*KEYS, "actual", "nuevo", F.coalesce("dentro", F.lit(False)).alias("dentro"), differs.alias("distinto"))


def load_conflicts(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("distinto")).select(*KEYS, "actual", "nuevo")


def combined(compared: DataFrame) -> DataFrame:
    """The master with the new values in place."""
    return compared.select(*KEYS, F.coalesce("nuevo", "actual").alias("consumo"))


def load_summary(compared: DataFrame) -> DataFrame:
    """Row counts, conflicts and dates of the load, as one row of partial sums."""
    actual, new = F.col("actual").isNotNull(), F.col("nuevo").isNotNull()
    return compared.agg(
        F.count_if(actual).alias("filas_actuales"), F.count_if(new & ~actual).alias("filas_nuevas"), F.count_if(actual & new & ~F.col("distinto")).alias("filas_repetidas_iguales"),
        (F.count_if(F.col("distinto")) + F.count_if(F.col("dentro"))).alias("conflictos"), F.count(F.lit(1)).alias("filas_resultado"),
        F.max(F.when(actual, F.col("fecha"))).alias("ultimo_dia_actual"), F.min("fecha").alias("primer_dia_resultado"), F.max("fecha").alias("ultimo_dia_resultado"),
    )


def new_months(compared: DataFrame) -> DataFrame:
    sides = compared.groupBy(month_number(F.col("fecha")).alias("ym")).agg(F.count("actual").alias("a"), F.count("nuevo").alias("n"))
    return sides.where((F.col("a") == 0) & (F.col("n") > 0)).select(month_label(F.col("ym")).alias("mes"))


def new_plantas(compared: DataFrame) -> DataFrame:
    sides = compared.groupBy("planta").agg(F.count("actual").alias("a"), F.count("nuevo").alias("n"))
    return sides.where((F.col("a") == 0) & (F.col("n") > 0)).select("planta")


def review_findings(summary: DataFrame, policy: str = "detener") -> DataFrame:
    """(nivel, codigo, n): what the load itself says; conflicts stop it unless the new values are to be used."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; choose one of {POLICIES}")
    level = "warning" if policy == "usar_nuevo" else "error"
    found = F.when(F.col("conflictos") > 0, F.struct(F.lit(level).alias("nivel"), F.lit("conflictos").alias("codigo"), F.col("conflictos").alias("n"))).when(
        F.col("filas_nuevas") == 0, F.struct(F.lit("error").alias("nivel"), F.lit("sin_cambios").alias("codigo"), F.col("filas_repetidas_iguales").alias("n"))
    )
    return summary.select(found.alias("f")).where(F.col("f").isNotNull()).select("f.*")


# ---- fingerprints --------------------------------------------------------------------------------------------------------


MARK_PRIME = (1 << 61) - 1


def multiset_mark(text: Column) -> Column:
    """A mark of the rows whatever their order: two 60-bit numbers from the MD5 of each row's text, added up modulo a prime. Equal rows add up and
    don't cancel out; the marks of two tables add up to that of their union, so a load can carry one on."""
    digest = F.md5(text.cast("binary"))
    parts = [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in (0, 1)]
    return F.concat_ws("-", *[F.coalesce(F.sum(p) % F.lit(MARK_PRIME).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast("string") for p in parts])


def row_text(number: Column, *keys: Column) -> Column:
    """A row as text, its number in millionths; a null has a text of its own."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in (*keys, F.round(number * 1_000_000).cast("long"))])


def merged_marks(one: str, two: str) -> str:
    """The mark of two tables together."""
    return "-".join(str((int(a) + int(b)) % MARK_PRIME) for a, b in zip(one.split("-"), two.split("-"), strict=True))


def fingerprint(df: DataFrame) -> DataFrame:
    """(filas, total, huella) of a fact: independent of row order and of partitioning, one pass without a sort."""
    text = row_text(F.col("consumo"), F.col("planta"), F.col("sku"), F.date_format("fecha", "yyyy-MM-dd"))
    return df.agg(F.count(F.lit(1)).alias("filas"), F.round(F.sum("consumo"), 6).alias("total"), multiset_mark(text).alias("huella"))


def panel_fingerprint(panel: Panel) -> DataFrame:
    """The same of the monthly panel: series, months and rounded totals."""
    text = row_text(F.col("y"), F.col("planta"), F.col("sku"), panel.label(F.col("mi")))
    return panel.known().agg(F.count(F.lit(1)).alias("filas"), F.round(F.sum("y"), 6).alias("total"), multiset_mark(text).alias("huella"))


def check_meta(stored: dict, expected: dict, keys: list[str] | None = None) -> None:
    """Stop when a saved result was made for other data or settings."""
    different = [k for k in keys or list(expected) if stored.get(k) != expected[k]]
    if different:
        raise ValueError("the saved result is out of date: " + ", ".join(f"{k} stored {stored.get(k)!r}, now {expected[k]!r}" for k in different))


def expected_meta(panel: Panel, horizon: int, n_test: int, tuning: str = "none") -> dict:
    """What saved member forecasts must say about themselves; one row read by the driver."""
    mark = panel_fingerprint(panel).first()
    return {
        "data": f"{mark['filas']}:{mark['total']}:{mark['huella']}", "horizon": horizon, "test_first": panel.label_of(panel.last_mi - n_test + 1),
        "test_last": panel.label_of(panel.last_mi), "tuning": tuning,
    }


def alignment_problems(res: DataFrame, panel: Panel) -> DataFrame:
    """Stored rows (planta, sku, t, y) whose actual differs from the data (absolute 1e-6, relative 1e-5)."""
    known = panel.dense().select("planta", "sku", F.col("mi").alias("t"), F.col("y").alias("actual"))
    joined = res.select("planta", "sku", "t", "y").join(known, ["planta", "sku", "t"], "left")
    return joined.where(F.col("actual").isNull() | (F.abs(F.col("actual") - F.col("y")) > 1e-6 + 1e-5 * F.abs("y")))


def panel_mark(panel: Panel) -> str:
    """The fingerprint of a panel as one text; one row read by the driver."""
    mark = panel_fingerprint(panel).first()
    return f"{mark['filas']}:{mark['total']}:{mark['huella']}"


def run_record(
    df: DataFrame, forecast: DataFrame, run_id: str | None = None, created_at: str | None = None, strategy: str | None = None, cutoff_day: int | None = None,
    mark: str | None = None, warnings: DataFrame | None = None,
) -> DataFrame:
    """The manifest of a run as one JSON document: which run and when, strategy and cutoff, span, series and fingerprint of
    the data, warnings by code (severity, code, n), forecast totals by planta. What is not given is left out."""
    series = df.select("planta", "sku").distinct().agg(F.count(F.lit(1)).alias("series"))
    span = df.agg(F.count(F.lit(1)).alias("rows"), F.min("fecha").alias("first_date"), F.max("fecha").alias("last_date"))
    data = span.withColumn("_k", F.lit(1)).join(series.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn("panel", F.lit(mark).cast("string")).select(F.struct("*").alias("data"))
    by_planta = forecast.groupBy("planta").agg(F.bround(F.sum("ml_mean"), 3).alias("total"), F.count(F.lit(1)).alias("series"))
    output = by_planta.agg(
        F.sum("series").alias("rows"), F.bround(F.sum("total"), 3).alias("total_ml_mean"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("planta", "total")))).alias("by_planta"),
    ).select(F.struct("*").alias("output"))
    one = data.withColumn("_k", F.lit(1)).join(output.withColumn("_k", F.lit(1)), "_k")  # one row each
    parts = ["run_id", "created_at", "strategy", "data", "output"]
    if warnings is not None:  # a row for each rule at most
        by_code = warnings.groupBy("code").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("warnings"))
        one, parts = one.join(by_code.withColumn("_k", F.lit(1)), "_k"), [*parts, "warnings"]
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss") if created_at is None else F.lit(created_at)
    used = F.struct(F.lit(strategy).cast("string").alias("used"), F.lit(cutoff_day).cast("int").alias("cutoff_day"))
    named = one.withColumns({"run_id": F.lit(run_id).cast("string"), "created_at": when, "strategy": used})
    return named.select(F.to_json(F.struct(*parts)).alias("manifest"))


def run_row(manifest: DataFrame) -> DataFrame:
    """The row of the table of runs that a manifest stands for."""
    get = lambda path: F.get_json_object("manifest", path)
    return manifest.select(
        get("$.run_id").alias("run_id"), get("$.created_at").alias("creado_en"), get("$.strategy.used").alias("estrategia"), get("$.strategy.cutoff_day").cast("int").alias("corte"),
        get("$.data.last_date").alias("ultimo_dia"), get("$.data.rows").cast("bigint").alias("filas"), get("$.data.series").cast("bigint").alias("series"),
        get("$.output.rows").cast("bigint").alias("pronosticos"), get("$.output.total_ml_mean").cast("double").alias("total_TO"),
    )
