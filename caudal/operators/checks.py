"""Input checks of the consumption table, as one table of violations.

Row rules run together in one scan. The other rules first shrink the fact (to keys, days, months or series) with
partial aggregation, so a hot series or plant never meets in one task. The checks never correct anything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.functions.dates import is_sunday, month_end, month_label, month_number, working_days
from caudal.functions.skus import follows_shape
from caudal.functions.text import strip
from caudal.operators.panel import SERIES
from caudal.session import cut_lineage

REQUIRED = ["planta", "sku", "fecha", "consumo"]
KEY = ["planta", "sku", "fecha"]
DECLARED = {
    "planta": ("text", T.StringType), "sku": ("text", T.StringType), "fecha": ("a day", (T.DateType, T.TimestampType, T.TimestampNTZType)), "consumo": ("a number", T.NumericType),
}
EXAMPLES = 5
# The sketch is off by at most one part in SKETCH_ACCURACY of the ranks, a tenth of the half-width of the bracket.
SKETCH_ACCURACY = 10000
BRACKET = 0.001


@dataclass(frozen=True)
class Limits:
    peak_limit: float = 100.0
    spike_factor: float = 20.0
    rows_drop: float = 0.4
    max_day_gap: int = 3
    require_complete_last_month: bool = False


class InputError(ValueError):
    """The consumption table has errors; the message holds the findings and some examples."""


# ---- structure -----------------------------------------------------------------------------------------------------------


def structure_errors(df: DataFrame) -> list[tuple[str, str]]:
    """How the schema departs from the declared one, as (code, message); no data is read."""
    given = dict(zip(df.columns, (field.dataType for field in df.schema.fields), strict=True))
    departures = {
        "columns": [f"no {name} ({what})" for name, (what, _) in DECLARED.items() if name not in given],
        "types": [f"{name}: {given[name].simpleString()}, not {what}" for name, (what, kinds) in DECLARED.items() if name in given and not isinstance(given[name], kinds)],
    }
    return [(code, ", ".join(found)) for code, found in departures.items() if found]


def is_missing() -> Column:
    blank = [F.col(c).isNull() | ~F.col(c).rlike(r"(?U)\S") for c in SERIES]
    return blank[0] | blank[1] | F.col("fecha").isNull() | F.col("consumo").isNull() | F.isnan(F.col("consumo").cast("double"))


def missing(df: DataFrame) -> DataFrame:
    return df.where(is_missing()).select(*REQUIRED)


def present(df: DataFrame) -> DataFrame:
    return df.where(~is_missing())


# ---- error rules ---------------------------------------------------------------------------------------------------------


def is_negative(_: Limits) -> Column:
    return F.col("consumo") < 0


def has_untidy_key(_: Limits) -> Column:
    outer = r"(?U)^\s|\s$"
    return (F.col("planta") != F.upper("planta")) | F.col("planta").rlike(outer) | F.col("sku").rlike(outer)


def is_peak(limits: Limits) -> Column:
    return F.col("consumo") > limits.peak_limit


def negative(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return df.where(is_negative(limits)).select(*REQUIRED)


def keys(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return df.where(has_untidy_key(limits)).select(*REQUIRED)


def duplicate(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All the copies of a repeated key, with the number of copies.

    The counts are partial sums; only the repeated keys are joined back, so copies of a hot key stay where they are or
    are split by the adaptive skew join.
    """
    repeated = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copias")).where(F.col("copias") > 1)
    return df.join(repeated, KEY).select(*REQUIRED, "copias")


def duplicate_surplus(df: DataFrame) -> DataFrame:
    """One row: claves (keys that are held more than once), filas (rows with them) and sobrantes (rows beyond the first of each)."""
    copies = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return copies.agg(F.count(F.lit(1)).alias("claves"), rows.alias("filas"), (rows - F.count(F.lit(1))).alias("sobrantes"))


def near_duplicate_keys(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Distinct (planta, sku) pairs that are equal after folding case and spaces."""
    pairs = df.select(*SERIES).distinct()
    folded = [F.upper(strip(F.col("planta"))), F.regexp_replace(F.lower(F.col("sku")), r"(?U)\s+", "")]
    same = Window.partitionBy(*folded)
    return pairs.withColumn("_n", F.count(F.lit(1)).over(same)).where(F.col("_n") > 1).select(*SERIES)


def daily_rows(df: DataFrame) -> DataFrame:
    """(planta, fecha, filas): all that the calendar rules need, as many rows as plantas times days."""
    return df.groupBy("planta", F.to_date("fecha").alias("fecha")).agg(F.count(F.lit(1)).alias("filas"))


def month_rows(df: DataFrame) -> DataFrame:
    """Rows per month of the fact or of its daily counts."""
    rows = F.sum("filas") if "filas" in df.columns else F.count(F.lit(1))
    return df.groupBy(month_number(F.col("fecha")).alias("ym")).agg(rows.alias("filas"))


def month_gap(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Months without rows between two months that have rows."""
    following = F.lead("ym").over(Window.orderBy("ym"))
    holes = month_rows(df).withColumn("_next", following).where(F.col("_next") > F.col("ym") + 1)
    absent = holes.select(F.explode(F.sequence(F.col("ym") + 1, F.col("_next") - 1)).alias("ym"))
    return absent.select(month_label(F.col("ym")).alias("mes"))


def day_gap(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Runs of working days without any row. The table of days is as long as the calendar."""
    days = df.groupBy(F.to_date("fecha").alias("dia")).agg(F.lit(1).alias("_"))
    edges = days.agg(F.min("dia").alias("lo"), F.max("dia").alias("hi")).select(
        F.explode(F.array(F.date_sub("lo", 1), F.date_add("hi", 1))).alias("dia")
    )
    marks = days.where(~is_sunday(F.col("dia"))).select("dia").union(edges)
    pairs = marks.withColumn("_next", F.lead("dia").over(Window.orderBy("dia")))
    first, last = F.date_add("dia", 1), F.date_sub("_next", 1)
    runs = pairs.select(
        F.when(is_sunday(first), F.date_add(first, 1)).otherwise(first).alias("desde"),
        F.when(is_sunday(last), F.date_sub(last, 1)).otherwise(last).alias("hasta"),
        working_days(first, last).alias("dias_habiles"),
    )
    return runs.where(F.col("dias_habiles") >= limits.max_day_gap)


def last_month(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Working days between the last record and the end of its month."""
    last = df.agg(F.max("fecha").alias("ultimo"))
    rest = last.where(F.col("ultimo") < month_end(month_number(F.col("ultimo")))).select(
        "ultimo", F.explode(F.sequence(F.date_add("ultimo", 1), month_end(month_number(F.col("ultimo"))))).alias("dia")
    )
    return rest.where(~is_sunday(F.col("dia")))


# ---- warning rules -------------------------------------------------------------------------------------------------------


def daily_peak(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return df.where(is_peak(limits)).select(*REQUIRED)


def positive_medians(df: DataFrame) -> DataFrame:
    """Exact median of the positive values of each series, without gathering a series in one task.

    A sketch of fixed size brackets the median; equal values collapse into counts spread over the cluster; only the
    counts inside the bracket are ordered, and those below it are added up.
    """
    rows = df.where(F.col("consumo") > 0)
    bracket = rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("_total"), F.percentile_approx("consumo", [0.5 - BRACKET, 0.5 + BRACKET], SKETCH_ACCURACY).alias("_q")
    )
    counts = rows.groupBy(*SERIES, "consumo").agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.join(bracket, SERIES).where(F.col("consumo") <= F.col("_q")[1])
    below = F.col("consumo") < F.col("_q")[0]
    # What lies below the bracket becomes one row per series by partial sums.
    squeezed = placed.groupBy(*SERIES, F.when(~below, F.col("consumo")).alias("_v")).agg(F.sum("_n").alias("_n"), F.first("_total").alias("_total"))
    upto = F.sum("_n").over(Window.partitionBy(*SERIES).orderBy(F.col("_v").asc_nulls_first()))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    return squeezed.withColumn("_upto", upto).groupBy(*SERIES).agg(
        ((F.min(F.when(F.col("_upto") >= low, F.col("_v"))) + F.min(F.when(F.col("_upto") >= high, F.col("_v")))) / 2.0).alias("mediana")
    )


def spike(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Values far above the median of the positive values of their series."""
    times = F.col("consumo") / F.col("mediana")
    joined = df.where(F.col("consumo") > 0).join(positive_medians(df), SERIES)
    return joined.where(times > limits.spike_factor).select(*REQUIRED, F.bround(times, 1).alias("veces_mediana"))


def rows_drop(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Months with far fewer rows than the calendar month before."""
    order = Window.orderBy("ym")
    before = F.when(F.lag("ym").over(order) == F.col("ym") - 1, F.lag("filas").over(order))
    table = month_rows(df).withColumn("filas_mes_anterior", before)
    fell = F.col("filas") < F.col("filas_mes_anterior") * (1 - limits.rows_drop)
    return table.where(fell).select(month_label(F.col("ym")).alias("mes"), "filas", "filas_mes_anterior")


def planta_set(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Plantas that appear or disappear in the last month, against all the earlier months (a table of plantas)."""
    seen = df.groupBy("planta").agg(F.min(month_number(F.col("fecha"))).alias("lo"), F.max(month_number(F.col("fecha"))).alias("hi"))
    table = seen.withColumn("ultimo", F.max("hi").over(Window.partitionBy(F.lit(1))))
    state = F.when(F.col("hi") < F.col("ultimo"), "desaparece").when(F.col("lo") == F.col("ultimo"), "nueva")
    return table.select("planta", state.alias("estado")).where(F.col("estado").isNotNull())


def sku_format(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return df.select("sku").distinct().where(~follows_shape(F.col("sku")))


ERROR_RULES: dict[str, Callable[[DataFrame, Limits], DataFrame]] = {
    "negative": negative,
    "duplicate": duplicate,
    "keys": keys,
    "near_duplicate_keys": near_duplicate_keys,
    "month_gap": month_gap,
    "day_gap": day_gap,
    "last_month": last_month,
}
WARNING_RULES: dict[str, Callable[[DataFrame, Limits], DataFrame]] = {
    "daily_peak": daily_peak,
    "spike": spike,
    "rows_drop": rows_drop,
    "planta_set": planta_set,
    "sku_format": sku_format,
}
ROW_RULES: dict[str, Callable[[Limits], Column]] = {"negative": is_negative, "keys": has_untidy_key, "daily_peak": is_peak}
# Rules that give the same answer on a reduced table: on the daily counts, or on the distinct series.
ON_DAYS = {"month_gap", "day_gap", "last_month", "rows_drop", "planta_set"}
ON_SERIES = {"near_duplicate_keys", "sku_format"}


# ---- report --------------------------------------------------------------------------------------------------------------


def _violation(rows: DataFrame, severity: Column | str, code: Column | str) -> DataFrame:
    """Rows of any rule in the common shape; whatever is not part of a fact row goes into `detail` as JSON."""
    extra = [c for c in rows.columns if c not in REQUIRED]
    have = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    text = lambda value: F.lit(value) if isinstance(value, str) else value
    return rows.select(
        text(severity).alias("severity"), text(code).alias("code"), have("planta", "string").alias("planta"), have("sku", "string").alias("sku"),
        have("fecha", "date").alias("fecha"), have("consumo", "double").alias("consumo"),
        (F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")).alias("detail"),
    )


def violations(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every finding: (severity, code, planta, sku, fecha, consumo, detail). Rows with missing values are reported
    and left out of the other rules."""
    good = present(df)
    flags = F.array_compact(F.array(*[F.when(test(limits), F.lit(code)) for code, test in ROW_RULES.items()]))
    by_row = good.select(*REQUIRED, F.explode(flags).alias("_code"))
    severity = F.when(F.col("_code").isin(list(WARNING_RULES)), F.lit("warning")).otherwise(F.lit("error"))
    by_row = by_row.select(
        severity.alias("severity"), F.col("_code").alias("code"), "planta", "sku", F.to_date("fecha").alias("fecha"),
        F.col("consumo").cast("double").alias("consumo"), F.lit(None).cast("string").alias("detail"),
    )
    out = _violation(missing(df), "error", "missing").unionByName(by_row)
    # Two small tables, computed once, feed seven of the rules: the fact is not scanned again for each of them.
    days, series = cut_lineage(daily_rows(good)), cut_lineage(good.select(*SERIES).distinct())
    for severity_name, rules in (("error", ERROR_RULES), ("warning", WARNING_RULES)):
        for code, rule in rules.items():
            if code in ROW_RULES or (code == "last_month" and not limits.require_complete_last_month):
                continue
            source = days if code in ON_DAYS else series if code in ON_SERIES else good
            out = out.unionByName(_violation(rule(source, limits), severity_name, code))
    return out


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def examples(found: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """The first `n` findings of each code; the window keeps only the top rows of each task before it shuffles."""
    order = Window.partitionBy("severity", "code").orderBy(
        F.col("planta").asc_nulls_last(), F.col("sku").asc_nulls_last(), F.col("fecha").asc_nulls_last(), F.col("consumo").asc_nulls_last(), F.col("detail").asc_nulls_last()
    )
    return found.withColumn("orden", F.row_number().over(order)).where(F.col("orden") <= n)


def validate(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Raise `InputError` when there are errors; otherwise return the warnings summary (severity, code, n)."""
    if departures := structure_errors(df):
        raise InputError(f"not a consumption table: {departures}")
    found = violations(df, limits)
    counts = summary(found)
    errors = counts.where(F.col("severity") == "error").orderBy("code").collect()  # as many rows as rules
    if errors:
        shown: dict[str, list[str]] = {row["code"]: [] for row in errors}
        for row in examples(found.where(F.col("severity") == "error")).orderBy("code", "orden").collect():  # EXAMPLES a rule
            shown[row["code"]].append(" / ".join(str(row[c]) for c in (*REQUIRED, "detail") if row[c] is not None))
        raise InputError("rules broken, " + "; ".join(f"{row['code']}: {row['n']} rows ({', '.join(shown[row['code']])})" for row in errors))
    return counts


def check_last_month_complete(df: DataFrame) -> None:
    """Stop when the last month of the table is not finished."""
    left = last_month(df).agg(F.count(F.lit(1)).alias("n"), F.max("ultimo").alias("last")).first()
    if left["n"]:
        raise InputError(f"{left['n']} working days are still to come in the month of {left['last']}, the latest day of the table")
