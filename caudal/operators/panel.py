"""The monthly panel: sparse monthly sums, densified per series with one window and no join.

A month before the first one of a series has no row (unknown); a later month without consumption is a row with 0.
Only monthly sums are kept, so a series is at most as long as the number of months whatever the size of the fact.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.dates import is_sunday, month_end, month_label, month_number, month_start, working_days
from caudal.session import broadcast_within, cut_lineage

SERIES = ["planta", "sku"]


def monthly_sums(df: DataFrame) -> DataFrame:
    """Consumption, days with consumption, rows and last day of every (planta, sku, month) that has rows."""
    return df.groupBy(*SERIES, month_number(F.col("fecha")).alias("ym")).agg(
        F.sum("consumo").alias("y"),
        F.count_if(F.col("consumo") > 0).alias("active_days"),
        F.count(F.lit(1)).alias("filas"),
        F.max("fecha").alias("last_day"),
    )


def fill_months(rows: DataFrame, keys: list[str], upto: Column, values: dict[str, Column], start: Column | None = None) -> DataFrame:
    """One row per month from the first of each key (or from `start`) to `upto`.

    Every present month is stretched up to the next one, so the gap is filled where the row already is: no grid,
    no join. `values` gives the expression of each column in a month that is present; absent months get 0.
    """
    order = Window.partitionBy(*keys).orderBy("mi")
    following = F.coalesce(F.lead("mi").over(order) - 1, upto)
    opening = F.col("mi") if start is None else F.when(F.lag("mi").over(order).isNull(), F.least(start, F.col("mi"))).otherwise(F.col("mi"))
    stretched = rows.withColumn("_upto", following).withColumn("_from", opening)
    months = stretched.withColumn("_mi", F.explode(F.sequence("_from", "_upto")))
    present = F.col("_mi") == F.col("mi")
    return months.select(
        *keys,
        F.col("_mi").alias("mi"),
        *[F.when(present, value).otherwise(F.lit(0.0)).alias(name) for name, value in values.items()],
    )


@dataclass(frozen=True)
class Panel:
    """Monthly sums plus the span of the data. `last_mi` is the last known month; `calendar_end` is the last day the
    calendar covers, which cuts the working days of its own month only."""

    monthly: DataFrame
    first_ym: int
    last_mi: int
    calendar_end: dt.date
    data_last_mi: int
    n_plantas: int
    n_series: int

    # ---- calendar --------------------------------------------------------------------------------------------------

    def label(self, mi: Column) -> Column:
        return month_label(mi + F.lit(self.first_ym))

    def index_of(self, label: str) -> int:
        return int(label[:4]) * 12 + int(label[5:7]) - 1 - self.first_ym

    def label_of(self, mi: int) -> str:
        year, month = divmod(mi + self.first_ym, 12)
        return f"{year:04d}-{month + 1:02d}"

    def first_day(self, mi: Column) -> Column:
        return month_start(mi + F.lit(self.first_ym))

    def last_day(self, mi: Column) -> Column:
        """Last calendar day of a month, cut at the last record when the month holds it."""
        end, cut = month_end(mi + F.lit(self.first_ym)), F.lit(self.calendar_end)
        return F.when(month_number(cut) == mi + F.lit(self.first_ym), F.least(end, cut)).otherwise(end)

    def business_days(self, mi: Column) -> Column:
        return working_days(self.first_day(mi), self.last_day(mi))

    def calendar_days(self, mi: Column) -> Column:
        return (F.date_diff(self.last_day(mi), self.first_day(mi)) + 1).cast("int")

    def month_of_year(self, mi: Column) -> Column:
        return ((mi + F.lit(self.first_ym)) % 12 + 1).cast("int")

    def months(self, ahead: int = 0) -> DataFrame:
        """The calendar as a table: one row per month."""
        spark = self.monthly.sparkSession
        mi = F.col("mi")
        return spark.range(self.last_mi + 1 + ahead).select(F.col("id").cast("int").alias("mi")).select(
            "mi", self.label(mi).alias("mes"), self.month_of_year(mi).alias("month_of_year"),
            self.business_days(mi).alias("business_days"), self.calendar_days(mi).alias("calendar_days"),
            self.first_day(mi).alias("month_first_date"),
        )

    # ---- tables ----------------------------------------------------------------------------------------------------

    def known(self) -> DataFrame:
        """The monthly sums up to the last known month, with the month index."""
        return self.monthly.withColumn("mi", F.col("ym") - F.lit(self.first_ym)).where(F.col("mi") <= self.last_mi)

    def dense(self, ahead: int = 0) -> DataFrame:
        """(planta, sku, mi, y, active_days): dense from the first month of each series; months ahead have null."""
        filled = fill_months(
            self.known(), SERIES, F.lit(self.last_mi + ahead),
            {"y": F.col("y"), "active_days": F.col("active_days").cast("double")},
        )
        if not ahead:
            return filled
        seen = F.col("mi") <= self.last_mi
        return filled.withColumn("y", F.when(seen, F.col("y"))).withColumn("active_days", F.when(seen, F.col("active_days")))

    def planta_months(self) -> DataFrame:
        """(planta, mi, y) on the full calendar of the data, 0 where the planta has nothing."""
        sums = self.known().groupBy("planta", "mi").agg(F.sum("y").alias("y"))
        return fill_months(sums, ["planta"], F.lit(self.last_mi), {"y": F.col("y")}, start=F.lit(0))

    def total_months(self) -> DataFrame:
        """(mi, y) of everything, on the full calendar."""
        return self.planta_months().groupBy("mi").agg(F.sum("y").alias("y"))

    def plantas(self) -> DataFrame:
        """(planta, planta_code): the plantas in order; a table as long as there are plantas."""
        names = self.monthly.select("planta").distinct()
        return names.withColumn("planta_code", (F.dense_rank().over(Window.orderBy("planta")) - 1).cast("int"))

    def planta_rows(self) -> int:
        """Upper bound of the rows of a planta by month table."""
        return self.n_plantas * (self.last_mi + 1)

    # ---- derived panels --------------------------------------------------------------------------------------------

    def masked(self, origin: int) -> Panel:
        """The same panel with every month after `origin` unknown."""
        return dataclasses.replace(self, last_mi=min(origin, self.last_mi))

    def completed_calendar(self) -> Panel:
        """The calendar reaches the end of the month in progress; its missing days count as days without consumption."""
        year, month = divmod(self.data_last_mi + self.first_ym, 12)
        following = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
        return dataclasses.replace(self, calendar_end=following - dt.timedelta(days=1))

    def with_month(self, mi: int, rows: DataFrame) -> Panel:
        """Put estimates (planta, sku, y, active_days) into month `mi` as if they had been observed."""
        kept = self.masked(mi - 1).known().select(*SERIES, "ym", "y", "active_days", "filas", "last_day")
        ym = F.lit(mi + self.first_ym)
        added = rows.select(*SERIES, ym.alias("ym"), "y", F.col("active_days").alias("active_days"), F.lit(1).cast("bigint").alias("filas"), month_end(ym).alias("last_day"))
        # Days estimated from a rate are not whole: the column becomes double on both sides.
        merged = kept.withColumn("active_days", F.col("active_days").cast("double")).unionByName(added)
        return dataclasses.replace(self, monthly=merged, last_mi=mi)

    def planta_side(self, df: DataFrame) -> DataFrame:
        """A planta by month table as the small side of a join, hinted only when its bound allows."""
        return broadcast_within(df, self.planta_rows())


def build_panel(df: DataFrame, keep: bool = True) -> Panel:
    """The panel of a consumption table; one pass over the fact and one row read by the driver."""
    monthly = monthly_sums(df)
    if keep:
        monthly = monthly.persist(StorageLevel.MEMORY_AND_DISK)
    span = monthly.agg(
        F.min("ym").alias("first"), F.max("ym").alias("last"), F.max("last_day").alias("day"),
        F.approx_count_distinct("planta").alias("plantas"),
        F.approx_count_distinct(F.concat_ws("\n", *SERIES)).alias("series"),
    ).first()
    if span["first"] is None:
        raise ValueError("the consumption table is empty")
    last = span["last"] - span["first"]
    # The counts only size joins; a quarter is added for the error of the sketch.
    return Panel(monthly, span["first"], last, span["day"], last, int(span["plantas"] * 1.25) + 1, int(span["series"] * 1.25) + 1)


def check_daily_sums(df: DataFrame, panel: Panel) -> DataFrame:
    """Per planta: months with rows, and months whose daily values do not add up to the monthly total
    (relative 1e-4, absolute 0.05)."""
    daily = df.groupBy(*SERIES, "fecha").agg(F.sum("consumo").alias("dia"))
    resummed = daily.groupBy(*SERIES, month_number(F.col("fecha")).alias("ym")).agg(F.sum("dia").alias("resum"))
    joined = panel.monthly.select(*SERIES, "ym", "y").join(resummed, [*SERIES, "ym"], "full")
    monthly, again = F.coalesce("y", F.lit(0.0)), F.coalesce("resum", F.lit(0.0))
    off = F.abs(again - monthly) > 0.05 + 1e-4 * F.abs(monthly)
    return joined.groupBy("planta").agg(F.count(F.lit(1)).alias("meses"), F.count_if(off).alias("meses_que_no_cuadran"))


def monthly_view(df: DataFrame) -> DataFrame:
    """(planta, sku, mes, consumo, dias_con_consumo): the sum and the number of rows of each month."""
    return df.groupBy(*SERIES, F.date_format("fecha", "yyyy-MM").alias("mes")).agg(
        F.sum("consumo").alias("consumo"), F.count(F.lit(1)).alias("dias_con_consumo")
    )


def month_to_date(df: DataFrame, first_ym: int, day: int) -> DataFrame:
    """(planta, sku, mi, mtd, active): the first `day` days of every month that has rows."""
    seen = F.dayofmonth("fecha") <= day
    return df.where(seen).groupBy(*SERIES, (month_number(F.col("fecha")) - F.lit(first_ym)).alias("mi")).agg(
        F.sum("consumo").alias("mtd"), F.countDistinct(F.when(F.col("consumo") > 0, F.col("fecha"))).cast("double").alias("active")
    )


def sorted_positions(panel: Panel) -> DataFrame:
    """Position of every series in (planta, sku) order. Ranges of the sorted names are numbered inside and shifted by the
    sizes of the ranges before; Spark chooses the ranges by a sample, so they are even whatever the names look like."""
    names = cut_lineage(panel.monthly.select(*SERIES).distinct().repartitionByRange(*SERIES).withColumn("block", F.spark_partition_id()))
    sizes = names.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges
    shifts = sizes.select("block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy(*SERIES))
    return names.join(F.broadcast(shifts), "block").select(*SERIES, (F.col("shift") + rank - 1).alias("series"))


def sunday_rows(df: DataFrame) -> DataFrame:
    return df.where(is_sunday(F.col("fecha")))
