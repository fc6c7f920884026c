"""Parsing of material descriptions and the keys that match them across sources."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual shape of a material description, and the Spanish month names of planner headers.
SKU_SHAPE = r"(?i)^([^/]+)/([^/]+)/(\d+)gsm/(\d+)mm(?:/([^/]+))?(?:/(.+))?$"
SKU_PARTS = {"grade": 1, "subgrade": 2, "gsm": 3, "ancho_mm": 4, "ancho_core": 5, "sufijo": 6}
MONTH_NAMES = {
    "ENE": 1, "FEB": 2, "MAR": 3, "ABR": 4, "MAY": 5, "JUN": 6, "JUL": 7,
    "AGO": 8, "SEP": 9, "SEPT": 9, "OCT": 10, "NOV": 11, "DIC": 12,
}
PLANNER_HEADER = r"^\s*([A-Za-z]+)\W*(\d{2})\b"
MONTH_COLUMN = r"^\s*(\d{1,2})\.(\d{4})\s*$"


def follows_shape(sku: Column) -> Column:
    return sku.rlike(SKU_SHAPE)


def sku_part(sku: Column, name: str) -> Column:
    """One named part of the description; null when it is absent or the description has another shape."""
    text = F.nullif(F.regexp_extract(sku, SKU_SHAPE, SKU_PARTS[name]), F.lit(""))
    return text.cast("int") if name in ("gsm", "ancho_mm") else text


def dataset_key(sku: Column) -> Column:
    """The first four parts in lower case: type, sub-grade, grammage and width."""
    return F.array_join(F.slice(F.split(F.lower(sku), "/"), 1, 4), "/")


def planner_key(sku: Column) -> Column:
    """Lower case without the third part when that part is `1`."""
    parts = F.split(F.lower(sku), "/")
    return F.array_join(F.filter(parts, lambda part, i: ~((i == 2) & (part == "1"))), "/")


def alt_key(key: Column) -> Column:
    """The key without its sub-grade (the second part)."""
    return F.array_join(F.filter(F.split(key, "/"), lambda _, i: i != 1), "/")


def padded(number: Column, width: int = 2) -> Column:
    """Zero padding that never cuts a longer number."""
    text = number.cast("int").cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def build_sku(grade: Column, sub_grade: Column, grammage: Column, width: Column) -> Column:
    return F.concat(
        F.trim(grade.cast("string")), F.lit("/"), padded(sub_grade), F.lit("/"),
        grammage.cast("int").cast("string"), F.lit("gsm/"), width.cast("int").cast("string"), F.lit("mm"),
    )


def header_month(header: Column) -> Column:
    """`SEPT´26 allocation` to `2026-09`; null when the header names no month."""
    names = F.create_map(*[F.lit(x) for pair in MONTH_NAMES.items() for x in pair])
    month = F.try_element_at(names, F.upper(F.regexp_extract(header, PLANNER_HEADER, 1)))
    year = F.regexp_extract(header, PLANNER_HEADER, 2)
    return F.when(month.isNotNull(), F.concat(F.lit("20"), year, F.lit("-"), padded(month)))


def month_of_column(name: str) -> str | None:
    """The same for one column name, read by the driver with the schema."""
    found = re.match(MONTH_COLUMN, name)
    return f"{found[2]}-{int(found[1]):02d}" if found and 1 <= int(found[1]) <= 12 else None


def column_month(label: Column) -> Column:
    """`06.2026` to `2026-06`; null when the label is no month."""
    month = F.nullif(F.regexp_extract(label, MONTH_COLUMN, 1), F.lit("")).cast("int")
    year = F.regexp_extract(label, MONTH_COLUMN, 2)
    return F.when(month.between(1, 12), F.concat(year, F.lit("-"), padded(month)))


def export_day(text: Column) -> Column:
    """`dd.MM.yyyy` to a date; anything else gives null."""
    return F.try_to_date(text, "dd.MM.yyyy")
