"""Where queries register, and the building blocks of their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.functions.numbers import tidy


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return register


# Ratios of small whole numbers often end in an exact half of the last digit, where the last bit of a sum decides the
# rounding. Both sides are moved by the same amount, far below the digits kept, before they are rounded.
OFF_TIES = 3e-10


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded: parallel sums differ in the last bits between engines."""
    return df.select(*[tidy(F.col(c) + F.lit(OFF_TIES), digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def r(expression: str, name: str, digits: int = 6) -> str:
    """The same rounding in the check SQL."""
    return f"round(({expression})::double + {OFF_TIES}::double, {digits}) + 0.0::double as {name}"


# Common table expressions of the check SQL; each lists what it needs. `fact` is the consumption table under test.
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


def with_(names: str | list[str], select: str, **replaced: tuple[tuple[str, ...], str]) -> str:
    """`with ... select`: the named expressions and all they need, in order; keyword arguments replace one."""
    table = {**CTES, **replaced}
    wanted = names.split() if isinstance(names, str) else names
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for need in table[name][0]:
            visit(need)
        done.append(name)

    for name in wanted:
        visit(name)
    parts = ",\n".join(f"{name} as (\n{table[name][1].strip()}\n)" for name in done)
    return f"with {parts}\n{select.strip()}"
