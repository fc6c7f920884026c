import datetime as dt
import random
import tempfile
from calendar import monthrange

import pytest

from caudal.session import local_session
from caudal.sources.exports import CONSUMPTION


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="caudal-test-")


PLANTAS = {"NORTE": 2.0, "OESTE": 5.5, "PUERTO": 9.0, "VALLE": 3.5}
GRADES = ["G10/01/90gsm/1800mm/KRAFT", "G20/02/140gsm/1800mm/KRAFT", "G30/01/200gsm/2400mm/LINER"]
LATE = {("OESTE", 2): 9, ("VALLE", 0): 14}  # series that begin so many months later


def make_rows(months: int = 30, seed: int = 11) -> list[tuple]:
    """Four plantas by three grades over working days from January 2023 on: a level for each planta, more in the second half of a
    month, a slow rise, and a grade that is only bought on some days of the week."""
    rng = random.Random(seed)
    rows = []
    for planta, level in PLANTAS.items():
        for k, sku in enumerate(GRADES):
            for m in range(LATE.get((planta, k), 0), months):
                year, month = 2023 + m // 12, m % 12 + 1
                for number in range(1, monthrange(year, month)[1] + 1):
                    day = dt.date(year, month, number)
                    if day.weekday() == 6 or (day.weekday() + k) % 3 == 0 and rng.random() < 0.8:
                        continue
                    amount = level * (1 + k / 2) * (1.0 if number <= 15 else 1.25) * (1 + m / 60)
                    rows.append((planta, sku, day, round(amount * rng.uniform(0.7, 1.4), 1)))
    return rows


@pytest.fixture(scope="session")
def fact(spark):
    return spark.createDataFrame(make_rows(), CONSUMPTION).cache()


@pytest.fixture(scope="session")
def make_fact(spark):
    return lambda rows: spark.createDataFrame(rows, CONSUMPTION)
