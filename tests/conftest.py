import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfcast.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, app="tests", spark__sql__shuffle__partitions="4", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not present")
    return DATA


FACT_SCHEMA = (
    "Store int, Dept int, Date date, Weekly_Sales double, IsHoliday int, Temperature double, Fuel_Price double, "
    "MarkDown1 double, MarkDown2 double, MarkDown3 double, MarkDown4 double, MarkDown5 double, "
    "CPI double, Unemployment double, Type string, Size int"
)


def weeks(n, start=dt.date(2010, 2, 5)):
    return [start + dt.timedelta(days=7 * i) for i in range(n)]


def make_fact(spark, series, factors=lambda store, dept, i: (50.0, 3.0, 200.0, 8.0)):
    """series: {(store, dept): [(sales, holiday, promo), ...]} as a cleaned fact table."""
    rows = []
    for (store, dept), values in series.items():
        for i, (day, (sales, holiday, promo)) in enumerate(zip(weeks(len(values)), values)):
            temperature, fuel, cpi, jobs = factors(store, dept, i)
            rows.append((
                store, dept, day, sales, holiday, temperature, fuel, promo, 0.0, 0.0, 0.0, 0.0, cpi, jobs, "A", 1000
            ))
    return spark.createDataFrame(rows, FACT_SCHEMA)
