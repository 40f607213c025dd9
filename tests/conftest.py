from __future__ import annotations

import os

import pytest

from casepulse.schemas import SCHEMAS
from casepulse.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = get_spark(
        "local[4]", "tests", **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(folder),
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
            "spark.ui.showConsoleProgress": "false",
        }
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """A frame of one of the declared tables from tuples; short rows end in NULLs."""

    def build(name, rows):
        schema = SCHEMAS[name]
        full = [tuple(row) + (None,) * (len(schema) - len(row)) for row in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def testdata():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder


def rows_of(df, *columns):
    """Rows as sorted tuples, NULLs first."""
    picked = df.select(*columns) if columns else df
    return sorted(
        (tuple(row) for row in picked.collect()),
        key=lambda row: tuple((value is not None, str(type(value)), value) for value in row),
    )
