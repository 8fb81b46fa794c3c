import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from findrisk.session import build_session  # noqa: E402

AS_OF = "2024-06-01 12:00:00"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "findrisk-tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Build a one-row findings frame from keyword values (all text unless typed)."""

    def build(**values):
        values.setdefault("finding_id", "f1")
        return spark.createDataFrame([tuple(values.values())], schema=_schema(values))

    return build


def _schema(values):
    kinds = {int: "int", float: "double", str: "string", bool: "boolean", type(None): "string"}
    return ", ".join(f"`{name}` {kinds[type(value)]}" for name, value in values.items())
