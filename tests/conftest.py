import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from leafledger.session import build_session, shared_dir  # noqa: E402

DATA = os.environ.get("LEAFLEDGER_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "leafledger-tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(session)
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture
def corpus(spark):
    """Build a corpus from ``{relpath: text or bytes}``."""

    def build(files: dict, sizes: dict | None = None):
        rows = []
        for path, payload in files.items():
            data = payload if isinstance(payload, bytes) else payload.encode()
            rows.append((path, (sizes or {}).get(path, len(data)), data))
        return spark.createDataFrame(rows, "relpath string, size_bytes long, content binary")

    return build


@pytest.fixture
def paths_of():
    return lambda df: sorted(r.relpath for r in df.select("relpath").collect())
