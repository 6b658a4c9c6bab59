from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from heartwood.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("work")
    session = local_session(
        8, 4, **{"spark.checkpoint.dir": str(folder), "spark.sql.warehouse.dir": str(folder / "warehouse")}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF_DIR


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    from heartwood.operators.enrich import TEST_LEXICON
    from heartwood.plans.tables import build

    return build(spark, sf_dir, lexicon=TEST_LEXICON)


@pytest.fixture
def rows(spark):
    """Rows from a SQL VALUES list, e.g. rows("a, b", "(1, 'x'), (2, NULL)")."""
    return lambda names, values: spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
