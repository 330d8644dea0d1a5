"""One small session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brambling.session import session, ship

    made = session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.driver.memory": "4g",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    made.sparkContext.setLogLevel("OFF")
    yield ship(made)
    made.stop()


@pytest.fixture(scope="session")
def small_dir() -> str:
    return str(DATA / "sf0.001")


def rows(df) -> list[tuple]:
    """Rows as a sorted multiset."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
