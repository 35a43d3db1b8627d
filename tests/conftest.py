import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stowage.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("stowage-tests", cores=4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_assets(spark):
    def make(*rows):
        """(path, type[, size]) rows."""
        full = [(p, f"Content/{p[6:]}.uasset", t, *(rest or [1]), 0) for p, t, *rest in rows]
        return spark.createDataFrame(
            full, "asset_path string, file_path string, asset_type string, file_size bigint, last_modified bigint"
        )

    return make


@pytest.fixture(scope="session")
def make_edges(spark):
    def make(*pairs):
        """(from, to[, soft]) rows."""
        rows = [(a, b, bool(rest and rest[0])) for a, b, *rest in pairs]
        return spark.createDataFrame(rows, "from_path string, to_path string, is_soft boolean")

    return make
