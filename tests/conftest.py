import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from touchline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "6g", "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def bronze(tmp_path_factory):
    from fixture_match import write_bronze
    return write_bronze(tmp_path_factory.mktemp("bronze"))


@pytest.fixture(scope="session")
def lake(spark, bronze, tmp_path_factory):
    """Silver, gold and baselines built from the raw fixture files."""
    from touchline.plans import lake as L
    from touchline.sources import raw
    root = str(tmp_path_factory.mktemp("lake"))
    L.build_silver(spark, bronze, root)
    L.build_gold(spark, root, raw.read_captains(spark, f"{bronze}/captains.json"), block=100)
    L.build_baselines(spark, root, min_frames=50)
    return root
