import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import local_session

    s = local_session("*", shuffle_partitions=8, app="ledgerline-tests")
    yield s
    s.stop()


def rows(df, order=None):
    """Collected rows as plain tuples, sorted for comparison."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((x is None, x if x is not None else 0) for x in t)) if order is None else out
