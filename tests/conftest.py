import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from shelfcast.session import get_spark
    extra = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="shelfcast-test-")}
    s = get_spark("local[4]", app="shelfcast-tests", shuffle_partitions=4, extra=extra)
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples of the given columns."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
