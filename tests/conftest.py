import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from deltacell.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def cells(spark):
    """Dense cells of an array, NaN as NULL."""
    import numpy as np

    def make(array, grid_id="g"):
        a = np.asarray(array, dtype=float)
        rows = [
            (grid_id, r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])
        ]
        return spark.createDataFrame(rows, "grid_id string, row int, col int, value double")

    return make


@pytest.fixture
def array():
    """Cells back to an array of the given shape."""
    import numpy as np

    def make(df, shape, column="value"):
        out = np.full(shape, np.nan)
        for r in df.select("row", "col", column).collect():
            if r[2] is not None:
                out[r[0], r[1]] = r[2]
        return out

    return make
