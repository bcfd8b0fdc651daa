import numpy as np
import pytest

from brookline.operators import advisor


@pytest.mark.parametrize("n", [0, 1, 2, 30, 31, 200])
@pytest.mark.parametrize("spread", [3, 1 << 12, 1 << 24, 1 << 45])
def test_middle(spark, n, spread):
    values = sorted(map(int, np.random.default_rng(n).integers(1, spread, n)))
    row = advisor.middle(spark.createDataFrame([(v,) for v in values], "total_ns long")).first()
    assert tuple(row) == ((values[(n - 1) // 2], values[n // 2]) if n else (None, None))
