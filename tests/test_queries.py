"""Every registered query against its SQL, on the smallest tables."""
import math

import pytest

from lodestrata.plans import registry
from tests.conftest import DATA


def rows(frame, columns):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
