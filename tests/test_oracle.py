"""Every registered query against its SQL, on the smallest tables."""

import pytest

from catalog import load_all
from catalog.compare import check

REGISTRY = load_all()
SLOW = {"fit_binary", "fit_multiclass", "fit_regression", "fit_text", "fit_image", "impact_fitted_model"}


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql is not None))
def test_matches_sql(spark, data, name):
    ok, note = check(spark, data, name)
    assert ok, note


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql is None and n not in SLOW))
def test_runs(spark, data, name):
    assert REGISTRY[name].run(spark, data).count() > 0
