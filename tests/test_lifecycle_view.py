"""Life cycles kept up to date against the query over all periods."""

import random

import pytest

from tidechart.plans import lifecycle
from tidechart.plans.insights import track_lifecycle

SCHEMA = "chart string, period string, item long, rank int, chart_size int"


def period_rows(rng, chart, period, size=6):
    items = rng.sample(range(12), size)
    rows = [(chart, f"2024-{period:02d}", item, k + 1, size) for k, item in enumerate(items)]
    return rows[: size - 1] if rng.random() < 0.3 else rows  # some are not whole


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_ten_appends_equal_the_full_query(spark, tmp_path):
    rng, rows, base = random.Random(8), [], str(tmp_path)
    for k in range(1, 11):
        new = [r for chart in "ab" if rng.random() < 0.8 or k == 1 for r in period_rows(rng, chart, k)]
        rows += new
        lifecycle.append_periods(spark.createDataFrame(new, SCHEMA), base)
        if k in (1, 3, 10):
            assert told(lifecycle.lifecycle_view(spark, base)) == told(track_lifecycle(spark.createDataFrame(rows, SCHEMA)))


@pytest.mark.parametrize("lost", ["facts", "ends"])
def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, monkeypatch, lost):
    rng, base = random.Random(2), str(tmp_path)
    first, then = period_rows(rng, "a", 1) + period_rows(rng, "a", 2), period_rows(rng, "a", 3) + period_rows(rng, "b", 1)
    lifecycle.append_periods(spark.createDataFrame(first, SCHEMA), base)
    new = spark.createDataFrame(then, SCHEMA)
    real = lifecycle.upsert
    with monkeypatch.context() as m:

        def fails(df, base, name, *more):
            if name == (lifecycle.FACTS if lost == "facts" else lifecycle.ENDS):
                raise RuntimeError("lost")
            real(df, base, name, *more)

        m.setattr(lifecycle, "upsert", fails)
        with pytest.raises(RuntimeError):
            lifecycle.append_periods(new, base)
    want = told(track_lifecycle(spark.createDataFrame(first + then, SCHEMA)))
    for _ in range(2):
        lifecycle.append_periods(new, base)
        assert told(lifecycle.lifecycle_view(spark, base)) == want
    lifecycle.append_periods(spark.createDataFrame([("a", None, 1, 1, 6)], SCHEMA), base)
    assert told(lifecycle.lifecycle_view(spark, base)) == want
