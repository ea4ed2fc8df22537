"""The anomaly of a forecast run against plain Python."""

import datetime as dt

import pytest

from hydrolens.operators import rain as R


def frame(spark, rows):
    return spark.createDataFrame(rows, "date date, precipitation_mm double")


def test_anomaly_of_the_week(spark):
    start, target = dt.date(2020, 1, 1), dt.date(2023, 6, 14)
    past = {start + dt.timedelta(i): float((i * 37) % 11) for i in range((target - start).days - 1) if i % 13}
    future = {target - dt.timedelta(1): 20.0, target: 40.0, target + dt.timedelta(1): 99.0}
    got = R.forecast_anomaly(frame(spark, list(future.items())), frame(spark, list(past.items())), target).collect()
    back = [dt.timedelta(i) for i in range(7)]
    sums = [sum(past.get(d - b, 0.0) for b in back) for d in past if d.isocalendar()[1] == target.isocalendar()[1]]
    now = sum({**past, **future}.get(target - b, 0.0) for b in back)
    assert [r[0] for r in got] == [pytest.approx(now / max(sum(sums) / len(sums), 1.0))]


def test_dry_weeks_and_no_record(spark):
    target = dt.date(2023, 6, 14)
    future, none = frame(spark, [(target, 8.0)]), frame(spark, [])
    dry = frame(spark, [(dt.date(2022, 6, 14), 0.0), (dt.date(2022, 6, 15), 0.1)])
    assert R.forecast_anomaly(future, dry, target).first()[0] == pytest.approx(8.0)
    assert R.forecast_anomaly(future, frame(spark, [(dt.date(2022, 1, 1), 5.0)]), target).first()[0] == 1.0
    assert R.forecast_anomaly(future, none, target).first()[0] == 1.0
    assert R.forecast_anomaly(none, none, target).first()[0] == 1.0
