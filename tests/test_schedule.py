"""Due times against a search minute by minute: ranges, steps, lists, names, both day fields, leap days."""

import datetime

import pytest
from pyspark.sql import functions as F

from vellum.functions import schedule

MINUTE = datetime.timedelta(minutes=1)


def fits(cron, t, both):
    """The expression read plainly, value by value."""
    minute, hour, day, month, week = cron.split()

    def one(field, value, names=()):
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            a, b = (names.index(x) if x in names else x for x in (a, b))
            low, high = (0, 99) if a == "*" else (int(a), int(b) if b != "" else (99 if step else int(a)))
            if low <= value <= high and (value - (low if a != "*" else (1 if field in (day, month) and a == "*" else 0))) % int(step or 1) == 0:
                return True
        return False

    weekday = t.isoweekday() % 7
    d = one(day, t.day)
    w = one(week, weekday, "sun mon tue wed thu fri sat".split()) or (weekday == 0 and one(week, 7, "sun mon tue wed thu fri sat".split()))
    days = d or w if not both and day[0] != "*" and week[0] != "*" else d and w
    return one(minute, t.minute) and one(hour, t.hour) and one(month, t.month) and days


CASES = [(cron, True) for _, cron, _ in schedule.TASKS] + [("*/20 8-10 * * *", False), ("5,50 23 28-31 * *", False), ("0 0 13 * fri", False), ("15 6-18/6 * 2 7", False), ("59 23 */10 * *", False)]


@pytest.mark.parametrize("cron,both", CASES)
def test_next_due_equals_minutes(spark, cron, both):
    starts = [datetime.datetime(2024, 2, 28, 7, 30), datetime.datetime(2024, 2, 28, 7, 29, 59), datetime.datetime(2023, 12, 31, 23, 59, 30), datetime.datetime(2024, 3, 1, 9, 0)]
    want = []
    for s in starts:
        t, found = s.replace(second=0) + MINUTE, []
        while len(found) < 3 and t < s + datetime.timedelta(days=420):
            if fits(cron, t, both):
                found.append(t)
            t += MINUTE
        want.append(found)
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(starts)] + [(9, None)], "i int, t timestamp_ntz")
    got = dict(rows.select("i", schedule.Schedule.of(cron, both).next_due(F.col("t"), 3)).collect())
    assert got.pop(9) is None
    assert [got[i] for i in range(len(starts))] == want


def test_leap_days_and_faults(spark):
    leap = spark.sql("select timestamp_ntz'2097-03-01' t").select(schedule.Schedule.of("0 0 29 2 *").next_due(F.col("t"))).first()[0]
    assert leap == [datetime.datetime(2104, 2, 29)]
    assert spark.sql("select timestamp_ntz'2024-03-01' t").select(schedule.Schedule.of("0 0 29 2 *").next_due(F.col("t"))).first()[0] == [datetime.datetime(2028, 2, 29)]
    assert spark.sql("select timestamp_ntz'2024-03-01' t").select(schedule.Schedule.of("0 0 31 2 *").next_due(F.col("t"))).first()[0] == []
    for bad in ("* * * *", "60 * * * *", "* * 0 * *", "5-2 * * * *", "*/0 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            schedule.Schedule.of(bad)
