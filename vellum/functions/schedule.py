"""Schedules: cron expressions as bit sets, and their next due times in column expressions."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The maintenance tasks of a project, when they run, and what makes them report.
TASKS = (
    ("handoff-freshness", "30 7 * * *", "handoff older than 24 hours with open threads"),
    ("audit-writes", "35 7 * * *", "more than 0 unlogged writes"),
    ("kb-audit", "0 9 * * 1", "always: audit, then propose a cleanup"),
    ("eval-recency", "0 9 1-7 * 1", "retrieval evaluation older than 30 days"),
    ("log-rotation", "0 9 1 1,4,7,10 *", "cleanup log over 200 KB or write log over 80 KB"),
)

#: Least and greatest value of each field: minute, hour, day of month, month, day of week (0 and 7 are Sunday).
FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
NAMES = {name: str(i) for names in ("jan feb mar apr may jun jul aug sep oct nov dec", "sun mon tue wed thu fri sat") for i, name in enumerate(names.split(), names[:1] == "j")}


def bits(field: str, low: int, high: int) -> int:
    """A field's values as bits: ``*``, numbers, names, ranges ``a-b``, steps ``/n`` and lists of them."""
    out = 0
    for part in field.lower().split(","):
        span, _, step = part.partition("/")
        first, _, last = span.partition("-")
        first, last = NAMES.get(first, first), NAMES.get(last, last)
        a, b = (low, high) if first == "*" else (int(first), int(last or (high if step else first)))
        if not (low <= a <= b <= high) or (step and int(step) < 1):
            raise ValueError(f"no cron field: {field}")
        for value in range(a, b + 1, int(step or 1)):
            out |= 1 << value
    return out


@dataclass(frozen=True)
class Schedule:
    """A compiled expression. ``both``: a day has to fit the day of the month and that of the week; by cron's own rule either will do where both are given."""

    minutes: int
    hours: int
    days: int
    months: int
    weekdays: int
    either: bool

    @classmethod
    def of(cls, cron: str, both: bool = False) -> Schedule:
        fields = cron.split()
        if len(fields) != len(FIELDS):
            raise ValueError(f"no cron expression: {cron}")
        sets = [bits(field, *limits) for field, limits in zip(fields, FIELDS, strict=True)]
        sets[4] = (sets[4] | sets[4] >> 7) & 0x7F
        return cls(*sets, either=not both and not fields[2].startswith("*") and not fields[4].startswith("*"))

    def times(self) -> list[int]:
        """Due minutes of a day."""
        return [60 * h + m for h in range(24) if self.hours >> h & 1 for m in range(60) if self.minutes >> m & 1]

    def on(self, day: datetime.date) -> bool:
        of_month, of_week = self.days >> day.day & 1, self.weekdays >> (day.isoweekday() % 7) & 1
        return bool(self.months >> day.month & 1 and (of_month | of_week if self.either else of_month & of_week))

    def longest_wait(self) -> int | None:
        """Days from one due day to the next at most, over forty years about 2100, which has no leap day; none if no day is due."""
        start = datetime.date(2080, 1, 1)
        due = [i for i in range(366 * 40) if self.on(start + datetime.timedelta(days=i))]
        return max(b - a for a, b in zip(due, due[1:], strict=False)) if len(due) > 1 else None

    def is_due_day(self, day: Column) -> Column:
        held = lambda mask, value: F.getbit(F.lit(mask).cast("long"), value) == 1
        of_month, of_week = held(self.days, F.dayofmonth(day)), held(self.weekdays, F.dayofweek(day) - 1)
        return held(self.months, F.month(day)) & ((of_month | of_week) if self.either else (of_month & of_week))

    def next_due(self, after: Column, n: int = 1) -> Column:
        """The next ``n`` due times after a time (of no zone), as an array; null of a null, empty if there are none.

        Only days that can be among them are looked at: as many as the longest wait asks for.
        """
        times, wait = self.times(), self.longest_wait()
        if wait is None or not times:
            return F.when(after.isNotNull(), F.array().cast("array<timestamp_ntz>"))
        days = F.sequence(F.to_date(after), F.date_add(F.to_date(after), wait * (-(-n // len(times)) + 1)))
        due = F.slice(F.filter(days, self.is_due_day), 1, -(-n // len(times)) + 1)  # the first day's times may be over
        at = F.array(*[F.lit(m) for m in times])
        every = F.flatten(F.transform(due, lambda d: F.transform(at, lambda m: d.cast("timestamp_ntz") + F.make_dt_interval(mins=m))))
        return F.slice(F.filter(every, lambda t: t > after.cast("timestamp_ntz")), 1, n)
