"""Sparse time measures against a plain loop over every key and every day."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from orderlens.operators import timelines as T
from orderlens.operators.calendar import date_table
from orderlens.operators.slicers import NONE, Slicers

ONE = timedelta(1)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "customer string, order_date date, sales double")
    return df.select("customer", "order_date", F.col("sales").cast("decimal(12,2)").alias("sales"), F.year("order_date").alias("year"))


def sample(n, seed, keys=12):
    rng = random.Random(seed)
    days = [date(2019, 3, 1) + timedelta(rng.randrange(1700)) for _ in range(n)]
    days += [date(2020, 2, 28), date(2020, 2, 29), date(2021, 2, 28), date(2023, 2, 28), date(2024, 2, 29)]
    return [(rng.choice([None, *"abcdefghijk"][:keys]), d, float(rng.randint(1, 900))) for d in days]


def back(d, months):
    n = d.year * 12 + d.month - 1 - months
    y, m = n // 12, n % 12 + 1
    for day in range(d.day, 27, -1):
        try:
            return date(y, m, day)
        except ValueError:
            pass
    return date(y, m, min(d.day, 28))


def ends_month(d):
    return (d + ONE).month != d.month


def month_end(d):
    while not ends_month(d):
        d += ONE
    return d


def plain(rows, slicers, monthly):
    """key -> period -> measures, day by day."""
    sold = defaultdict(lambda: defaultdict(float))
    for k, d, s in rows:
        sold[k][d] += s
    years = [r[1].year for r in rows]
    day, days = date(min(years), 1, 1), []
    while day <= date(max(years), 12, 31):
        inside = slicers.date_range is None or slicers.date_range[0] <= day <= slicers.date_range[1]
        if inside and (slicers.years is None or day.year in slicers.years):
            days.append(day)
        day += ONE
    periods = defaultdict(list)
    for d in days:
        periods[d.replace(day=1) if monthly else d].append(d)

    def add(own, keep):
        hit = [s for d, s in own.items() if keep(d)]
        return sum(hit) if hit else None

    out = {}
    for k, own in sold.items():
        for p, shown in periods.items():
            a, z = shown[0], shown[-1]

            def look(months, a=a, z=z, own=own):
                end = back(z, months)
                end = month_end(end) if monthly and ends_month(z) else end
                return add(own, lambda d: back(a, months) <= d <= end)

            now, ly, prev = add(own, lambda d: a <= d <= z), look(12), look(1)
            change = lambda ref: None if not ref else ((now or 0) - ref) / ref
            first = days[0]
            values = (
                now, ly, change(ly), add(own, lambda d: d.year == z.year and d <= z),
                change(prev), add(own, lambda d: d in picked and first <= d <= z) if (picked := set(days)) else None,
            )
            out[k, p] = tuple(None if v is None else round(v, 6) for v in values)
    return out


SLICERS = [
    NONE,
    Slicers(years=[2020, 2022]),
    Slicers(date_range=(date(2020, 2, 29), date(2021, 2, 15))),
    Slicers(date_range=(date(2021, 5, 9), date(2021, 5, 20))),
    Slicers(date_range=(date(2020, 1, 31), date(2021, 2, 28))),
    Slicers(years=[2021], date_range=(date(2020, 12, 30), date(2021, 3, 30))),
]


@pytest.mark.parametrize("which", range(len(SLICERS)))
def test_months_equal_the_plain_loop(spark, which):
    rows, slicers = sample(60, which), SLICERS[which]
    df = frame(spark, rows)
    found = T.expand(T.intervals(df, date_table(df, "order_date"), ["customer"], slicers)).collect()
    got = {(r.customer, r["first"]): tuple(None if r[m] is None else round(r[m], 6) for m in T.MEASURES) for r in found}
    seen = {k for k, d, _ in rows if slicers.years is None and slicers.date_range is None or (k, d)}
    want = plain(rows, slicers, True)
    hidden = {k for k in seen if all(v == (None,) * 6 for (c, _), v in want.items() if c == k)}
    assert len(found) == len(got)
    assert {k: v for k, v in got.items() if k[0] not in hidden} == {k: v for k, v in want.items() if k[0] not in hidden}


@pytest.mark.parametrize("which", [0, 1, 2])
def test_days_equal_the_plain_loop(spark, which):
    rows, slicers = sample(25, which, 3), SLICERS[which]
    df = frame(spark, rows)
    wanted = ["total_sales", "sales_ly", "sales_ytd", "running_total"]
    found = T.expand(T.intervals(df, date_table(df, "order_date"), ["customer"], slicers, wanted, T.DAY), T.DAY).collect()
    got = {(r.customer, r["first"]): tuple(None if r[m] is None else round(r[m], 6) for m in wanted) for r in found}
    want = {k: (v[0], v[1], v[3], v[5]) for k, v in plain(rows, slicers, False).items() if k[0] in {g[0] for g in got}}
    assert got == want


def test_rows_follow_the_sales_and_not_the_calendar(spark):
    rows = [(f"k{i}", date(2000, 6, 15), 1.0) for i in range(200)] + [("late", date(2049, 1, 1), 1.0)]
    df = frame(spark, rows)
    days = date_table(df, "order_date")
    assert days.count() > 18_000
    assert T.intervals(df, days, ["customer"], measures=["running_total"]).count() <= 2 * len(rows)
    assert T.intervals(df, days, ["customer"]).count() <= 7 * len(rows)
    assert T.intervals(df, days, ["customer"], measures=["sales_ly", "sales_ytd"], grain=T.DAY).count() <= 6 * len(rows)


def test_one_shuffle_of_lines_and_no_grid(spark, capsys):
    df = frame(spark, sample(50, 1))
    T.intervals(df, date_table(df, "order_date"), ["customer"], measures=["running_total"]).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_keys_without_dates_and_no_lines(spark):
    df = frame(spark, [("a", date(2022, 5, 1), 5.0), ("b", None, 7.0)])
    days = date_table(df, "order_date")
    rows = T.intervals(df, days, ["customer"], measures=["running_total"]).collect()
    assert {(r.customer, r["first"], r["last"], r.running_total) for r in rows} == {
        ("a", date(2022, 1, 1), date(2022, 4, 1), None), ("a", date(2022, 5, 1), date(2022, 12, 1), 5.0),
        ("b", date(2022, 1, 1), date(2022, 12, 1), None),
    }
    none = T.intervals(df.limit(0), days, ["customer"])
    assert none.collect() == []
    assert T.expand(T.intervals(df.limit(0), days)).count() == 12


def test_month_over_month_is_no_measure_of_days(spark):
    df = frame(spark, sample(3, 1))
    with pytest.raises(ValueError):
        T.intervals(df, date_table(df, "order_date"), grain=T.DAY)
