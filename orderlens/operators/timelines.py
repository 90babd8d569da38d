"""Time measures as intervals that follow the sales of each key.

A key's measures change only where one of its sales can touch them: in the sale's own
period, in the next one (month over month), a year later, and at the turn of the year.
Between those breakpoints every value stays the same, so a key is written as intervals
(first, last, values) that tile the selected periods, never as one row per calendar
period.  Rows grow with the sales of a key, whatever the length of the calendar.

Values come from one shuffle by key: last year's period and the month before are range
frames of exactly that distance over a period number, totals are frames from the start.
A window holds one key; it has at most a few rows per period in which the key sold.

Date slicers may start and end on any day.  A month that is cut counts its selected days;
last year and the month before count the days that lie as far back (29 February looks at
28 February, a part that reaches the end of its month looks at a whole end of month).
Year to date runs to the last selected day, the running total from the first one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions import aggregates as A
from orderlens.operators.slicers import NONE, Slicers

MEASURES = ("total_sales", "sales_ly", "sales_yoy", "sales_ytd", "sales_mom", "running_total")


@dataclass(frozen=True)
class Grain:
    """Months or days: the first day of a period, the periods after it, and their numbers."""

    unit: str

    @property
    def months(self) -> bool:
        return self.unit == "month"

    def first(self, day: Column) -> Column:
        return F.trunc(day, "month") if self.months else day

    def after(self, first: Column, n: int) -> Column:
        return F.add_months(first, n).cast("date") if self.months else F.date_add(first, n)

    def number(self, first: Column) -> Column:
        """Whole numbers in the order of the periods; last year's period is ``year`` lower."""
        if self.months:
            return F.year(first) * 12 + F.month(first)
        return F.year(first) * 10000 + F.month(first) * 100 + F.dayofmonth(first)

    @property
    def year(self) -> int:
        return 12 if self.months else 10000


MONTH, DAY = Grain("month"), Grain("day")


def _shift(day: date, months: int) -> date:
    """The day ``months`` earlier; one that the month lacks becomes its last."""
    n = day.year * 12 + day.month - 1 - months
    year, month = n // 12, n % 12 + 1
    last = (date(year + month // 12, month % 12 + 1, 1) - timedelta(1)).day
    return date(year, month, min(day.day, last))


def _month_end(day: date) -> bool:
    return (day + timedelta(1)).day == 1


def _back(lo: date, hi: date, months: int) -> tuple[date, date]:
    """The range so many months earlier."""
    end = _shift(hi, months)
    if _month_end(hi):
        end = _shift(date(hi.year, hi.month, 1), months - 1) - timedelta(1) if months else hi
    return _shift(lo, months), end


def _parts(grain: Grain, slicers: Slicers) -> dict[str, Column]:
    """What a period's sales mean to itself, to a year later, to the next period and to the year so far."""
    day, sales = F.col("order_date"), F.col("sales")
    whole = F.sum(sales)
    if slicers.date_range is None:
        return {"now": whole, "ly": whole, "prev": whole, "so_far": whole}
    lo, hi = slicers.date_range
    between = lambda a, b: F.sum(F.when(day.between(a, b), sales))
    if not grain.months:
        return {"now": between(lo, hi), "ly": whole, "prev": whole, "so_far": whole}

    def cut(months: int) -> Column:
        """Days that the selected ones look back at; months that are not cut at either end are whole."""
        a, b = _back(lo, hi, months)
        # before a cut start and after a cut end lie days of the same month that count for nothing
        out = (day >= a.replace(day=1)) & (day < a)
        return F.sum(F.when(~(out | ((day > b) & (F.trunc(day, "month") == F.lit(b.replace(day=1))))), sales))

    return {"now": between(lo, hi), "ly": cut(12), "prev": cut(1), "so_far": F.sum(F.when(day <= hi, sales))}


def _breakpoints(grain: Grain, measures: Sequence[str], start: Column) -> list[Column]:
    """Firsts of the periods in which a sale of ``start`` changes one of ``measures``."""
    wanted = set(measures)
    later = F.add_months(start, 12).cast("date")
    points = {"own": start}
    if wanted & {"total_sales", "sales_yoy", "sales_mom"}:
        points["next"] = grain.after(start, 1)
    if "sales_mom" in wanted:
        points["second"] = grain.after(start, 2)
    if wanted & {"sales_ly", "sales_yoy"}:
        points["year"] = later
        points["year_next"] = grain.after(later, 1)
        if not grain.months:  # 29 February looks back at 28 February
            twice = (F.month(start) == 2) & (F.dayofmonth(start) == 28)
            points["leap"] = F.when(twice, F.date_add(later, 2))
    if "sales_ytd" in wanted:
        points["new_year"] = F.make_date(F.year(start) + 1, F.lit(1), F.lit(1))
    return list(points.values())


def _spans(grain: Grain, slicers: Slicers, lo: Column, hi: Column) -> Column:
    """Selected stretches of periods, (first, last) each, inside the calendar."""
    if slicers.years is None:
        spans = [(None, None)]
    else:
        spans = [(date(y, 1, 1), date(y, 12, 31)) for y in sorted(set(slicers.years))]
    out = []
    for a, b in spans:
        if slicers.date_range is not None:
            a = max(filter(None, (a, slicers.date_range[0])))
            b = min(filter(None, (b, slicers.date_range[1])))
        first = F.greatest(lo, F.lit(a)) if a else lo
        last = F.least(hi, F.lit(b)) if b else hi
        out.append(F.struct(grain.first(first).alias("first"), grain.first(last).alias("last")))
    return F.array(*out)


def history(lines: DataFrame, slicers: Slicers) -> DataFrame:
    """Lines that can influence the selected periods: those years and the one before.

    Without a date slicer all lines count.  The year bound prunes partitions.
    """
    years = []
    if slicers.years is not None:
        years += [(min(slicers.years), max(slicers.years))]
    if slicers.date_range is not None:
        years += [(slicers.date_range[0].year, slicers.date_range[1].year)]
    if not years:
        return lines
    return lines.filter(F.col("year").between(min(y[0] for y in years) - 1, max(y[1] for y in years)))


def intervals(
    lines: DataFrame,
    calendar: DataFrame,
    by: Sequence[str] = (),
    slicers: Slicers = NONE,
    measures: Sequence[str] = MEASURES,
    grain: Grain = MONTH,
) -> DataFrame:
    """Keys, ``first`` and ``last`` (first days of periods), and the measures between them.

    The intervals of a key tile the selected part of the calendar; a key without a date
    on any line has one without values.  Without ``by`` the calendar alone is tiled.
    """
    if not grain.months and "sales_mom" in measures:
        raise ValueError("month over month is a measure of months")
    keys = list(by)
    scope = history(slicers.without_dates().apply(lines), slicers)
    sales = scope.groupBy(*keys, grain.first(F.col("order_date")).alias("own")).agg(
        *[part.alias(name) for name, part in _parts(grain, slicers).items()]
    )
    bounds = calendar.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    values = ["now", "ly", "prev", "so_far"]
    own, *later = _breakpoints(grain, measures, F.col("own"))
    carried = [F.when(F.col("own").isNotNull(), F.col(v)).alias(v) for v in values]
    none = [F.lit(None).cast(sales.schema[v].dataType).alias(v) for v in values]
    at = [F.struct(F.coalesce(own, lo).alias("first"), *carried)]
    at += [F.struct(p.alias("first"), *none) for p in later]
    points = sales.select(*keys, F.explode(F.array(*at)).alias("p")).select(*keys, "p.*").where("first IS NOT NULL")
    if not keys:
        points = points.unionByName(bounds.select(F.col("lo").alias("first"), *none))
    points = points.groupBy(*keys, "first").agg(*[F.sum(v).alias(v) for v in values])

    n = grain.number(F.col("first"))
    along = Window.partitionBy(*keys).orderBy("n")
    in_year = Window.partitionBy(*keys, "in_year").orderBy("n")
    exactly = lambda distance: along.rangeBetween(-distance, -distance)
    so_far = along.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ly = F.sum("ly").over(exactly(grain.year))
    if not grain.months:
        leap = (F.month("first") == 2) & (F.dayofmonth("first") == 29)
        ly = F.when(leap, F.sum("ly").over(exactly(grain.year + 1))).otherwise(ly)
    picked = F.col("now") if slicers.years is None else F.when(F.year("first").isin(list(slicers.years)), F.col("now"))
    found = points.withColumns({"n": n, "in_year": F.year("first")}).withColumns(
        {
            "ly_": ly,
            "prev_": F.sum("prev").over(exactly(1)),
            "ytd_": F.sum("so_far").over(in_year),
            "run_": F.sum(picked).over(so_far),
            "next_": F.lead("first").over(along),
            "lead_in": F.row_number().over(along) == 1,
        }
    )
    return _tiles(found, keys, measures, grain, slicers, lo, hi)


def _tiles(
    found: DataFrame, keys: list[str], measures: Sequence[str], grain: Grain, slicers: Slicers, lo: Column, hi: Column
) -> DataFrame:
    """Breakpoints with values as intervals, cut to the selected stretches."""

    def change(ref: str) -> Column:
        now = F.coalesce(F.col("now"), F.lit(0))
        return F.when(F.col(ref).isNotNull(), A.ratio(now - F.col(ref), F.col(ref)))

    value = {
        "total_sales": F.col("now").cast("double"),
        "sales_ly": F.col("ly_").cast("double"),
        "sales_yoy": change("ly_"),
        "sales_ytd": F.col("ytd_").cast("double"),
        "sales_mom": change("prev_"),
        "running_total": F.col("run_").cast("double"),
    }
    last = F.coalesce(grain.after(F.col("next_"), -1), hi)
    own = F.struct(F.col("first"), last.alias("last"), *[value[m].alias(m) for m in measures])
    before = F.struct(
        lo.alias("first"), grain.after(F.col("first"), -1).alias("last"), *[F.lit(None).cast("double").alias(m) for m in measures]
    )
    tiles = F.when(F.col("lead_in"), F.array(before, own)).otherwise(F.array(own))
    out = found.select(*keys, F.explode(tiles).alias("t")).select(*keys, "t.*")
    out = out.withColumn("span", F.explode(_spans(grain, slicers, lo, hi)))
    out = out.withColumns({"first": F.greatest("first", "span.first"), "last": F.least("last", "span.last")})
    return out.where(F.col("first") <= F.col("last")).drop("span")


def expand(found: DataFrame, grain: Grain = MONTH) -> DataFrame:
    """One row per key and period: ``first`` runs over all periods of each interval."""
    step = F.expr("interval 1 month" if grain.months else "interval 1 day")
    return found.withColumn("first", F.explode(F.sequence("first", "last", step))).drop("last")
