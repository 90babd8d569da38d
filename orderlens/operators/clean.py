"""Cleaning: names, dates, discount scale, exact duplicates, quality counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators.fingerprints import distinct_rows
from orderlens.schema import DROP_COLUMNS


def clean_column_names(df: DataFrame) -> DataFrame:
    """snake_case headers: trimmed, lower case, blanks to underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def parse_dates(df: DataFrame, column: str = "order_date") -> DataFrame:
    """ISO text to date; unparseable text becomes null and the row stays."""
    if dict(df.dtypes)[column] == "date":
        return df
    return df.withColumn(column, F.try_to_date(F.col(column).cast("string"), "yyyy-MM-dd"))


def rescale_discount(df: DataFrame, column: str = "discount") -> DataFrame:
    """Divide every discount by 100 if the largest one exceeds 1.

    The decision is taken once for the whole data set, by a scalar subquery.
    """
    present = F.nanvl(column, F.lit(None)) if dict(df.dtypes)[column] == "double" else F.col(column)
    peak = df.agg(F.max(present)).scalar()
    kind = df.schema[column].dataType
    return df.withColumn(
        column, F.when(peak > 1, F.col(column) / 100).otherwise(F.col(column)).cast(kind)
    )


def drop_duplicates(df: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """Drop exact repeats.

    All columns are compared, so a unique row number keeps every row.  Columns
    named in ``ignore`` are left out of the comparison; the kept row then has
    the smallest values in them.  Rows are found by fingerprint and compared in full
    only where prints repeat; ``df`` is read more than once.
    """
    return distinct_rows(df, tuple(ignore))


def clean_data(df: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """Dates, discount scale and duplicates; losses and large values stay."""
    return drop_duplicates(rescale_discount(parse_dates(df)), ignore)


def drop_columns(df: DataFrame, columns: Iterable[str] = tuple(DROP_COLUMNS)) -> DataFrame:
    return df.drop(*columns)


def quality_report(raw: DataFrame) -> DataFrame:
    """(rule, n_rows) for everything worth a warning, in one pass over ``raw``."""
    date = F.try_to_date(F.col("order_date").cast("string"), "yyyy-MM-dd")
    rules = {
        "unparseable_order_date": date.isNull(),
        "negative_sales": F.col("sales") < 0,
        "non_positive_quantity": F.col("quantity") <= 0,
        "null_discount": F.col("discount").isNull(),
        "negative_discount": F.col("discount") < 0,
        "discount_above_one": F.col("discount") > 1,
        "null_profit": F.col("profit").isNull(),
    }
    counts = raw.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n_rows")


def removed_duplicates(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: line counts before and after, and how many were removed."""
    n_before, n_after = before.agg(F.count("*")).scalar(), after.agg(F.count("*")).scalar()
    return before.sparkSession.range(1).select(
        n_before.alias("rows_before"),
        n_after.alias("rows_after"),
        (n_before - n_after).alias("rows_removed"),
    )
