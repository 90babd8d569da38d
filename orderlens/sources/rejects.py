"""CSV load that loses no line: what does not fit goes to a reject table, with its reason."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.session import freeze
from orderlens.sources.csvfiles import (
    MISSING_TOKENS,
    EmptySource,
    MalformedSource,
    MissingSource,
    path_exists,
)

BLANK = "blank line"
OTHER_HEADER = "file with another header"
HEADER = "header"
REPEATED_HEADER = "repeated header"
OPEN_QUOTE = "open quote"
SHORT = "short line"
LONG = "long line"
BAD_VALUE = "bad value: "


@dataclass(frozen=True)
class Load:
    """Accepted rows, and (file, line, reason, n_lines) for all others."""

    accepted: DataFrame
    rejected: DataFrame

    def counts(self) -> DataFrame:
        """(reason, n_lines); accepted lines have a null reason. The sum is the lines read,
        less one header line a file."""
        kept = self.accepted.agg(F.count("*").alias("n_lines")).select(
            F.lit(None).cast("string").alias("reason"), "n_lines"
        )
        return kept.unionByName(self.rejected.groupBy("reason").agg(F.sum("n_lines").alias("n_lines")))


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, first_block): every line as it stands; a byte order mark is no part of it."""
    first = F.col("_metadata.file_block_start") == 0
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.when(F.startswith("value", F.lit("\ufeff")), F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("line"),
        first.alias("first_block"),
    )


def file_headers(lines: DataFrame) -> DataFrame:
    """(file, header): the first line of each file that isn't blank, by the least running number."""
    numbered = lines.filter("first_block AND trim(line) != ''").withColumn("at", F.monotonically_increasing_id())
    return numbered.groupBy("file").agg(F.min_by("line", "at").alias("header"))


def _commas(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))


def _n_fields(line: Column) -> Column:
    return _commas(F.regexp_replace(line, '"[^"]*"', "")) + 1


def _present(text: Column, missing: Sequence[str]) -> Column:
    return F.when(~F.trim(text).isin(list(missing)), text)


def tag_lines(
    lines: DataFrame, header: str, target: T.StructType, missing: Sequence[str] = MISSING_TOKENS
) -> DataFrame:
    """Each line with its ``reason`` (null where it fits) and its typed values ``v``.

    ``lines`` has (file, line, other_header).  Columns of the header that ``target`` does not
    name stay text.  A line of too many fields is not parsed, so its length does no harm.
    """
    names = next(csv.reader([header]))
    absent = [f.name for f in target if f.name not in names]
    if absent:
        raise MalformedSource(f"columns missing from the header: {absent}")
    if len(set(names)) < len(names):
        raise MalformedSource(f"columns named twice in the header: {header}")
    kinds = {f.name: f.dataType for f in target}
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    parser = fields.add("_wrong", T.StringType())
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_wrong"}
    line = F.col("line")
    # Fields are split outside of quotes, which is looked at only where all commas would be too many.
    few = (_commas(line) < len(names)) | (_n_fields(line) <= len(names))
    parsed = lines.withColumn("f", F.when(few, F.from_csv("line", parser.simpleString(), options)))
    present = {n: _present(F.col(f"f.c{i}"), missing) for i, n in enumerate(names)}
    values = {n: c.try_cast(kinds[n]) if n in kinds else c for n, c in present.items()}
    parsed = parsed.withColumn("v", F.struct(*[c.alias(n) for n, c in values.items()]))
    # A text always fits; a present value is looked for only where the typed one is null.
    typed = [n for n, kind in kinds.items() if not isinstance(kind, T.StringType)]
    bad = {n: F.col("v").getField(n).isNull() & present[n].isNotNull() for n in names if n in typed}
    parsed = parsed.withColumn("misfits", F.concat_ws(", ", *[F.when(c, F.lit(n)) for n, c in bad.items()]))
    misfits = F.col("misfits")
    reason = (
        F.when(F.trim(line) == "", BLANK)
        .when(F.col("other_header"), OTHER_HEADER)
        .when(line == header, HEADER)
        .when((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1, OPEN_QUOTE)
        .when(F.col("f").isNull(), LONG)
        .when(F.col("f._wrong").isNotNull(), SHORT)
        .when(misfits != "", F.concat(F.lit(BAD_VALUE), misfits))
    )
    return parsed.select("file", "line", reason.alias("reason"), "v")


def load_with_rejects(
    spark: SparkSession,
    path: str,
    target: T.StructType,
    root: str,
    missing: Sequence[str] = MISSING_TOKENS,
) -> Load:
    """Read header CSV files line by line into ``root``: accepted rows and rejected lines.

    The text is parsed once: one write puts accepted and rejected lines side by side under
    ``root``, and both results read their part.  The header is the first line of the first
    file by name.  A line is rejected when it is blank, when its file starts with another
    header, when it repeats the header, when its quotes are not paired, when it has too few
    or too many fields, or when a present value does not fit its column; nothing is filled or
    cut.  Equal rejected lines of a file are one row with their number ``n_lines``.  Line
    breaks inside quotes are not read here (they show as open quotes); use ``multi_line`` of
    the plain reader for them.  A file of blank lines has no header and all its lines are
    rejected; a file without lines counts nothing.
    """
    if not path_exists(spark, path):
        raise MissingSource(f"{path} does not exist")
    lines = raw_lines(spark, path)
    headers = freeze(file_headers(lines))
    header = headers.agg(F.min_by("header", "file")).first()[0]
    if header is None:
        raise EmptySource(f"{path} is empty")
    # The stored list of odd files has a known size: Spark broadcasts it or shuffles.
    odd = freeze(headers.filter(F.col("header") != header).select("file", F.lit(True).alias("odd")))
    marked = lines.join(odd, "file", "left").withColumn("other_header", F.col("odd").isNotNull())
    tagged = tag_lines(marked, header, target, missing)
    fits = F.col("reason").isNull()
    kinds = tagged.schema["v"].dataType
    stored = tagged.select(
        fits.alias("accepted"),
        F.when(~fits, F.col("file")).alias("file"),
        F.when(~fits, F.col("line")).alias("line"),
        "reason",
        F.when(fits, F.col("v")).alias("v"),
    )
    stored.write.mode("overwrite").partitionBy("accepted").parquet(root)
    back = spark.read.schema(stored.schema).parquet(root)
    accepted = back.filter("accepted").select(*[F.col("v").getField(n).alias(n) for n in kinds.names])
    return Load(accepted, _rejected(back.filter("NOT accepted")))


def _rejected(lines: DataFrame) -> DataFrame:
    """Equal lines of a file folded; the one header line that a file may have is taken off."""
    folded = lines.groupBy("file", "line", "reason").agg(F.count("*").alias("n_lines"))
    is_header = F.col("reason") == HEADER
    return (
        folded.withColumn("n_lines", F.when(is_header, F.col("n_lines") - 1).otherwise(F.col("n_lines")))
        .withColumn("reason", F.when(is_header, REPEATED_HEADER).otherwise(F.col("reason")))
        .filter("n_lines > 0")
        .select("file", "line", "reason", "n_lines")
    )
