"""CSV input: resolve which file to use, read it, type it, report what failed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens import schema

# Texts a data-frame CSV reader takes as "missing".
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


class SourceError(Exception):
    """Base of all input errors."""


class MissingSource(SourceError, FileNotFoundError):
    """The path does not exist."""


class EmptySource(SourceError):
    """The path exists but holds no line at all."""


class MalformedSource(SourceError):
    """Lines do not fit the header or a value does not fit its column."""


@dataclass(frozen=True)
class Source:
    path: str
    kind: str  # "real" or "sample"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds the path, on whatever file system it lies."""
    try:
        spark.read.text(path)
    except AnalysisException:
        return False
    return True


def resolve_source(spark: SparkSession, real: str, sample: str) -> Source:
    """Prefer the real file, fall back to the synthetic sample, else raise."""
    if path_exists(spark, real):
        return Source(real, "real")
    if path_exists(spark, sample):
        return Source(sample, "sample")
    raise MissingSource(f"neither {real} nor {sample} exists; put a file there or write a sample")


def read_text_table(
    spark: SparkSession, path: str, strict: bool = True, multi_line: bool = False
) -> DataFrame:
    """Header CSV with every column as text, under its header name.

    ``strict`` fails on lines whose number of fields differs from the header;
    otherwise short lines are filled with nulls and surplus fields are cut.
    ``multi_line`` admits line breaks inside quotes; a file is then one task,
    so leave it off for large files.
    """
    if not path_exists(spark, path):
        raise MissingSource(f"{path} does not exist")
    if spark.read.text(path).isEmpty():
        raise EmptySource(f"{path} is empty")
    return (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("columnPruning", not strict)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .csv(path)
    )


def _present(name: str, missing: Sequence[str]):
    c = F.col(f"`{name}`")
    return F.when(~F.trim(c).isin(list(missing)), c)


def typed(
    raw: DataFrame, target: T.StructType, strict: bool = True, missing: Sequence[str] = MISSING_TOKENS
) -> DataFrame:
    """Project text columns onto ``target`` types by name.

    ``strict`` raises on the first value that does not fit; otherwise such a
    value becomes null and :func:`reject_counts` tells how many there were.
    """
    absent = [f.name for f in target if f.name not in raw.columns]
    if absent:
        raise MalformedSource(f"columns missing from the header: {absent}")
    out = []
    for field in target:
        text = _present(field.name, missing)
        if isinstance(field.dataType, T.StringType):
            value = text
        else:
            value = text.cast(field.dataType) if strict else text.try_cast(field.dataType)
        out.append(value.alias(field.name))
    return raw.select(*out)


def reject_counts(raw: DataFrame, target: T.StructType) -> DataFrame:
    """(column, n_rejected): present texts that do not convert, in one pass."""
    checks = []
    for field in target:
        text = _present(field.name, MISSING_TOKENS)
        bad = text.isNotNull() & text.try_cast(field.dataType).isNull()
        checks.append(F.count_if(bad).alias(field.name))
    counts = raw.agg(*checks)
    return counts.unpivot([], [f"`{f.name}`" for f in target], "column", "n_rejected")


def read_orders(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The delivered file: typed where its columns are known, text otherwise."""
    raw = read_text_table(spark, path, strict)
    known = {f.name: f.dataType for f in schema.SOURCE}
    target = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in raw.columns])
    return typed(raw, target, strict)


def load_data(spark: SparkSession, real: str, sample: str) -> DataFrame:
    """Load with fallback; ``source_kind`` tells real from synthetic rows."""
    source = resolve_source(spark, real, sample)
    return read_orders(spark, source.path).withColumn("source_kind", F.lit(source.kind))


def verify(df: DataFrame) -> None:
    """Read every row once and raise if a line or a value does not fit."""
    try:
        df.write.format("noop").mode("overwrite").save()
    except Exception as exc:
        raise MalformedSource(str(exc).splitlines()[0]) from exc


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-schema load of the clean CSV: decimals, any misfit fails the load."""
    return typed(read_text_table(spark, path), schema.STAGING, strict=True, missing=[""])


def read_bi(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """BI typing of the clean CSV: 64-bit whole numbers and plain doubles."""
    raw = read_text_table(spark, path, multi_line=multi_line)
    return typed(raw, schema.BI, strict=True, missing=[""])


def too_long(df: DataFrame) -> DataFrame:
    """(column, limit, n_too_long) for texts beyond their staging width."""
    widths = {c: w for c, w in schema.STAGING_WIDTHS.items() if c in df.columns}
    counts = df.agg(
        *[F.count_if(F.length(F.col(c).cast("string")) > w).alias(c) for c, w in widths.items()]
    )
    limit = F.create_map(*[F.lit(x) for kv in widths.items() for x in kv])
    long = counts.unpivot([], list(widths), "column", "n_too_long")
    return long.select("column", limit[F.col("column")].alias("limit"), "n_too_long")
