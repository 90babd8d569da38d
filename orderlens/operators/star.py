"""Star schema: dimensions with surrogate keys, the fact table, and its checks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.operators import keys
from orderlens.operators.joins import null_safe_join
from orderlens.operators.keys import number_rows  # noqa: F401
from orderlens.schema import DIM_CUSTOMER, DIM_DATE, DIM_GEOGRAPHY, DIM_PRODUCT, FACT_SALES
from orderlens.session import freeze
from orderlens.sources.tables import write_observed, write_table

GEO = ["country", "city", "region", "subregion"]


class IntegrityError(Exception):
    """A key, not-null or reference rule of the star is broken."""


@dataclass(frozen=True)
class Star:
    fact_sales: DataFrame
    dim_date: DataFrame
    dim_customer: DataFrame
    dim_product: DataFrame
    dim_geography: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "fact_sales": self.fact_sales,
            "dim_date": self.dim_date,
            "dim_customer": self.dim_customer,
            "dim_product": self.dim_product,
            "dim_geography": self.dim_geography,
        }

    def register(self) -> None:
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)


#: Columns of the flat lines that make up each dimension, and the natural key that its number stands for.
MEMBERS = {
    "dim_date": ["date_key", "order_date", "year", "quarter", "month", "month_name"],
    "dim_customer": ["customer_id", "customer", "industry", "segment"],
    "dim_product": ["product"],
    "dim_geography": GEO,
}
NUMBERED = {
    "dim_customer": ("customer_key", ["customer_id"]),
    "dim_product": ("product_key", ["product"]),
    "dim_geography": ("geography_key", GEO),
}
_TABLES = {"dim_date": DIM_DATE, "dim_customer": DIM_CUSTOMER, "dim_product": DIM_PRODUCT, "dim_geography": DIM_GEOGRAPHY}
_NAMES = {"order_date": "full_date", "customer": "customer_name", "product": "product_name"}


def dimension_members(lines: DataFrame) -> dict[str, DataFrame]:
    """Distinct members of all dimensions, from one scan of the lines, written once."""
    columns = [c for own in MEMBERS.values() for c in own]
    found = freeze(lines.groupingSets(list(MEMBERS.values()), *columns).agg(F.grouping_id().alias("_set")))
    # a bit per column, the first one highest, set where the column is not in the grouping
    left_out = {n: sum(1 << i for i, c in enumerate(reversed(columns)) if c not in own) for n, own in MEMBERS.items()}
    return {n: found.where(F.col("_set") == left_out[n]).select(*own) for n, own in MEMBERS.items()}


def dimension(name: str, members: DataFrame, registry: str) -> DataFrame:
    """One dimension of these members, with the numbers that the registry keeps for them."""
    if name in NUMBERED:
        key, natural = NUMBERED[name]
        known = keys.register(members.select(*natural).distinct(), f"{registry}/{name}", key)
        members = null_safe_join(members, known, natural)
    return members.withColumnsRenamed(_NAMES).select(*_TABLES[name])


def fact_sales(
    lines: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    geographies: DataFrame,
    null_safe_geography: bool = False,
    sale_id: str | None = None,
) -> DataFrame:
    """Resolve natural keys to surrogate keys; ``date_key`` passes through.

    No dimension is hinted: Spark broadcasts those whose size it knows to be
    small and shuffles, splitting skewed partitions, otherwise.  Customers, the largest,
    come last, when texts have become keys and rows are narrow.  ``sale_id``
    names a unique source column; without it an id is drawn that is unique in
    the table once written.  A null in a geography column drops the line,
    unless ``null_safe_geography`` lets null match null.
    """
    c = customers.select("customer_key", F.col("customer_id").alias("_cid"))
    p = products.select("product_key", F.col("product_name").alias("_pname"))
    g = geographies.withColumnsRenamed({k: f"_g_{k}" for k in GEO})

    def same(k: str):
        theirs = F.col(f"_g_{k}")
        return F.col(k).eqNullSafe(theirs) if null_safe_geography else F.col(k) == theirs

    joined = (
        lines.join(p, F.col("product") == F.col("_pname"))
        .join(g, reduce(lambda a, b: a & b, [same(k) for k in GEO]))
        .drop("product", *GEO)
        .join(c, F.col("customer_id") == F.col("_cid"))
    )
    ident = F.col(sale_id).cast("long") if sale_id else F.monotonically_increasing_id()
    return joined.withColumn("sale_id", ident).select(*FACT_SALES)


def build_star(
    spark: SparkSession,
    lines: DataFrame,
    root: str,
    null_safe_geography: bool = False,
    sale_id: str | None = None,
    check: bool = True,
    registry: str | None = None,
) -> Star:
    """Drop-and-recreate load of the five tables under ``root``.

    Numbers of members last: the registry of an earlier load (``registry``, by default a
    folder under ``root``) keeps them, and only new members get new ones.  Dimensions are
    written first, so the fact load reads them back with known sizes.  The fact is
    partitioned by year for date pruning; its rows and nulls are counted while it is written,
    and it is read back for its references, in one pass, and for the uniqueness of a given id.
    """
    members = dimension_members(lines)
    registry = registry or f"{root}/keys"

    def load(name: str) -> DataFrame:
        return write_table(dimension(name, members[name], registry), f"{root}/{name}")

    # The four loads are independent and each leaves cores idle, so they overlap.
    with ThreadPoolExecutor(len(members)) as pool:
        stored = dict(zip(members, pool.map(load, members), strict=True))
    fact = fact_sales(
        lines.drop("year"),
        stored["dim_customer"],
        stored["dim_product"],
        stored["dim_geography"],
        null_safe_geography,
        sale_id,
    ).withColumn("sale_year", F.floor(F.col("date_key") / 10000).cast("int"))
    watched = {"rows": F.count(F.lit(1))} | _nulls(REQUIRED["fact_sales"])
    written, seen = write_observed(fact, f"{root}/fact_sales", watched, ("sale_year",))
    star = Star(written, **stored)
    if check:
        enforce(constraint_violations(star, sale_ids=sale_id is not None, fact_nulls=seen))
        if (n := lines.count()) != seen["rows"]:
            raise IntegrityError(f"{n} staging rows became {seen['rows']} fact rows")
    return star


def read_star(
    spark: SparkSession, root: str, schemas: dict[str, T.StructType] | None = None
) -> Star:
    """Open stored tables; known ``schemas`` spare their inference."""
    names = ("fact_sales", "dim_date", "dim_customer", "dim_product", "dim_geography")
    read = lambda n: spark.read.schema(schemas[n]) if schemas else spark.read
    return Star(**{n: read(n).parquet(f"{root}/{n}") for n in names})


def validate_star(lines: DataFrame, star: Star) -> DataFrame:
    """One row: staging rows, fact rows and dimension sizes."""
    count = lambda df: df.agg(F.count("*")).scalar()
    return lines.sparkSession.range(1).select(
        count(lines).alias("staging_rows"),
        count(star.fact_sales).alias("fact_rows"),
        count(star.dim_customer).alias("customers"),
        count(star.dim_product).alias("products"),
        count(star.dim_geography).alias("geographies"),
    )


def _violations(df: DataFrame, table: str, rule: str) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_violations"),
    )


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first for each key; keys with a null are exempt, as in SQL."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in columns])
    repeats = df.filter(present).groupBy(*columns).agg(F.count("*").alias("c"))
    return repeats.agg(F.sum(F.col("c") - 1).alias("n"))


#: Columns that must have a value, and the dimension each fact column points to.
REQUIRED = {
    "dim_date": ["date_key", "full_date"],
    "dim_customer": ["customer_id"],
    "dim_product": ["product_name"],
    "fact_sales": ["sale_id", "order_id"],
}
REFERENCES = {
    "dim_date": "date_key",
    "dim_customer": "customer_key",
    "dim_product": "product_key",
    "dim_geography": "geography_key",
}


def _nulls(columns: list[str]) -> dict[str, Column]:
    return {c: F.count_if(F.col(c).isNull()) for c in columns}


def orphans(star: Star) -> DataFrame:
    """(table_name, rule, n_violations): fact rows whose non-null key has no dimension row.

    One pass over the fact: its rows become (dimension, key) pairs, equal pairs of a task are
    added up before they are sent, and the sums meet the keys of all dimensions at once.
    """
    pair = lambda dim, key: F.struct(F.lit(dim).alias("dim"), F.col(key).cast("long").alias("key"))
    pairs = star.fact_sales.select(F.explode(F.array(*[pair(d, k) for d, k in REFERENCES.items()])).alias("p"))
    used = pairs.select("p.*").filter("key IS NOT NULL").groupBy("dim", "key").agg(F.count("*").alias("n"))
    tables = star.tables()
    known = reduce(DataFrame.unionByName, [tables[d].select(pair(d, k).alias("p")) for d, k in REFERENCES.items()])
    lost = used.join(known.select("p.*"), ["dim", "key"], "left_anti").groupBy("dim").agg(F.sum("n").alias("n"))
    none = star.fact_sales.sparkSession.createDataFrame([(d, 0) for d in REFERENCES], "dim string, n long")
    return none.unionByName(lost).groupBy("dim").agg(F.sum("n").alias("n_violations")).select(
        F.lit("fact_sales").alias("table_name"),
        F.concat(F.lit("references("), "dim", F.lit(")")).alias("rule"),
        "n_violations",
    )


def constraint_violations(
    star: Star, sale_ids: bool = True, fact_nulls: dict[str, int] | None = None
) -> DataFrame:
    """(table_name, rule, n_violations) for every key, not-null and reference rule.

    ``sale_ids=False`` leaves out the uniqueness of ``sale_id``, the one rule
    that shuffles the whole fact; a drawn id is unique by construction.
    ``fact_nulls`` are null counts of the fact taken while it was written; without
    them they are counted here.
    """
    checks = []
    unique = {
        "dim_date": [["date_key"]],
        "dim_customer": [["customer_key"], ["customer_id"]],
        "dim_product": [["product_key"], ["product_name"]],
        "dim_geography": [["geography_key"], GEO],
        "fact_sales": [["sale_id"]] if sale_ids else [],
    }
    tables = star.tables()
    for name, groups in unique.items():
        for cols in groups:
            checks.append(
                _violations(duplicate_keys(tables[name], cols), name, f"unique({', '.join(cols)})")
            )
    for name, cols in REQUIRED.items():
        if name == "fact_sales" and fact_nulls is not None:
            rows = [(name, f"not_null({c})", fact_nulls[c]) for c in cols]
            schema = "table_name string, rule string, n_violations long"
            checks.append(tables[name].sparkSession.createDataFrame(rows, schema))
            continue
        nulls = tables[name].agg(*[n.alias(c) for c, n in _nulls(cols).items()])
        checks.append(
            nulls.unpivot([], cols, "c", "n").select(
                F.lit(name).alias("table_name"),
                F.concat(F.lit("not_null("), "c", F.lit(")")).alias("rule"),
                F.col("n").alias("n_violations"),
            )
        )
    return reduce(DataFrame.unionByName, [*checks, orphans(star)])


def enforce(violations: DataFrame) -> None:
    """Raise if any rule is broken; at most one row per rule reaches the driver."""
    broken = violations.filter("n_violations > 0").collect()
    if broken:
        raise IntegrityError("; ".join(f"{r.table_name} {r.rule}: {r.n_violations}" for r in broken))
