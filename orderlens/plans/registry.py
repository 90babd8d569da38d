"""Registered queries: one entry per operator, each over the whole tables.

Every entry takes (spark, sf_dir).  Flat-line queries read the stored clean
lines, library queries the stored star schema; both are derived from the given
tables on first use.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions import aggregates as A
from orderlens.functions import columns as C
from orderlens.operators import calendar as cal
from orderlens.operators import clean, keys, kpis, measures, profile, star, timelines
from orderlens.operators.features import engineer_features, with_discount_bucket
from orderlens.operators.measures import Slicers
from orderlens.plans import library, pipeline, report, visuals, warehouse
from orderlens.schema import CLEAN_COLUMNS, SOURCE
from orderlens.sources import csvfiles, rejects, tables, tpch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SOURCE_COLUMNS = [c for c in CLEAN_COLUMNS[:17] if c != "date_key"]
TOTAL_OF = ["sales", "profit"]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that every engine prints them alike."""
    decimals = [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in decimals})


def _register(name: str, query: Query) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: plain(query(spark, sf_dir))


def on_lines(name: str, make: Callable[[DataFrame], DataFrame]) -> None:
    _register(name, lambda spark, d: make(warehouse.lines(spark, d)))


def on_star(name: str, make: Callable[[star.Star], DataFrame]) -> None:
    _register(name, lambda spark, d: make(warehouse.star(spark, d)))


def on_calendar(name: str, make: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    _register(name, lambda spark, d: make(warehouse.lines(spark, d), warehouse.calendar(spark, d)))


def count_by(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.groupBy(*columns).agg(F.count("*").alias("n_lines"))


# -- sources and sinks ---------------------------------------------------------


def source_form(lines: DataFrame) -> DataFrame:
    """Clean lines under the delivered headers, as a file would hold them."""
    own = {"row_id": F.monotonically_increasing_id(), "license": F.sha2(F.col("customer"), 256)}
    names = {f.name: f.name.lower().replace(" ", "_") for f in SOURCE}
    return lines.select(*[(own[n] if n in own else F.col(n)).alias(header) for header, n in names.items()])


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    folder = warehouse.folder(spark, d, "csv_source")
    tables.write_csv(source_form(warehouse.lines(spark, d)), folder)
    return csvfiles.load_data(spark, f"{folder}-absent", folder)


def _clean_csv(spark: SparkSession, d: str, name: str) -> str:
    folder = warehouse.folder(spark, d, name)
    warehouse.each_slice(
        spark, d, lambda lines, append: tables.write_csv(lines.select(*CLEAN_COLUMNS), folder, packed=True, append=append)
    )
    return folder


def _io1(spark, d):
    return _loaded(spark, d).groupBy("source_kind").agg(F.count("*").alias("n_lines"))


def _io2(spark, d):
    # the running number of a line is not the same on every run
    return clean.clean_column_names(_loaded(spark, d)).drop("source_kind").withColumn("row_id", F.col("row_id").isNotNull())


def _faulty_lines(spark: SparkSession, d: str) -> str:
    """The delivered file with faults in it: by quantity, lines are cut, lengthened or misprinted."""
    columns = [c for c in SOURCE_COLUMNS if c not in ("order_date", "customer_id")]
    fields = [F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')) for c in columns]
    quantity, last = F.col("quantity"), columns.index("quantity")
    line = (
        F.when(quantity == 1, F.concat_ws(",", *fields[:-1]))
        .when(quantity == 2, F.concat_ws(",", *fields, F.lit("more")))
        .when(quantity == 3, F.concat_ws(",", *fields[:last], F.lit("three"), *fields[last + 1 :]))
        .when(quantity == 4, F.concat(F.concat_ws(",", *fields), F.lit('"')))
        .when(quantity == 5, F.lit(" "))
        .otherwise(F.concat_ws(",", *fields))
    )
    folder = warehouse.folder(spark, d, "csv_faulty")
    lines = warehouse.lines(spark, d).select(line.alias("value"))
    # Every file starts with its header, as the text writer has no header of its own.
    writer = lines.select(F.col("value").alias(",".join(columns))).write.mode("overwrite")
    writer.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\x01").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return folder


def _load_faulty(spark: SparkSession, d: str) -> rejects.Load:
    known = {"quantity": T.IntegerType(), "sales": T.DoubleType(), "discount": T.DoubleType(), "profit": T.DoubleType()}
    target = T.StructType([T.StructField(c, t) for c, t in known.items()])
    return rejects.load_with_rejects(spark, _faulty_lines(spark, d), target, warehouse.folder(spark, d, "csv_kept"))


def _io5(spark, d):
    source = warehouse.lines(spark, d).select(*CLEAN_COLUMNS)
    stored = tables.write_table(source, warehouse.folder(spark, d, "io5"), ("year",))
    return stored.groupBy("year").agg(F.count("*").alias("n_lines"), *[F.sum(c).alias(c) for c in TOTAL_OF])


def _io6(spark, d):
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in warehouse.star(spark, d).tables().items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _io9(spark, d):
    path = warehouse.folder(spark, d, "monthly_kpis")
    schema = warehouse.star(spark, d)
    library.refresh_monthly_kpis(spark, schema, path)
    years = [r.year for r in schema.dim_date.select("year").distinct().collect()]
    return library.refresh_monthly_kpis(spark, schema, path, [max(years)])


def _io9_incremental(spark, d):
    """Files arrive, a wrong one among them, and the wrong one is taken away again."""
    source, root = warehouse.folder(spark, d, "io9_source"), warehouse.folder(spark, d, "io9_incremental")
    fact = warehouse.star(spark, d).fact_sales.drop("sale_year")
    kept = library.monthly_refresh(root, fact.schema)
    early = F.col("date_key") < 19961015
    fact.where(early).write.mode("overwrite").parquet(f"{source}/early")
    kept.refresh(spark, source)
    fact.where(~early).write.mode("overwrite").parquet(f"{source}/late")
    wrong = fact.where(F.col("date_key").between(19960101, 19970631)).withColumn("order_id", -F.col("order_id"))
    wrong.write.mode("overwrite").parquet(f"{source}/wrong")
    kept.refresh(spark, source)
    keys.remove(spark, f"{source}/wrong")
    return kept.refresh(spark, source)


def _pipeline(spark, d):
    raw = _loaded(spark, d).drop("source_kind")
    return pipeline.prepare(raw).select(*CLEAN_COLUMNS)


_register("io1_load_with_fallback", _io1)
_register("io2_read_csv", _io2)
_register("io2_reject_counts", lambda s, d: _load_faulty(s, d).counts())
_register("io2_accepted_lines", lambda s, d: _load_faulty(s, d).accepted)
_register("io3_staging_load", lambda s, d: csvfiles.read_staging(s, _clean_csv(s, d, "csv_staging")))
_register("io4_bi_load", lambda s, d: csvfiles.read_bi(s, _clean_csv(s, d, "csv_bi")))
_register("io5_write_partitioned", _io5)
_register("io6_star_tables", _io6)
on_lines("io7_drop_columns", lambda df: clean.drop_columns(df.select(*SOURCE_COLUMNS), ["contact_name", "license"]))
_register("io9_refresh_monthly_kpis", _io9)
_register("io9_incremental_refresh", _io9_incremental)
_register("pipeline_clean_lines", _pipeline)

# -- profile and cleaning ------------------------------------------------------

RAW_NUMERIC = ["date_key", "sales", "quantity", "discount", "profit"]


def _typed_missing(df: DataFrame) -> DataFrame:
    df = df.select(*CLEAN_COLUMNS)
    return profile.column_types(df).join(profile.missing_values(df), "column")


def _renamed(df: DataFrame) -> DataFrame:
    headers = {c: f" {c.replace('_', ' ').title()} " for c in SOURCE_COLUMNS}
    return df.select(*[F.col(c).alias(h) for c, h in headers.items()])


def _dates(df: DataFrame) -> DataFrame:
    text = F.when(F.col("quantity") == 1, F.date_format("order_date", "dd.MM.yyyy")).otherwise(
        F.date_format("order_date", "yyyy-MM-dd")
    )
    parsed = clean.parse_dates(df.select(text.alias("order_date")))
    return parsed.groupBy(F.year("order_date").alias("year")).agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("order_date").isNull()).alias("n_bad")
    )


def _rescaled(df: DataFrame) -> DataFrame:
    percent = df.select((F.col("discount").cast("double") * 100).alias("discount"))
    return clean.rescale_discount(percent).groupBy("discount").agg(F.count("*").alias("n_lines"))


def _deduped(df: DataFrame) -> DataFrame:
    doubled = df.select(*SOURCE_COLUMNS, "line_seq")
    return clean.drop_duplicates(doubled.unionByName(doubled))


def _removed(df: DataFrame) -> DataFrame:
    doubled = df.select(*SOURCE_COLUMNS, "line_seq")
    doubled = doubled.unionByName(doubled)
    return clean.removed_duplicates(doubled, clean.drop_duplicates(doubled))


on_lines("pr1_shape", lambda df: profile.shape(df.select(*CLEAN_COLUMNS)))
on_lines("pr2_column_types", _typed_missing)
on_lines("pr3_missing_values", lambda df: profile.missing_values(df.select(*CLEAN_COLUMNS)))
on_lines(
    "pr4_duplicate_rows",
    lambda df: profile.duplicate_rows(df.select(*CLEAN_COLUMNS)),
)
on_lines("pr5_numeric_summary", lambda df: profile.numeric_summary(df.select(*RAW_NUMERIC)))
on_lines("cl1_clean_column_names", lambda df: clean.clean_column_names(_renamed(df)))
on_lines("cl2_parse_dates", _dates)
on_lines("cl3_rescale_discount", _rescaled)
on_lines("cl4_drop_duplicates", _deduped)
on_lines("cl4_removed_duplicates", _removed)
on_lines("cl5_quality_report", clean.quality_report)
_register(
    "cl6_validate_star", lambda s, d: star.validate_star(warehouse.lines(s, d), warehouse.star(s, d))
)
on_star("cl7_constraint_violations", star.constraint_violations)

# -- features -------------------------------------------------------------------


def _features(df: DataFrame) -> DataFrame:
    return engineer_features(df.select(*SOURCE_COLUMNS)).select(*CLEAN_COLUMNS)


def _recompute(*columns: str) -> Callable[[DataFrame], DataFrame]:
    """Distribution of freshly computed feature columns."""
    return lambda df: count_by(*columns)(_features(df))


def _per_line(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: _features(df).select("order_id", "product", "quantity", "sales", *columns)


on_lines("fe1_year", _recompute("year"))
on_lines("fe2_month", _recompute("month"))
on_lines("fe3_month_name", _recompute("month_name"))
on_lines("fe4_quarter", _recompute("quarter"))
on_lines("fe5_year_month", _recompute("year_month"))
on_lines("fe6_profit_margin", _per_line("profit_margin"))
on_lines("fe7_is_loss", _recompute("is_loss"))
on_lines("fe8_discount_pct", _recompute("discount_pct"))
on_lines("fe9_revenue_per_unit", _per_line("revenue_per_unit"))
on_lines("fe10_revenue_band", _recompute("revenue_band"))
on_lines(
    "fe11_discount_bucket",
    lambda df: count_by("discount_bucket", "bucket_order")(with_discount_bucket(df)),
)
on_lines("fe12_date_key", _recompute("date_key"))
on_lines(
    "fe13_profit_margin_pct",
    lambda df: df.select("order_id", "sales", "profit", C.row_margin_pct().alias("profit_margin_pct")),
)
on_lines(
    "fe14_status",
    lambda df: df.groupBy("customer", "product")
    .agg(F.sum("profit").alias("profit"), F.sum("sales").alias("sales"))
    .withColumn("status", C.health_status(F.col("profit"), F.col("sales"))),
)
on_lines("fe15_engineer_features", _features)

# -- star -----------------------------------------------------------------------


def _fact_natural(s: star.Star) -> DataFrame:
    return (
        s.fact_sales.join(s.dim_customer.select("customer_key", "customer_id"), "customer_key")
        .join(s.dim_product, "product_key")
        .join(s.dim_geography, "geography_key")
        .select(
            "order_id", "date_key", "customer_id", "product_name", *star.GEO, "sales", "quantity",
            "discount", "profit",
        )
    )


on_star("et1_dim_date", lambda s: s.dim_date)
on_star("et2_dim_customer", lambda s: s.dim_customer.drop("customer_key"))
on_star("et2_customer_keys", lambda s: s.dim_customer.select("customer_key"))
on_star("et3_dim_product", lambda s: s.dim_product.drop("product_key"))
on_star("et4_dim_geography", lambda s: s.dim_geography.drop("geography_key"))
on_star("et5_fact_sales", _fact_natural)
on_star(
    "et6_sale_ids",
    lambda s: s.fact_sales.agg(
        F.count("*").alias("n_rows"), F.count_distinct("sale_id").alias("n_sale_ids")
    ),
)
on_star(
    "et7_year_partitions",
    lambda s: s.fact_sales.groupBy(F.col("sale_year").alias("year")).agg(F.count("*").alias("n_lines")),
)

# -- rollups and breakdowns ------------------------------------------------------

on_lines("ag1_order_level", kpis.build_order_level)
on_lines("ag2_headline_kpis", kpis.headline_kpis)
for _dim in ("region", "segment", "industry", "product"):
    on_lines(f"ag3_breakdown_{_dim}", lambda df, dim=_dim: kpis.breakdown(df, dim))
on_lines("ag3_breakdowns_all", lambda df: kpis.breakdowns(df, report.DIMENSIONS))
on_lines("ag4_top_customers", kpis.top_customers)
on_lines("ag5_top_share", kpis.top_share)
on_lines("ag6_loss_lines", kpis.loss_lines)
on_lines("ag7_loss_by_product", kpis.loss_by_product)
on_lines("ag8_discount_margin_corr", kpis.discount_margin_corr)
on_lines("ag9_correlation_matrix", kpis.correlation_matrix)
on_lines("ag10_monthly_sales", kpis.monthly_sales)
on_lines("ag11_hierarchy", kpis.hierarchy)
on_lines("ag12_scatter_points", kpis.scatter_points)
on_lines("ag12_scatter_bins", kpis.scatter_bins)
on_lines("ag13_margin_by_bucket", kpis.margin_by_bucket)
on_lines("ag14_eda_report", report.run_eda)

# -- query library ----------------------------------------------------------------

on_star("a1_headline_kpis", library.a1_headline_kpis)
on_star("a2_region_sales", library.a2_region_sales)
on_star("a3_top_customers", library.a3_top_customers)
on_star("b1_product_health", library.b1_product_health)
on_star("b2_loss_products", library.b2_loss_products)
on_star("b3_segments_above_average_discount", library.b3_segments_above_average_discount)
on_star("b4_industry_segment", library.b4_industry_segment)
on_star("b5_monthly_trend", library.b5_monthly_trend)
on_star("c1_pareto", library.c1_pareto)
on_star("c1_pareto_in_buckets", lambda s: library.c1_pareto(s, buckets=50))
on_star("c2_best_product_by_region", library.c2_best_product_by_region)
on_star("c3_month_over_month", library.c3_month_over_month)
on_star("c4_share_of_industry", library.c4_share_of_industry)
on_star("c5_year_to_date", library.c5_year_to_date)
on_star("c6_discount_bucket_margin", lambda s: library.c6_discount_margin(s.fact_sales))
on_star("d1_sales_enriched", lambda s: library.d1_sales_enriched(s).drop("sale_id"))
on_star("d2_monthly_kpis", library.d2_monthly_kpis)
on_star("e1_region_kpis", lambda s: library.e1_region_kpis(s, "ASIA"))
on_star("e1_region_kpis_unknown", lambda s: library.e1_region_kpis(s, "nowhere"))
on_star("e1_region_kpis_all", library.region_kpis_all)


def _region_function(spark: SparkSession, d: str) -> DataFrame:
    library.register_views(spark, warehouse.star(spark, d))
    return spark.sql("SELECT metric, value FROM get_region_kpis('EUROPE')")


_register("e1_region_kpis_sql_function", _region_function)

# -- calendar and measures ---------------------------------------------------------

ASIA_EUROPE = Slicers({"region": ["ASIA", "EUROPE"]})
SMB = Slicers({"segment": ["SMB"]})
YEARS = Slicers({"segment": ["SMB", "Enterprise"]}, years=[1997, 1998])


def ratio_pct(num: str, den: str, name: str):
    return A.ratio(F.col(num), F.col(den)).alias(name)


_register("ca1_date_table", lambda s, d: warehouse.calendar(s, d))
_register("ca2_month_labels", lambda s, d: cal.month_labels(warehouse.calendar(s, d)))
on_calendar("ca3_daily_sales", cal.daily_sales)

for _id, _measure, _by in (
    ("me1", "total_sales", ["region"]),
    ("me2", "total_profit", ["segment"]),
    ("me3", "total_orders", ["industry"]),
    ("me4", "total_quantity", ["product"]),
    ("me5", "total_customers", ["country"]),
    ("me6", "profit_margin", ["city"]),
    ("me7", "avg_order_value", ["year", "quarter"]),
    ("me8", "avg_discount", ["subregion"]),
    ("me13", "loss_making_sales", ["product"]),
):
    on_lines(f"{_id}_{_measure}", lambda df, m=_measure, by=_by: measures.evaluate(df, [m], by))


def _time(*columns: str, by: tuple[str, ...] = (), slicers: Slicers = measures.NONE):
    def make(lines: DataFrame, calendar: DataFrame) -> DataFrame:
        return measures.time_measures(lines, calendar, by, slicers).select(*by, "year", "month", *columns)

    return make


on_calendar("me9_sales_ly", _time("total_sales", "sales_ly", by=("region",)))
on_calendar("me9_sales_ly_daily", lambda ln, c: measures.daily_time_measures(ln, c))
on_calendar("me10_sales_yoy", _time("total_sales", "sales_ly", "sales_yoy"))
on_calendar("me11_sales_ytd", _time("total_sales", "sales_ytd", by=("segment",)))
on_calendar("me12_sales_mom", _time("total_sales", "sales_mom"))
on_calendar("me12_sales_mom_sliced", _time("total_sales", "sales_mom", slicers=ASIA_EUROPE))
on_lines(
    "me14_pct_of_total_sales",
    lambda df: measures.evaluate(df, ["total_sales"], ["industry"], ASIA_EUROPE, share_of_total=True),
)
on_calendar("me15_running_total", _time("total_sales", "running_total"))
on_calendar(
    "me15_running_total_by_day",
    lambda ln, c: measures.daily_time_measures(ln, c, ["region"]).select("region", "date", "running_total"),
)


def _intervals(*wanted: str, grain: timelines.Grain = timelines.MONTH):
    """By customer: rows follow the sales, so the twin holds intervals as well."""
    return lambda lines, calendar: timelines.intervals(lines, calendar, ["customer"], measures=wanted, grain=grain)


on_calendar("me9_sales_ly_by_customer", _intervals("total_sales", "sales_ly", "sales_yoy"))
on_calendar("me11_sales_ytd_by_customer", _intervals("sales_ytd"))
on_calendar("me12_sales_mom_by_customer", _intervals("sales_mom"))
on_calendar("me15_running_total_by_customer", _intervals("running_total"))
on_calendar("me15_running_total_by_customer_day", _intervals("running_total", grain=timelines.DAY))
_register(
    "me16_product_rank",
    lambda s, d: measures.product_rank(
        warehouse.lines(s, d),
        warehouse.star(s, d).dim_product.select(F.col("product_name").alias("product")),
        slicers=SMB,
    ),
)
_register(
    "me16_product_rank_by_region",
    lambda s, d: measures.product_rank(
        warehouse.lines(s, d),
        warehouse.star(s, d).dim_product.select(F.col("product_name").alias("product")),
        ["region"],
    ),
)


def _cumulative(df: DataFrame, within: tuple[str, ...] = (), slicers: Slicers = measures.NONE) -> DataFrame:
    return measures.cumulative_share(df, "customer", within, slicers).select(
        *within,
        "customer",
        F.col("revenue").cast("double").alias("total_sales"),
        ratio_pct("cumulative", "whole", "cumulative_share"),
    )


on_lines("me17_cumulative_share", lambda df: _cumulative(df, slicers=SMB))
on_lines("me17_cumulative_share_by_region", lambda df: _cumulative(df, ("region",)))
on_lines(
    "me18_filter_context",
    lambda df: measures.evaluate(df, ["total_sales", "total_orders", "profit_margin"], ["region"], YEARS),
)
on_calendar(
    "me18_time_in_context",
    _time("total_sales", "sales_ly", "sales_yoy", "sales_ytd", "sales_mom", "running_total", slicers=YEARS),
)
MID_MONTHS = Slicers(date_range=(date(1996, 2, 29), date(1998, 2, 10)))
IN_A_MONTH = Slicers({"segment": ["SMB"]}, date_range=(date(1997, 2, 5), date(1997, 2, 20)))
on_calendar("me18_mid_month_range", _time(*timelines.MEASURES, by=("region",), slicers=MID_MONTHS))
on_calendar("me18_part_of_a_month", _time(*timelines.MEASURES, slicers=IN_A_MONTH))
on_calendar("me18_days_in_range", lambda ln, c: measures.daily_time_measures(ln, c, ["region"], MID_MONTHS))
on_calendar(
    "me18_days_of_years", lambda ln, c: measures.daily_time_measures(ln, c, slicers=Slicers(years=[1996, 1998]))
)
on_lines(
    "me19_measure_layer",
    lambda df: measures.evaluate(df, list(measures.MEASURES), ["region", "segment"], ASIA_EUROPE, True),
)

# -- stored aggregates -----------------------------------------------------------


def on_store(name: str, measure_names: list[str], by: list[str], slicers: Slicers = measures.NONE, share: bool = False) -> None:
    """A request that the smallest fitting stored aggregate answers, else the lines."""
    _register(name, lambda s, d: warehouse.aggregates(s, d).evaluate(measure_names, by, slicers, share))


ASIA_YEARS = Slicers({"region": ["ASIA", "EUROPE"]}, years=[1996, 1997])
on_store("me3_total_orders_stored", ["total_orders", "total_customers"], ["region"], ASIA_YEARS)
on_store("me5_total_customers_stored", ["total_customers"], ["year", "month"], SMB)
on_store("me19_measure_layer_stored", list(measures.MEASURES), ["region", "segment"], ASIA_EUROPE, True)
on_store("vi1_kpi_cards_synced", visuals.CARDS, [], ASIA_YEARS)
on_store("vi2_monthly_trend_synced", ["total_sales", "total_profit"], ["year", "month"], ASIA_YEARS)
on_store("vi4_product_profit_synced", ["total_profit", "total_orders"], ["product"], YEARS)
on_store("vi11_industry_segment_synced", ["total_sales", "profit_margin", "total_customers"], ["industry", "segment"], YEARS)
on_store("vi12_customer_table_synced", visuals.CARDS, ["customer"], ASIA_YEARS)
on_store("vi1_kpi_cards_mid_months", visuals.CARDS, ["region"], MID_MONTHS)

# -- visuals -----------------------------------------------------------------------

on_lines("vi1_kpi_cards", visuals.kpi_cards)
on_lines("vi2_monthly_trend", visuals.monthly_trend)
on_lines("vi3_region_bars", visuals.region_bars)
on_lines("vi4_product_profit", visuals.product_profit)
on_lines("vi5_top_customers", visuals.top_customers)
on_lines("vi5_top_customers_sliced", lambda df: visuals.top_customers(df, slicers=ASIA_EUROPE))
on_lines("vi6_discount_columns", visuals.discount_columns)
on_lines("vi7_discount_profit_scatter", visuals.discount_profit_scatter)
on_lines("vi8_product_table", visuals.product_table)
on_lines("vi9_product_region_matrix", visuals.product_region_matrix)
on_lines("vi10_pareto_chart", visuals.pareto_chart)
on_lines("vi11_industry_segment_matrix", visuals.industry_segment_matrix)
on_lines("vi12_customer_table", visuals.customer_table)
ONE_CUSTOMER, ONE_PRODUCT = "Customer#000000001", "Brand#1"
for _part in ("kpis", "monthly", "orders"):
    on_lines(f"vi13_customer_{_part}", lambda df, p=_part: visuals.customer_detail(df)[p])
    on_lines(f"vi14_product_{_part}", lambda df, p=_part: visuals.product_detail(df)[p])
    on_lines(f"vi13_one_customer_{_part}", lambda df, p=_part: visuals.customer_detail(df, ONE_CUSTOMER)[p])
    on_lines(f"vi14_one_product_{_part}", lambda df, p=_part: visuals.product_detail(df, ONE_PRODUCT)[p])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount bucket against margin, straight from the given tables."""
    return plain(library.c6_discount_margin(tpch.order_lines(spark, sf_dir)))


_register("c6_from_given_tables", flagship)
