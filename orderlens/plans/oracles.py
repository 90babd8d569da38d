"""SQL twins of the registered queries, over the given tables only.

They start from the raw tables and know nothing of the star schema or of any
stored table, so they check the loading steps as well.
"""

from __future__ import annotations

from orderlens.operators.measures import MEASURES
from orderlens.schema import CLEAN_COLUMNS

ORACLES: dict[str, str] = {}

# The mapping of the given tables to order lines, and the derived columns.
LINES = """
WITH ol0 AS (
  SELECT CAST(l.l_orderkey AS BIGINT) AS order_id, CAST(o.o_orderdate AS DATE) AS order_date,
         concat('Contact of ', c.c_name) AS contact_name, n.n_name AS country,
         concat(n.n_name, '#', CAST(c.c_custkey % 4 AS VARCHAR)) AS city, r.r_name AS region,
         concat(r.r_name, '-', CAST(n.n_nationkey % 2 AS VARCHAR)) AS subregion,
         c.c_name AS customer, c.c_custkey AS customer_id, c.c_mktsegment AS industry,
         CASE WHEN c.c_acctbal < 4500 THEN 'SMB'
              WHEN c.c_acctbal < 6500 THEN 'Strategic' ELSE 'Enterprise' END AS segment,
         p.p_brand AS product, CAST(l.l_quantity AS INT) AS quantity,
         CAST(l.l_linenumber AS BIGINT) AS line_seq,
         CAST(CAST(l.l_discount AS DECIMAL(4,2)) * 5 AS DECIMAL(5,4)) AS discount,
         CAST(CAST(l.l_extendedprice AS DECIMAL(12,2))
              * (1 - CAST(l.l_discount AS DECIMAL(4,2)) * 5) AS DECIMAL(12,2)) AS sales,
         CAST((CAST(substr(p.p_brand, 7) AS INT) * 7) % 40 - 2 AS DECIMAL(6,2)) / 100 AS base
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey),
ol AS (
  SELECT *, CAST(sales * (CAST(base AS DECIMAL(6,4))
                          - CAST(discount * 0.6 AS DECIMAL(6,4))) AS DECIMAL(12,2)) AS profit
  FROM ol0),
feat AS (
  SELECT order_id, order_date, CAST(strftime(order_date, '%Y%m%d') AS INT) AS date_key,
         contact_name, country, city, region, subregion, customer, customer_id, industry, segment,
         product, sales, quantity, discount, profit,
         CAST(year(order_date) AS INT) AS year, CAST(month(order_date) AS INT) AS month,
         strftime(order_date, '%b') AS month_name, CAST(quarter(order_date) AS INT) AS quarter,
         strftime(order_date, '%Y-%m') AS year_month,
         CASE WHEN sales <> 0 THEN CAST(profit AS DOUBLE) / CAST(sales AS DOUBLE) END AS profit_margin,
         coalesce(profit < 0, FALSE) AS is_loss,
         round(CAST(discount AS DOUBLE) * 100, 1) AS discount_pct,
         CASE WHEN quantity > 0 THEN CAST(sales AS DOUBLE) / quantity END AS revenue_per_unit,
         CASE WHEN sales <= 250 THEN '<250' WHEN sales <= 1000 THEN '250-1K'
              WHEN sales <= 5000 THEN '1K-5K' WHEN sales > 5000 THEN '5K+' END AS revenue_band,
         CASE WHEN discount = 0 THEN '0%' WHEN discount <= 0.10 THEN '1-10%'
              WHEN discount <= 0.20 THEN '11-20%' WHEN discount <= 0.30 THEN '21-30%'
              ELSE '30%+' END AS discount_bucket,
         line_seq
  FROM ol)"""

CALENDAR = """,
span AS (SELECT make_date(CAST(year(min(order_date)) AS INT), 1, 1) AS lo,
                make_date(CAST(year(max(order_date)) AS INT), 12, 31) AS hi FROM feat),
cal AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                                           INTERVAL 1 DAY)) AS DATE) AS date FROM span),
months AS (SELECT DISTINCT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month FROM cal)"""

ASIA_EUROPE = "region IN ('ASIA', 'EUROPE')"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def total(col: str) -> str:
    return dbl(f"sum({col})")


def pct(num: str, den: str, digits: int = 1) -> str:
    return f"round({num} * 100 / nullif({den}, 0), {digits})"


def add(name: str, body: str, ctes: str = "") -> None:
    ORACLES[name] = f"{LINES}{ctes}\n{body.strip()}"


def counted(name: str, *columns: str, source: str = "feat") -> None:
    keys = ", ".join(columns)
    add(name, f"SELECT {keys}, count(*) AS n_lines FROM {source} GROUP BY {keys}")


S, P, D = total("sales"), total("profit"), total("discount")
MARGIN = pct(P, S)

SOURCE = [c for c in CLEAN_COLUMNS[:17] if c != "date_key"]
MONEY = ("sales", "discount", "profit")


def listing(columns: list[str]) -> str:
    return ", ".join(f"{dbl(c)} AS {c}" if c in MONEY else c for c in columns)


CLEAN = listing(CLEAN_COLUMNS)

# -- sources and sinks ---------------------------------------------------------

add("io1_load_with_fallback", "SELECT 'sample' AS source_kind, count(*) AS n_lines FROM feat")
add(
    "io2_read_csv",
    """SELECT TRUE AS row_id, CAST(order_id AS VARCHAR) AS order_id, strftime(order_date, '%Y-%m-%d') AS order_date,
       date_key, contact_name, country, city, region, subregion, customer, CAST(customer_id AS VARCHAR) AS customer_id,
       industry, segment, product, sha256(customer) AS license, CAST(sales AS DOUBLE) AS sales, quantity,
       CAST(discount AS DOUBLE) AS discount, CAST(profit AS DOUBLE) AS profit FROM feat""",
)


add(
    "io2_reject_counts",
    """SELECT CASE quantity WHEN 1 THEN 'short line' WHEN 2 THEN 'long line' WHEN 3 THEN 'bad value: quantity'
                     WHEN 4 THEN 'open quote' WHEN 5 THEN 'blank line' END AS reason,
       count(*) AS n_lines FROM feat GROUP BY 1""",
)
add(
    "io2_accepted_lines",
    f"SELECT {listing([c for c in SOURCE if c not in ('order_date', 'customer_id', 'order_id')])}, "
    "CAST(order_id AS VARCHAR) AS order_id FROM feat WHERE quantity > 5",
)


def printed(col: str, kind: str) -> str:
    """A double as its CSV text reads under a decimal type."""
    return dbl(f"CAST(CAST({col} AS VARCHAR) AS {kind})")


def csv_listing(decimals: bool, whole: str, dates: bool = True) -> str:
    out = []
    for c in CLEAN_COLUMNS:
        if c in ("order_id", "customer_id"):
            out.append(f"CAST({c} AS VARCHAR) AS {c}")
        elif c in MONEY:
            out.append(f"{dbl(c)} AS {c}")
        elif c in ("date_key", "quantity", "year", "month", "quarter"):
            out.append(f"CAST({c} AS {whole}) AS {c}")
        elif decimals and c == "profit_margin":
            out.append(f"{printed('profit_margin', 'DECIMAL(10,6)')} AS profit_margin")
        elif decimals and c == "revenue_per_unit":
            out.append(f"{printed('revenue_per_unit', 'DECIMAL(12,4)')} AS revenue_per_unit")
        else:
            out.append(c)
    return ", ".join(out)


add("io3_staging_load", f"SELECT {csv_listing(True, 'INT')} FROM feat")
add("io4_bi_load", f"SELECT {csv_listing(False, 'BIGINT')} FROM feat")
add(
    "io5_write_partitioned",
    f"SELECT year, count(*) AS n_lines, {S} AS sales, {P} AS profit FROM feat GROUP BY year",
)
DIMS = {
    "dim_date": "date_key, order_date AS full_date, year, quarter, month, month_name",
    "dim_customer": "customer_id, customer AS customer_name, industry, segment",
    "dim_product": "product AS product_name",
    "dim_geography": "country, city, region, subregion",
}
add(
    "io6_star_tables",
    "SELECT 'fact_sales' AS table_name, count(*) AS n_rows FROM feat"
    + "".join(
        f"\nUNION ALL SELECT '{t}', count(*) FROM (SELECT DISTINCT {cols} FROM feat)"
        for t, cols in DIMS.items()
    ),
)
add("io7_drop_columns", f"SELECT {listing([c for c in SOURCE if c != 'contact_name'])} FROM feat")
add("pipeline_clean_lines", f"SELECT {csv_listing(False, 'INT')} FROM feat")

# -- profile and cleaning ------------------------------------------------------

add("pr1_shape", f"SELECT count(*) AS n_rows, CAST({len(CLEAN_COLUMNS)} AS INT) AS n_columns FROM feat")
add(
    "pr2_column_types",
    "\nUNION ALL ".join(
        f"""SELECT CAST({i} AS INT) AS position, '{c}' AS "column",
        replace(replace(lower(min(typeof({c}))), 'varchar', 'string'), 'integer', 'int') AS type,
        count(*) - count({c}) AS n_missing FROM feat"""
        for i, c in enumerate(CLEAN_COLUMNS)
    ),
)
add(
    "pr3_missing_values",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM feat" for c in CLEAN_COLUMNS
    ),
)
add(
    "pr4_duplicate_rows",
    f"""SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(CLEAN_COLUMNS)}
       FROM feat)) AS n_duplicates FROM feat""",
)
add(
    "pr5_numeric_summary",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", round({dbl(f'count({c})')}, 2) AS count, round(avg({dbl(c)}), 2) AS mean,
        round(stddev_samp({dbl(c)}), 2) AS std, round(min({dbl(c)}), 2) AS min,
        round(quantile_cont({dbl(c)}, 0.25), 2) AS p25, round(quantile_cont({dbl(c)}, 0.5), 2) AS p50,
        round(quantile_cont({dbl(c)}, 0.75), 2) AS p75, round(max({dbl(c)}), 2) AS max FROM feat"""
        for c in ("date_key", "sales", "quantity", "discount", "profit")
    ),
)
add("cl1_clean_column_names", f"SELECT {listing(SOURCE)} FROM feat")
add(
    "cl2_parse_dates",
    """SELECT CASE WHEN quantity <> 1 THEN year END AS year, count(*) AS n_lines,
       count(*) FILTER (WHERE quantity = 1) AS n_bad FROM feat GROUP BY 1""",
)
add(
    "cl3_rescale_discount",
    """SELECT discount * 100 / 100 AS discount, count(*) AS n_lines
       FROM (SELECT CAST(discount AS DOUBLE) AS discount FROM feat) GROUP BY 1""",
)
add("cl4_drop_duplicates", f"SELECT DISTINCT {listing(SOURCE)}, line_seq FROM feat")
add(
    "cl4_removed_duplicates",
    f"""SELECT 2 * a AS rows_before, b AS rows_after, 2 * a - b AS rows_removed
       FROM (SELECT count(*) AS a FROM feat),
            (SELECT count(*) AS b FROM (SELECT DISTINCT {listing(SOURCE)}, line_seq FROM feat))""",
)
RULES = {
    "unparseable_order_date": "order_date IS NULL",
    "negative_sales": "sales < 0",
    "non_positive_quantity": "quantity <= 0",
    "null_discount": "discount IS NULL",
    "negative_discount": "discount < 0",
    "discount_above_one": "discount > 1",
    "null_profit": "profit IS NULL",
}
add(
    "cl5_quality_report",
    "\nUNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE {test}) AS n_rows FROM feat"
        for rule, test in RULES.items()
    ),
)
add(
    "cl6_validate_star",
    f"""SELECT count(*) AS staging_rows, count(*) AS fact_rows,
       (SELECT count(*) FROM (SELECT DISTINCT {DIMS['dim_customer']} FROM feat)) AS customers,
       (SELECT count(*) FROM (SELECT DISTINCT {DIMS['dim_product']} FROM feat)) AS products,
       (SELECT count(*) FROM (SELECT DISTINCT {DIMS['dim_geography']} FROM feat)) AS geographies FROM feat""",
)


def _constraints() -> str:
    parts = []

    def rule(table: str, name: str, count: str) -> None:
        parts.append(
            f"SELECT '{table}' AS table_name, '{name}' AS rule, CAST(({count}) AS BIGINT) AS n_violations"
        )

    def repeats(table: str, key: str) -> str:
        return (
            f"SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c "
            f"FROM (SELECT DISTINCT {DIMS[table]} FROM feat) GROUP BY {key})"
        )

    rule("dim_date", "unique(date_key)", repeats("dim_date", "date_key"))
    rule("dim_customer", "unique(customer_id)", repeats("dim_customer", "customer_id"))
    rule("dim_product", "unique(product_name)", repeats("dim_product", "product_name"))
    geo = "country, city, region, subregion"
    rule("dim_geography", f"unique({geo})", repeats("dim_geography", geo))
    for table in ("customer", "product", "geography"):
        rule(f"dim_{table}", f"unique({table}_key)", "SELECT 0")
    rule("fact_sales", "unique(sale_id)", "SELECT 0")
    for table, key, col in (
        ("dim_date", "date_key", "date_key"),
        ("dim_date", "full_date", "order_date"),
        ("dim_customer", "customer_id", "customer_id"),
        ("dim_product", "product_name", "product"),
        ("fact_sales", "order_id", "order_id"),
    ):
        rule(table, f"not_null({key})", f"SELECT count(*) - count({col}) FROM feat")
    rule("fact_sales", "not_null(sale_id)", "SELECT 0")
    for table in DIMS:
        rule("fact_sales", f"references({table})", "SELECT 0")
    return "\nUNION ALL ".join(parts)


add("cl7_constraint_violations", _constraints())

# -- features -------------------------------------------------------------------

for _name, _col in (
    ("fe1_year", "year"),
    ("fe2_month", "month"),
    ("fe3_month_name", "month_name"),
    ("fe4_quarter", "quarter"),
    ("fe5_year_month", "year_month"),
    ("fe7_is_loss", "is_loss"),
    ("fe8_discount_pct", "discount_pct"),
    ("fe10_revenue_band", "revenue_band"),
    ("fe12_date_key", "date_key"),
):
    counted(_name, _col)
for _name, _col in (("fe6_profit_margin", "profit_margin"), ("fe9_revenue_per_unit", "revenue_per_unit")):
    add(_name, f"SELECT {listing(['order_id', 'product', 'quantity', 'sales', _col])} FROM feat")
ORDER_OF_BUCKET = (
    "CASE discount_bucket WHEN '0%' THEN 0 WHEN '1-10%' THEN 1 WHEN '11-20%' THEN 2 "
    "WHEN '21-30%' THEN 3 ELSE 4 END"
)
add(
    "fe11_discount_bucket",
    f"SELECT discount_bucket, {ORDER_OF_BUCKET} AS bucket_order, count(*) AS n_lines FROM feat GROUP BY 1, 2",
)
ROW_MARGIN = "round(CAST(profit AS DOUBLE) * 100 / nullif(CAST(sales AS DOUBLE), 0), 2) AS profit_margin_pct"
add("fe13_profit_margin_pct", f"SELECT {listing(['order_id', 'sales', 'profit'])}, {ROW_MARGIN} FROM feat")
STATUS = f"""CASE WHEN sum(profit) < 0 THEN 'LOSS-MAKING' WHEN {P} / nullif({S}, 0) < 0.10 THEN 'THIN MARGIN'
             ELSE 'HEALTHY' END AS status"""
add(
    "fe14_status",
    f"SELECT customer, product, {P} AS profit, {S} AS sales, {STATUS} FROM feat GROUP BY customer, product",
)
add("fe15_engineer_features", f"SELECT {CLEAN} FROM feat")

# -- star -----------------------------------------------------------------------

for _name, _table in (
    ("et1_dim_date", "dim_date"),
    ("et2_dim_customer", "dim_customer"),
    ("et3_dim_product", "dim_product"),
    ("et4_dim_geography", "dim_geography"),
):
    add(_name, f"SELECT DISTINCT {DIMS[_table]} FROM feat")
add(
    "et2_customer_keys",
    """SELECT row_number() OVER () AS customer_key
       FROM (SELECT DISTINCT customer_id, customer, industry, segment FROM feat)""",
)
add(
    "et5_fact_sales",
    f"""SELECT order_id, date_key, customer_id, product AS product_name, country, city, region, subregion,
       {listing(['sales', 'quantity', 'discount', 'profit'])} FROM feat""",
)
add("et6_sale_ids", "SELECT count(*) AS n_rows, count(*) AS n_sale_ids FROM feat")
counted("et7_year_partitions", "year")

# -- rollups and breakdowns ------------------------------------------------------

add(
    "ag1_order_level",
    f"""SELECT order_id, min(order_date) AS order_date, min_by(customer, line_seq) AS customer,
       min_by(region, line_seq) AS region, min_by(segment, line_seq) AS segment, {S} AS order_sales,
       {P} AS order_profit, CAST(count(product) AS BIGINT) AS n_lines FROM feat GROUP BY order_id""",
)
add(
    "ag2_headline_kpis",
    f"""SELECT {S} AS total_sales, {P} AS total_profit, {P} / {S} * 100 AS profit_margin_pct,
       count(DISTINCT order_id) AS n_orders, count(DISTINCT customer_id) AS n_customers,
       {D} / count(discount) * 100 AS avg_discount_pct, {S} / count(DISTINCT order_id) AS avg_order_value
       FROM feat""",
)
BREAKDOWN = f"""round({S}, 2) AS sales, round({P}, 2) AS profit,
    round({dbl('sum(CAST(discount_pct AS DECIMAL(12,1)))')} / count(discount_pct), 2) AS avg_discount_pct,
    count(DISTINCT order_id) AS orders, {MARGIN} AS margin_pct"""
DIMENSIONS = ("region", "segment", "industry", "product")
for _dim in DIMENSIONS:
    add(f"ag3_breakdown_{_dim}", f"SELECT {_dim}, {BREAKDOWN} FROM feat GROUP BY {_dim}")
add(
    "ag3_breakdowns_all",
    "\nUNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS key, {BREAKDOWN} FROM feat GROUP BY {d}" for d in DIMENSIONS
    ),
)


def top(n: int, where: str = "TRUE") -> str:
    return f"""(SELECT customer, {S} AS sales,
        {pct(S, f'(SELECT {S} FROM feat WHERE {where})')} AS pct_of_total
        FROM feat WHERE {where} GROUP BY customer ORDER BY sum(sales) DESC, customer LIMIT {n})"""


add("ag4_top_customers", f"SELECT * FROM {top(10)}")
add(
    "ag5_top_share",
    f"""SELECT round(sum(pct_of_total), 1) AS sum_of_rounded_pct,
       {pct('sum(sales)', f'(SELECT {S} FROM feat)', 4)} AS exact_pct FROM {top(10)}""",
)
LOSS = f"""count(*) FILTER (WHERE is_loss) AS loss_lines, count(*) AS total_lines,
    {pct(dbl('count(*) FILTER (WHERE is_loss)'), dbl('count(*)'))} AS loss_pct"""
add("ag6_loss_lines", f"SELECT {LOSS} FROM feat")
LOSS_BY_PRODUCT = f"SELECT product, round({P}, 0) AS loss FROM feat WHERE is_loss GROUP BY product"
add("ag7_loss_by_product", LOSS_BY_PRODUCT)


def corr(x: str, y: str, digits: int = 6) -> str:
    return f"round(corr({dbl(x)}, {dbl(y)}), {digits})"


add("ag8_discount_margin_corr", f"SELECT {corr('discount', 'profit_margin')} AS corr FROM feat")
_FIVE = ("sales", "quantity", "discount", "profit", "profit_margin")
add(
    "ag9_correlation_matrix",
    "\nUNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, {corr(x, y)} AS r FROM feat" for x in _FIVE for y in _FIVE
    ),
)
add("ag10_monthly_sales", f"SELECT year_month, {S} AS sales FROM feat GROUP BY year_month")
add(
    "ag11_hierarchy",
    f"""SELECT concat(region, '/', industry) AS id, industry AS label, region AS parent, {S} AS value
       FROM feat GROUP BY region, industry
       UNION ALL SELECT region, region, '', {S} FROM feat GROUP BY region""",
)
add(
    "ag12_scatter_points",
    """SELECT discount_pct, profit_margin * 100 AS margin_pct, CAST(profit AS DOUBLE) AS profit, segment,
       product, customer FROM feat""",
)
add(
    "ag12_scatter_bins",
    f"""SELECT discount_pct, floor(profit_margin * 100 / 5.0) * 5.0 AS margin_bin, segment,
       count(*) AS n_lines, {P} AS profit FROM feat GROUP BY 1, 2, 3""",
)
add(
    "ag13_margin_by_bucket",
    f"""SELECT discount_bucket, {ORDER_OF_BUCKET} AS bucket_order, {P} / {S} * 100 AS margin_pct
       FROM feat WHERE discount > -0.01 AND discount <= 1 GROUP BY 1, 2""",
)


def long(section: str, key: str, columns: list[str], source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{section}' AS section, {key} AS key, '{c}' AS metric, {dbl(c)} AS value FROM {source}"
        for c in columns
    )


add(
    "ag14_eda_report",
    "\nUNION ALL ".join(
        [
            long(
                "headline",
                "'all'",
                [
                    "total_sales", "total_profit", "profit_margin_pct", "n_orders", "n_customers",
                    "avg_discount_pct", "avg_order_value",
                ],
                "headline",
            ),
            long("lines", "'all'", ["loss_lines", "total_lines", "loss_pct", "corr_discount_margin"], "overall"),
            *[
                long(f"by_{d}", d, ["sales", "profit", "avg_discount_pct", "orders", "margin_pct"], f"by_{d}")
                for d in DIMENSIONS
            ],
            long("top_customers", "customer", ["sales", "pct_of_total"], "top10"),
            "SELECT 'top_customers', 'all', 'top_share_pct', round(sum(pct_of_total), 1) FROM top10",
            long("loss_by_product", "product", ["loss"], "losses"),
        ]
    ),
    f""",
headline AS (SELECT {S} AS total_sales, {P} AS total_profit, {P} / {S} * 100 AS profit_margin_pct,
  count(DISTINCT order_id) AS n_orders, count(DISTINCT customer_id) AS n_customers,
  {D} / count(discount) * 100 AS avg_discount_pct, {S} / count(DISTINCT order_id) AS avg_order_value FROM feat),
overall AS (SELECT {LOSS}, {corr('discount', 'profit_margin', 3)} AS corr_discount_margin FROM feat),
"""
    + ",\n".join(f"by_{d} AS (SELECT {d}, {BREAKDOWN} FROM feat GROUP BY {d})" for d in DIMENSIONS)
    + f",\ntop10 AS (SELECT * FROM {top(10)}),\nlosses AS ({LOSS_BY_PRODUCT})",
)

# -- query library ----------------------------------------------------------------

RS, RP = f"round({S}, 2)", f"round({P}, 2)"
add(
    "a1_headline_kpis",
    f"""SELECT {RS} AS total_sales, {RP} AS total_profit, {MARGIN} AS profit_margin_pct,
       count(DISTINCT order_id) AS total_orders, round({S} / count(DISTINCT order_id), 2) AS avg_order_value,
       round({D} / count(discount) * 100, 1) AS avg_discount_pct FROM feat""",
)
add(
    "a2_region_sales",
    f"SELECT region, {RS} AS sales, {RP} AS profit, {MARGIN} AS margin_pct FROM feat GROUP BY region",
)
add(
    "a3_top_customers",
    f"""SELECT customer AS customer_name, {RS} AS revenue, count(DISTINCT order_id) AS orders FROM feat
       GROUP BY customer ORDER BY sum(sales) DESC, customer LIMIT 10""",
)
add(
    "b1_product_health",
    f"""SELECT product AS product_name, {RS} AS sales, {RP} AS profit, {MARGIN} AS margin_pct, {STATUS}
       FROM feat GROUP BY product""",
)
add(
    "b2_loss_products",
    f"""SELECT product AS product_name, {RP} AS total_profit FROM feat GROUP BY product
       HAVING sum(profit) < 0""",
)
add(
    "b3_segments_above_average_discount",
    f"""SELECT segment, round({D} / count(discount) * 100, 1) AS avg_discount_pct FROM feat GROUP BY segment
       HAVING {D} / count(discount) > (SELECT {D} / count(discount) FROM feat)""",
)
add(
    "b4_industry_segment",
    f"SELECT industry, segment, {RS} AS sales, {MARGIN} AS margin_pct FROM feat GROUP BY industry, segment",
)
add(
    "b5_monthly_trend",
    f"SELECT year, month, month_name, {RS} AS sales FROM feat GROUP BY year, month, month_name",
)
PARETO = f"""round({dbl('revenue')}, 2) AS revenue,
    {pct(dbl('revenue'), dbl('sum(revenue) OVER ()'))} AS pct_of_total,
    {pct(dbl('sum(revenue) OVER (ORDER BY revenue DESC)'), dbl('sum(revenue) OVER ()'))} AS cumulative_pct"""
REVENUE = ",\nrev AS (SELECT {keys}, sum(sales) AS revenue FROM feat GROUP BY {keys})"
for _name in ("c1_pareto", "c1_pareto_in_buckets"):
    add(_name, f"SELECT customer AS customer_name, {PARETO} FROM rev", REVENUE.format(keys="customer"))
add(
    "c2_best_product_by_region",
    f"""SELECT region, product AS product_name, round({dbl('revenue')}, 2) AS sales FROM rev
       QUALIFY rank() OVER (PARTITION BY region ORDER BY revenue DESC) = 1""",
    REVENUE.format(keys="region, product"),
)
add(
    "c3_month_over_month",
    f"""SELECT year, month, round({dbl('revenue')}, 2) AS sales, round({dbl('revenue - prev')}, 2) AS mom_change,
       {pct(dbl('revenue - prev'), dbl('prev'))} AS mom_pct
       FROM (SELECT *, lag(revenue) OVER (ORDER BY year, month) AS prev FROM rev)""",
    REVENUE.format(keys="year, month"),
)
add(
    "c4_share_of_industry",
    f"""SELECT industry, customer AS customer_name, round({dbl('revenue')}, 2) AS revenue,
       {pct(dbl('revenue'), dbl('sum(revenue) OVER (PARTITION BY industry)'))} AS pct_of_industry FROM rev""",
    REVENUE.format(keys="industry, customer"),
)
add(
    "c5_year_to_date",
    f"""SELECT year, month, round({dbl('revenue')}, 2) AS monthly_sales,
       round({dbl('sum(revenue) OVER (PARTITION BY year ORDER BY month)')}, 2) AS running_total_ytd FROM rev""",
    REVENUE.format(keys="year, month"),
)
BUCKETS = f"""SELECT discount_bucket, count(*) AS line_count, {RS} AS sales, {RP} AS profit,
    {MARGIN} AS margin_pct FROM feat GROUP BY discount_bucket"""
for _name in ("c6_discount_bucket_margin", "c6_from_given_tables", "vi6_discount_columns"):
    add(_name, BUCKETS)
add(
    "d1_sales_enriched",
    f"""SELECT order_id, order_date AS full_date, year, quarter, month_name, customer AS customer_name,
       industry, segment, product AS product_name, region, subregion, country,
       {listing(['sales', 'quantity', 'discount', 'profit'])}, {ROW_MARGIN}, is_loss FROM feat""",
)
MONTHLY = f"""SELECT year, month, {RS} AS sales, {RP} AS profit, {MARGIN} AS margin_pct,
    count(DISTINCT order_id) AS orders FROM feat GROUP BY year, month"""
for _name in ("d2_monthly_kpis", "io9_refresh_monthly_kpis", "io9_incremental_refresh"):
    add(_name, MONTHLY)


def region_kpis(where: str, key: str = "", group: str = "") -> str:
    rows = {
        "total_sales": RS,
        "total_profit": RP,
        "margin_pct": MARGIN,
        "orders": dbl("count(DISTINCT order_id)"),
    }
    return "\nUNION ALL ".join(
        f"SELECT {key}'{m}' AS metric, {v} AS value FROM feat {where} {group}" for m, v in rows.items()
    )


add("e1_region_kpis", region_kpis("WHERE region = 'ASIA'"))
add("e1_region_kpis_unknown", region_kpis("WHERE region = 'nowhere'"))
add("e1_region_kpis_sql_function", region_kpis("WHERE region = 'EUROPE'"))
add("e1_region_kpis_all", region_kpis("", "region, ", "GROUP BY region"))

# -- calendar and measures ---------------------------------------------------------

DATE_COLUMNS = """CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
    strftime(date, '%b') AS month_name, strftime(date, '%b %Y') AS month_year"""
SORT_KEY = "CAST(year(date) * 100 + month(date) AS INT) AS year_month_sort"
add(
    "ca1_date_table",
    f"SELECT date, {DATE_COLUMNS}, concat('Q', CAST(quarter(date) AS VARCHAR)) AS quarter, {SORT_KEY} FROM cal",
    CALENDAR,
)
add(
    "ca2_month_labels",
    f"""SELECT month_year, year_month_sort, month_name, month, count(*) AS n_days
       FROM (SELECT date, {DATE_COLUMNS}, {SORT_KEY} FROM cal) GROUP BY 1, 2, 3, 4""",
    CALENDAR,
)
add(
    "ca3_daily_sales",
    f"""SELECT date, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, {S} AS sales,
       count(order_id) AS n_lines FROM cal LEFT JOIN (SELECT order_id, order_date, sales FROM feat)
       ON date = order_date GROUP BY date""",
    CALENDAR,
)
VALUES = {
    "total_sales": S,
    "total_profit": P,
    "total_orders": "count(DISTINCT order_id)",
    "total_quantity": "CAST(sum(quantity) AS BIGINT)",
    "total_customers": "count(DISTINCT customer_id)",
    "profit_margin": f"{P} / nullif({S}, 0)",
    "avg_order_value": f"{S} / nullif(count(DISTINCT order_id), 0)",
    "avg_discount": f"{D} / nullif(count(discount), 0)",
    "loss_making_sales": f"CAST(sum(sales) FILTER (WHERE profit < 0) AS DOUBLE)",
}


def visual(measures: list[str], by: list[str], where: str = "TRUE", share: bool = False) -> str:
    keys = ", ".join(by)
    out = [*by, *[f"{VALUES[m]} AS {m}" for m in measures]]
    if share:
        out.append(f"{S} / nullif((SELECT {S} FROM feat WHERE {where}), 0) AS pct_of_total_sales")
    return f"SELECT {', '.join(out)} FROM feat WHERE {where}" + (f" GROUP BY {keys}" if by else "")


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
    add(f"{_id}_{_measure}", visual([_measure], _by))
add("me14_pct_of_total_sales", visual(["total_sales"], ["industry"], ASIA_EUROPE, True))
add("me19_measure_layer", visual(list(MEASURES), ["region", "segment"], ASIA_EUROPE, True))
YEARS_SEGMENTS = "segment IN ('SMB', 'Enterprise')"
YEARS = f"{YEARS_SEGMENTS} AND year IN (1997, 1998)"
add("me18_filter_context", visual(["total_sales", "total_orders", "profit_margin"], ["region"], YEARS))


def shifted(months_back: int) -> str:
    """Sum of the calendar month that lies ``months_back`` earlier, by lookup."""
    return f"""(SELECT s FROM per b WHERE b.k IS NOT DISTINCT FROM g.k
        AND b.year * 12 + b.month = g.year * 12 + g.month - {months_back})"""


def time_visual(
    columns: dict[str, str], key: str = "", where: str = "TRUE", pick: str = "TRUE"
) -> tuple[str, str]:
    """Month grid, once per key, with lookups instead of windows."""
    k = key or "CAST(NULL AS VARCHAR)"
    ctes = f"""{CALENDAR},
per AS (SELECT {k} AS k, year, month, sum(sales) AS s FROM feat WHERE {where} GROUP BY 1, 2, 3),
g AS (SELECT ks.k, m.year, m.month, p.s FROM (SELECT DISTINCT k FROM per) ks CROSS JOIN months m
      LEFT JOIN per p ON p.k IS NOT DISTINCT FROM ks.k AND p.year = m.year AND p.month = m.month),
t AS (SELECT g.*, {shifted(12)} AS ly, {shifted(1)} AS prev,
        (SELECT sum(s) FROM per b WHERE b.k IS NOT DISTINCT FROM g.k AND b.year = g.year
           AND b.month <= g.month) AS ytd,
        (SELECT sum(s) FROM per b WHERE b.k IS NOT DISTINCT FROM g.k AND {pick.replace('year', 'b.year')}
           AND b.year * 12 + b.month <= g.year * 12 + g.month) AS run
      FROM g)"""
    lead = f"k AS {key}, " if key else ""
    body = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return f"SELECT {lead}year, month, {body} FROM t WHERE {pick}", ctes


def growth(ref: str) -> str:
    return f"CASE WHEN {ref} IS NOT NULL THEN {dbl(f'coalesce(s, 0) - {ref}')} / nullif({dbl(ref)}, 0) END"


NOW, LY, YOY = dbl("s"), dbl("ly"), growth("ly")
YTD, MOM, RUN = dbl("ytd"), growth("prev"), dbl("run")
add("me9_sales_ly", *time_visual({"total_sales": NOW, "sales_ly": LY}, "region"))
add("me10_sales_yoy", *time_visual({"total_sales": NOW, "sales_ly": LY, "sales_yoy": YOY}))
add("me11_sales_ytd", *time_visual({"total_sales": NOW, "sales_ytd": YTD}, "segment"))
add("me12_sales_mom", *time_visual({"total_sales": NOW, "sales_mom": MOM}))
add("me12_sales_mom_sliced", *time_visual({"total_sales": NOW, "sales_mom": MOM}, where=ASIA_EUROPE))
add("me15_running_total", *time_visual({"total_sales": NOW, "running_total": RUN}))
add(
    "me18_time_in_context",
    *time_visual(
        {
            "total_sales": NOW, "sales_ly": LY, "sales_yoy": YOY, "sales_ytd": YTD, "sales_mom": MOM,
            "running_total": RUN,
        },
        where=YEARS_SEGMENTS,
        pick="year IN (1997, 1998)",
    ),
)
DAILY = f"""{CALENDAR},
per AS (SELECT order_date AS d, sum(sales) AS s FROM feat GROUP BY 1)"""
add(
    "me9_sales_ly_daily",
    f"""SELECT date, {dbl('p.s')} AS total_sales, {dbl('y.s')} AS sales_ly,
       {dbl('sum(p.s) OVER (PARTITION BY year(date) ORDER BY date)')} AS sales_ytd,
       {dbl('sum(p.s) OVER (ORDER BY date)')} AS running_total
       FROM cal LEFT JOIN per p ON p.d = date LEFT JOIN per y ON y.d = CAST(date - INTERVAL 1 YEAR AS DATE)""",
    DAILY,
)
add(
    "me15_running_total_by_day",
    f"""SELECT r.region, date, {dbl('sum(p.s) OVER (PARTITION BY r.region ORDER BY date)')} AS running_total
       FROM cal CROSS JOIN (SELECT DISTINCT region FROM feat) r
       LEFT JOIN (SELECT region, order_date AS d, sum(sales) AS s FROM feat GROUP BY 1, 2) p
       ON p.d = date AND p.region = r.region""",
    CALENDAR,
)


def interval_visual(columns: dict[str, str], points: list[str], unit: str = "month") -> tuple[str, str]:
    """Every customer's breakpoints, and values looked up at each of them."""
    at = "CAST(date_trunc('month', order_date) AS DATE)" if unit == "month" else "order_date"
    ctes = f"""{CALENDAR},
per AS (SELECT customer AS k, {at} AS m, sum(sales) AS s FROM feat GROUP BY 1, 2),
pts AS (SELECT DISTINCT k, CAST(p AS DATE) AS p FROM (
          SELECT k, unnest([{', '.join(f'CAST({x} AS DATE)' for x in points)}]) AS p FROM per
          UNION ALL SELECT k, lo FROM per, span), span WHERE p <= hi),
t0 AS (SELECT k, p, CAST(coalesce(lead(p) OVER (PARTITION BY k ORDER BY p) - INTERVAL 1 {unit},
          date_trunc('{unit}', hi)) AS DATE) AS z FROM pts, span),
t AS (SELECT t0.*,
        (SELECT s FROM per b WHERE b.k = t0.k AND b.m = p) AS s,
        (SELECT s FROM per b WHERE b.k = t0.k AND b.m = CAST(p - INTERVAL 1 YEAR AS DATE)) AS ly,
        (SELECT s FROM per b WHERE b.k = t0.k AND b.m = CAST(p - INTERVAL 1 MONTH AS DATE)) AS prev,
        (SELECT sum(s) FROM per b WHERE b.k = t0.k AND b.m <= p AND year(b.m) = year(p)) AS ytd,
        (SELECT sum(s) FROM per b WHERE b.k = t0.k AND b.m <= p) AS run
      FROM t0)"""
    body = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return f"SELECT k AS customer, p AS first, z AS last, {body} FROM t", ctes


_NEXT, _SECOND, _YEAR = "m + INTERVAL 1 MONTH", "m + INTERVAL 2 MONTH", "m + INTERVAL 1 YEAR"
add(
    "me9_sales_ly_by_customer",
    *interval_visual({"total_sales": NOW, "sales_ly": LY, "sales_yoy": YOY}, ["m", _NEXT, _YEAR, "m + INTERVAL 13 MONTH"]),
)
add("me11_sales_ytd_by_customer", *interval_visual({"sales_ytd": YTD}, ["m", "make_date(year(m) + 1, 1, 1)"]))
add("me12_sales_mom_by_customer", *interval_visual({"sales_mom": MOM}, ["m", _NEXT, _SECOND]))
add("me15_running_total_by_customer", *interval_visual({"running_total": RUN}, ["m"]))
add("me15_running_total_by_customer_day", *interval_visual({"running_total": RUN}, ["m"], "day"))


def ranged_visual(lo: str, hi: str, key: str = "", where: str = "TRUE") -> tuple[str, str]:
    """Selected days of every month, and the days that they look back at, summed day by day."""
    k = key or "CAST(NULL AS VARCHAR)"
    back = lambda n: f"""(SELECT sum(s) FROM per b WHERE b.k IS NOT DISTINCT FROM v.k AND b.d >= CAST(a - INTERVAL {n} AS DATE)
        AND b.d <= CASE WHEN z = last_day(z) THEN last_day(CAST(z - INTERVAL {n} AS DATE)) ELSE CAST(z - INTERVAL {n} AS DATE) END)"""  # noqa: E731
    ctes = f"""{CALENDAR},
per AS (SELECT {k} AS k, order_date AS d, sum(sales) AS s FROM feat WHERE {where} GROUP BY 1, 2),
v AS (SELECT ks.k, year, month, greatest(make_date(year, month, 1), DATE '{lo}') AS a,
        least(last_day(make_date(year, month, 1)), DATE '{hi}') AS z
      FROM (SELECT DISTINCT k FROM per) ks CROSS JOIN months
      WHERE make_date(year, month, 1) <= DATE '{hi}' AND last_day(make_date(year, month, 1)) >= DATE '{lo}'),
t AS (SELECT v.*,
        (SELECT sum(s) FROM per b WHERE b.k IS NOT DISTINCT FROM v.k AND b.d BETWEEN a AND z) AS s,
        {back('1 YEAR')} AS ly, {back('1 MONTH')} AS prev,
        (SELECT sum(s) FROM per b WHERE b.k IS NOT DISTINCT FROM v.k AND b.d <= z AND year(b.d) = v.year) AS ytd,
        (SELECT sum(s) FROM per b WHERE b.k IS NOT DISTINCT FROM v.k AND b.d BETWEEN DATE '{lo}' AND z) AS run
      FROM v)"""
    lead = f"k AS {key}, " if key else ""
    return f"""SELECT {lead}year, month, {NOW} AS total_sales, {LY} AS sales_ly, {YOY} AS sales_yoy, {YTD} AS sales_ytd,
       {MOM} AS sales_mom, {RUN} AS running_total FROM t""", ctes


def daily_visual(pick: str, key: str = "") -> tuple[str, str]:
    k = key or "CAST(NULL AS VARCHAR)"
    look = lambda what, when: f"(SELECT {what} FROM per b WHERE b.k IS NOT DISTINCT FROM ks.k AND {when})"
    lead = f"k AS {key}, " if key else ""
    return f"""SELECT {lead}date, {dbl(look('s', 'b.d = date'))} AS total_sales,
       {dbl(look('s', 'b.d = CAST(date - INTERVAL 1 YEAR AS DATE)'))} AS sales_ly,
       {dbl(look('sum(s)', 'year(b.d) = year(date) AND b.d <= date'))} AS sales_ytd,
       {dbl(look('sum(s)', f"b.d <= date AND {pick.replace('date', 'b.d')}"))} AS running_total
       FROM (SELECT DISTINCT k FROM per) ks CROSS JOIN cal WHERE {pick}""", f"""{CALENDAR},
per AS (SELECT {k} AS k, order_date AS d, sum(sales) AS s FROM feat GROUP BY 1, 2)"""


add("me18_mid_month_range", *ranged_visual("1996-02-29", "1998-02-10", "region"))
add("me18_part_of_a_month", *ranged_visual("1997-02-05", "1997-02-20", where="segment = 'SMB'"))
add("me18_days_in_range", *daily_visual("date BETWEEN '1996-02-29' AND '1998-02-10'", "region"))
add("me18_days_of_years", *daily_visual("year(date) IN (1996, 1998)"))
add(
    "me16_product_rank",
    f"""SELECT product, {dbl('revenue')} AS total_sales,
       rank() OVER (ORDER BY coalesce(revenue, 0) DESC) AS product_rank
       FROM (SELECT DISTINCT product FROM feat) LEFT JOIN
       (SELECT product, sum(sales) AS revenue FROM feat WHERE segment = 'SMB' GROUP BY product) USING (product)""",
)
add(
    "me16_product_rank_by_region",
    f"""SELECT region, product, {dbl('revenue')} AS total_sales,
       rank() OVER (PARTITION BY region ORDER BY revenue DESC) AS product_rank FROM rev""",
    REVENUE.format(keys="region, product"),
)
add(
    "me17_cumulative_share",
    f"""SELECT customer, {dbl('revenue')} AS total_sales,
       {dbl('sum(revenue) OVER (ORDER BY revenue DESC)')} / {dbl('sum(revenue) OVER ()')} AS cumulative_share
       FROM (SELECT customer, sum(sales) AS revenue FROM feat WHERE segment = 'SMB' GROUP BY customer)""",
)
add(
    "me17_cumulative_share_by_region",
    f"""SELECT region, customer, {dbl('revenue')} AS total_sales,
       {dbl('sum(revenue) OVER (PARTITION BY region ORDER BY revenue DESC)')}
       / {dbl('sum(revenue) OVER (PARTITION BY region)')} AS cumulative_share FROM rev""",
    REVENUE.format(keys="region, customer"),
)

# -- stored aggregates -----------------------------------------------------------

CARDS = ["total_sales", "total_profit", "profit_margin", "total_orders", "avg_order_value"]
ASIA_YEARS = f"{ASIA_EUROPE} AND year IN (1996, 1997)"
add("me3_total_orders_stored", visual(["total_orders", "total_customers"], ["region"], ASIA_YEARS))
add("me5_total_customers_stored", visual(["total_customers"], ["year", "month"], "segment = 'SMB'"))
add("me19_measure_layer_stored", visual(list(MEASURES), ["region", "segment"], ASIA_EUROPE, True))
add("vi1_kpi_cards_synced", visual(CARDS, [], ASIA_YEARS))
add("vi2_monthly_trend_synced", visual(["total_sales", "total_profit"], ["year", "month"], ASIA_YEARS))
add("vi4_product_profit_synced", visual(["total_profit", "total_orders"], ["product"], YEARS))
add("vi11_industry_segment_synced", visual(["total_sales", "profit_margin", "total_customers"], ["industry", "segment"], YEARS))
add("vi12_customer_table_synced", visual(CARDS, ["customer"], ASIA_YEARS))
add("vi1_kpi_cards_mid_months", visual(CARDS, ["region"], "order_date BETWEEN '1996-02-29' AND '1998-02-10'"))

# -- visuals -----------------------------------------------------------------------

add("vi1_kpi_cards", visual(CARDS, []))
add(
    "vi2_monthly_trend",
    f"""SELECT strftime(min(order_date), '%b %Y') AS month_year, year * 100 + month AS year_month_sort,
       {S} AS total_sales, {P} AS total_profit FROM feat GROUP BY year, month""",
)
add("vi3_region_bars", visual(["total_sales", "total_profit"], ["region"]))
add(
    "vi4_product_profit",
    f"SELECT product, {P} AS total_profit, sum(profit) < 0 AS is_loss FROM feat GROUP BY product",
)
add("vi5_top_customers", f"SELECT * FROM {top(10)}")
add("vi5_top_customers_sliced", f"SELECT * FROM {top(10, ASIA_EUROPE)}")
add("vi7_discount_profit_scatter", visual(["avg_discount", "total_profit"], ["segment", "product"]))
add(
    "vi8_product_table",
    f"""SELECT *, round((profit_margin - min(profit_margin) OVER ())
       / nullif(max(profit_margin) OVER () - min(profit_margin) OVER (), 0), 6) AS colour
       FROM ({visual(['total_sales', 'total_profit', 'profit_margin'], ['product'])})""",
)


def _matrix(row: str, column: str, measures: str) -> str:
    return f"""SELECT {row}, {column}, GROUPING({row}) = 1 AS {row}_total, GROUPING({column}) = 1 AS {column}_total,
       {measures} FROM feat GROUP BY CUBE ({row}, {column})"""


add("vi9_product_region_matrix", _matrix("product", "region", f"{P} AS profit"))
add(
    "vi10_pareto_chart",
    f"""SELECT customer, {PARETO} FROM rev ORDER BY rev.revenue DESC, customer LIMIT 15""",
    REVENUE.format(keys="customer"),
)


add(
    "vi11_industry_segment_matrix",
    _matrix("industry", "segment", f"{S} AS sales, {P} / nullif({S}, 0) AS margin"),
)
add("vi12_customer_table", visual(CARDS, ["customer"]))
_ONE = {"customer": "Customer#000000001", "product": "Brand#1"}
for _id, _key, _other in (("vi13", "customer", "product"), ("vi14", "product", "customer")):
    for _name, _only in ((_key, "TRUE"), (f"one_{_key}", f"{_key} = '{_ONE[_key]}'")):
        add(f"{_id}_{_name}_kpis", visual(CARDS, [_key], _only))
        add(f"{_id}_{_name}_monthly", visual(["total_sales"], [_key, "year", "month"], _only))
        add(
            f"{_id}_{_name}_orders",
            f"""SELECT {_key}, order_id, order_date, {_other}, {S} AS sales, {P} AS profit, CAST(sum(quantity) AS BIGINT)
               AS quantity, count(*) AS n_lines FROM feat WHERE {_only} GROUP BY 1, 2, 3, 4""",
        )
