"""Column contracts of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
RATE = T.DecimalType(5, 4)


# Delivered file, under its original headers.  One row is one order line.  Row ID is
# 64-bit here, since a large table outgrows 32 bits.
SOURCE = T.StructType(
    [
        T.StructField("Row ID", T.LongType()),
        T.StructField("Order ID", T.StringType()),
        T.StructField("Order Date", T.StringType()),
        T.StructField("Date Key", T.IntegerType()),
        T.StructField("Contact Name", T.StringType()),
        T.StructField("Country", T.StringType()),
        T.StructField("City", T.StringType()),
        T.StructField("Region", T.StringType()),
        T.StructField("Subregion", T.StringType()),
        T.StructField("Customer", T.StringType()),
        T.StructField("Customer ID", T.StringType()),
        T.StructField("Industry", T.StringType()),
        T.StructField("Segment", T.StringType()),
        T.StructField("Product", T.StringType()),
        T.StructField("License", T.StringType()),
        T.StructField("Sales", T.DoubleType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("Discount", T.DoubleType()),
        T.StructField("Profit", T.DoubleType()),
    ]
)

# Cleaned, feature-rich lines; the order of the 27 columns is part of the contract.
STAGING = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("date_key", T.IntegerType()),
        T.StructField("contact_name", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("subregion", T.StringType()),
        T.StructField("customer", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("product", T.StringType()),
        T.StructField("sales", MONEY),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("discount", RATE),
        T.StructField("profit", MONEY),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("month_name", T.StringType()),
        T.StructField("quarter", T.IntegerType()),
        T.StructField("year_month", T.StringType()),
        T.StructField("profit_margin", T.DecimalType(10, 6)),
        T.StructField("is_loss", T.BooleanType()),
        T.StructField("discount_pct", T.DecimalType(5, 2)),
        T.StructField("revenue_per_unit", T.DecimalType(12, 4)),
        T.StructField("revenue_band", T.StringType()),
    ]
)

CLEAN_COLUMNS = STAGING.fieldNames()

# The same columns as a BI tool types them: 64-bit whole numbers, plain doubles.
BI = T.StructType(
    [
        T.StructField(
            f.name,
            T.DoubleType()
            if isinstance(f.dataType, T.DecimalType)
            else T.LongType()
            if isinstance(f.dataType, T.IntegerType)
            else f.dataType,
        )
        for f in STAGING.fields
    ]
)

# Longest text each staging column may hold.
STAGING_WIDTHS = {
    "order_id": 20,
    "contact_name": 100,
    "country": 60,
    "city": 60,
    "region": 10,
    "subregion": 40,
    "customer": 120,
    "customer_id": 20,
    "industry": 60,
    "segment": 30,
    "product": 60,
    "month_name": 12,
    "year_month": 10,
    "revenue_band": 12,
}

# Identifier columns without analytical value once the file is loaded.
DROP_COLUMNS = ["row_id", "license"]

DIM_DATE = ["date_key", "full_date", "year", "quarter", "month", "month_name"]
DIM_CUSTOMER = ["customer_key", "customer_id", "customer_name", "industry", "segment"]
DIM_PRODUCT = ["product_key", "product_name"]
DIM_GEOGRAPHY = ["geography_key", "country", "city", "region", "subregion"]
FACT_SALES = [
    "sale_id",
    "order_id",
    "date_key",
    "customer_key",
    "product_key",
    "geography_key",
    "sales",
    "quantity",
    "discount",
    "profit",
]
