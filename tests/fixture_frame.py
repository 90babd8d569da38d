"""The two-order frame behind the hand-worked tests."""

FIXTURE_HEADERS = [
    "Order ID", "Order Date", "Customer ID", "Customer", "Region", "Segment", "Industry", "Product",
    "Sales", "Quantity", "Discount", "Profit",
]
FIXTURE_ROWS = [
    ("ORD-1", "2023-01-15", "C1", "Acme", "AMER", "SMB", "Finance", "FinanceHub", 1000.0, 2, 0.10, 200.0),
    ("ORD-1", "2023-01-15", "C1", "Acme", "AMER", "SMB", "Finance", "Support", 500.0, 1, 0.0, -50.0),
    ("ORD-2", "2023-02-20", "C2", "Globex", "EMEA", "Enterprise", "Energy", "FinanceHub", 2000.0, 4, 0.20, 400.0),
]
FIXTURE_TYPES = ["string"] * 8 + ["double", "int", "double", "double"]


def raw_frame(spark, rows):
    schema = ", ".join(f"`{h}` {t}" for h, t in zip(FIXTURE_HEADERS, FIXTURE_TYPES, strict=True))
    return spark.createDataFrame(rows, schema)
