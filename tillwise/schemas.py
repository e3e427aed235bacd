"""Input and line-item schemas, and the column checks made while a plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()
_NUMBER = T.DoubleType()
_TIME = T.TimestampType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# The input columns.
ORDERS = _struct(
    order_date=_TIME,
    updated_at=_TIME,
    order_id=_TEXT,
    order_number=_NUMBER,
    customer_id=_TEXT,
    email=_TEXT,
    product_sku=T.ArrayType(_TEXT),
    product_ids=T.ArrayType(_TEXT),
    quantities=T.ArrayType(_NUMBER),
    cross_product_linkage=_TEXT,
    total_order_value=_NUMBER,
    discount_applied=_TEXT,
    discount_amount=_NUMBER,
    tax_amount=_NUMBER,
    payment_status=_TEXT,
    fulfillment_status=_TEXT,
    shipping_method=_TEXT,
    shipping_cost=_NUMBER,
    referring_site=_TEXT,
    return_refund_status=_TEXT,
    order_channel=_TEXT,
    customer_type=_TEXT,
    order_status_from_tag=_TEXT,
    geography_country=_TEXT,
    geography_state=_TEXT,
    geography_city=_TEXT,
    geography_postal_code=_TEXT,
    shipping_address_latitude=_NUMBER,
    shipping_address_longitude=_NUMBER,
)

PRODUCTS = _struct(
    product_id=_TEXT,
    product_sku=T.ArrayType(_TEXT),
    product_tags=T.ArrayType(_TEXT),
    product_name=_TEXT,
    product_status=_TEXT,
    product_type=_TEXT,
    price=_NUMBER,
    product_created_at=_TIME,
    updated_at=_TIME,
    stock_available=_NUMBER,
    shipping_weight=_NUMBER,
)

CUSTOMERS = _struct(
    customer_id=_TEXT,
    first_name=_TEXT,
    email=_TEXT,
    signup_date=_TIME,
    updated_at=_TIME,
    total_spent=_NUMBER,
    orders_count=_NUMBER,
    aov=_NUMBER,
    marketing_opt_in=T.BooleanType(),
    state=_TEXT,
    city=_TEXT,
)

# The returns sheet as exported: a header row, then text cells only.
RETURNS_SHEET = T.StructType(
    [T.StructField(name, _TEXT) for name in ("Date", "Product Name", "Quantity", "Comments")]
)

RETURNS = _struct(
    return_date=_TIME, product_name=_TEXT, returned_quantity=_NUMBER, return_comments=_TEXT
)

# The columns of the line-item table in output order. Two order columns are
# renamed on the way, as products have columns of the same names.
LINE_ITEM_COLUMNS = (
    "order_date",
    "order_updated_at",
    "order_id",
    "order_number",
    "customer_id",
    "customer_email",
    "order_product_sku",
    "order_product_id",
    "quantity",
    "cross_product_linkage",
    "total_order_value",
    "discount_applied",
    "discount_amount",
    "tax_amount",
    "payment_status",
    "fulfillment_status",
    "shipping_method",
    "shipping_cost",
    "referring_site",
    "return_refund_status",
    "order_channel",
    "customer_type",
    "order_status_from_tag",
    "geography_country",
    "geography_state",
    "geography_city",
    "geography_postal_code",
    "shipping_address_latitude",
    "shipping_address_longitude",
    "product_name",
    "product_status",
    "product_type",
    "price",
    "product_created_at",
    "product_updated_at",
    "stock_available",
    "individual_product_tag",
    "product_sku",
    "shipping_weight",
)


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> None:
    """Raise a ValueError naming the columns that ``df`` lacks."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the column(s) {', '.join(missing)}")


def optional_column(df: DataFrame, name: str, fallback: object) -> Column:
    """``df[name]`` where the column exists, else the constant ``fallback``."""
    return F.col(name) if name in df.columns else F.lit(fallback)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A frame without rows; every operator gives its own result schema on it."""
    return spark.createDataFrame([], schema)
