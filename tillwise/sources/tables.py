"""The shop's raw tables and the returns sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import DATE_FORMATS, as_double, as_flag, as_timestamp
from ..schemas import CUSTOMERS, ORDERS, PRODUCTS, RETURNS, RETURNS_SHEET, require_columns
from .losses import typed_with_losses

# Customer types by number of orders.
RETURNING = "Returning Customer"
NEW = "New/One-Time Customer"
TYPE_UNKNOWN = "Unknown (Orders Count Missing)"

SHEET_NAMES = {
    "Date": "return_date",
    "Product Name": "product_name",
    "Quantity": "returned_quantity",
    "Comments": "return_comments",
}


def read_orders(
    spark: SparkSession, path: str, fmt: str = "parquet", losses: Observation | None = None
) -> DataFrame:
    """The orders table, typed: one row per order, lines in three parallel arrays."""
    rows = _pick(spark.read.format(fmt).load(path), ORDERS.names, "orders")
    return _typed(rows, ORDERS, losses)


def read_products(
    spark: SparkSession, path: str, fmt: str = "parquet", losses: Observation | None = None
) -> DataFrame:
    """The product catalog, typed: SKUs and tags as arrays."""
    rows = _pick(spark.read.format(fmt).load(path), PRODUCTS.names, "products")
    return _typed(rows, PRODUCTS, losses)


def read_customers(
    spark: SparkSession, path: str, fmt: str = "parquet", losses: Observation | None = None
) -> DataFrame:
    """The customer master with all its columns, typed."""
    return typed_customers(spark.read.format(fmt).load(path), losses)


def read_returns(
    spark: SparkSession, path: str, losses: Observation | None = None, **options: str
) -> DataFrame:
    """The returns sheet exported as CSV, typed. A blank cell is an empty text, not null."""
    return typed_returns(read_returns_sheet(spark, path, **options), losses=losses)


def read_returns_sheet(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The sheet's text cells. Quotes are doubled inside quoted cells, which may have line
    breaks; so a file is read by one task, and a sheet of any size belongs in several."""
    quoted = {"quote": '"', "escape": '"', "multiLine": True}
    return spark.read.options(**(quoted | options)).csv(path, header=True).na.fill("")


def _pick(df: DataFrame, names: Sequence[str], what: str) -> DataFrame:
    require_columns(df, names, what)
    return df.select(*names)


def _typed(
    df: DataFrame, schema: T.StructType, losses: Observation | None = None
) -> DataFrame:
    """Times and numbers of ``schema`` typed; what cannot be read becomes null, and is counted if
    ``losses`` are given."""
    numbers = (T.DoubleType(), T.ArrayType(T.DoubleType()))
    present = [field for field in schema if field.name in df.columns]
    typed = {f.name: as_timestamp(df, f.name) for f in present if f.dataType == T.TimestampType()}
    typed |= {f.name: as_double(df, f.name) for f in present if f.dataType in numbers}
    return df.withColumns(typed) if losses is None else typed_with_losses(df, typed, losses)


def customer_type(df: DataFrame) -> Column:
    """Returning or new by the number of orders; null counts as new."""
    if "orders_count" not in df.columns:
        return F.lit(TYPE_UNKNOWN)
    return F.when(F.col("orders_count") > 1, RETURNING).otherwise(NEW)


def typed_customers(customers: DataFrame, losses: Observation | None = None) -> DataFrame:
    """Times, numbers and the opt-in flag typed, customer type added."""
    customers = _typed(customers, CUSTOMERS, losses)
    if "marketing_opt_in" in customers.columns:
        flag = as_flag(customers, "marketing_opt_in")
        customers = customers.withColumn("marketing_opt_in", flag)
    return customers.withColumn("imputed_customer_type", customer_type(customers))


def typed_returns(
    sheet: DataFrame,
    formats: Sequence[str] = DATE_FORMATS,
    losses: Observation | None = None,
) -> DataFrame:
    """The returns sheet renamed and typed; rows without a readable date or quantity go.

    Each date cell is tried against all ``formats``, whatever the other rows look like. With
    ``losses``, what goes is counted as ``typed_with_losses`` says.
    """
    required = ["return_date", "returned_quantity"]
    if losses is not None:
        named = _named(sheet)
        return typed_with_losses(named, _typed_cells(named, formats), losses, required)
    return _cells(sheet, formats)[1].drop("_raw").dropna(subset=required)


def unreadable_returns(sheet: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """The rows that ``typed_returns`` leaves out, as they are in the sheet."""
    named, typed = _cells(sheet, formats)
    cells = [F.col(f"_{name}").alias(name) for name in named.columns]
    kept = typed.withColumns({f"_{name}": F.col(f"_raw.{name}") for name in named.columns})
    lost = kept.where("return_date is null or returned_quantity is null")
    return lost.select(*cells)


def _cells(sheet: DataFrame, formats: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The sheet under its new names; the same typed, with the raw cells beside."""
    named = _named(sheet)
    raw = {"_raw": F.struct(*named.columns)}
    return named, named.withColumns(raw | _typed_cells(named, formats))


def _named(sheet: DataFrame) -> DataFrame:
    named = sheet.withColumnsRenamed(SHEET_NAMES)
    require_columns(named, RETURNS.names, f"returns sheet ({', '.join(RETURNS_SHEET.names)})")
    return named


def _typed_cells(named: DataFrame, formats: Sequence[str]) -> dict[str, Column]:
    return {
        "return_date": as_timestamp(named, "return_date", formats),
        "returned_quantity": as_double(named, "returned_quantity"),
    }
