"""From orders with parallel arrays and a product catalog to the line-item table.

A line-item row is one order line x matching product SKU x product tag: a line whose product
has three tags stands there three times, and line-level sums count it three times. Order
lines without a matching product stay, with null product columns; a product without tags or
without SKUs matches nothing.

``sku_sales`` and ``order_totals`` give the same sums without building that table. The
first adds the order lines up per SKU before they meet the catalog, the second adds the
catalog up per SKU before it meets the order lines, so neither a SKU with very many lines
nor a SKU shared by many products multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import free_name
from ..functions.numbers import as_double, as_timestamp, exact_sum
from ..functions.referrers import DEFAULT_SUFFIXES, Store, Suffixes, with_referrer
from ..schemas import LINE_ITEM_COLUMNS, optional_column, require_columns
from .hot_keys import hot_join

TIMES = ("order_date", "order_updated_at", "product_created_at", "product_updated_at")
NUMBERS = (
    "order_number",
    "quantity",
    "total_order_value",
    "discount_amount",
    "tax_amount",
    "shipping_cost",
    "shipping_address_latitude",
    "shipping_address_longitude",
    "price",
    "stock_available",
    "shipping_weight",
)

ARRAYS = ("product_sku", "product_ids", "quantities")

# What stands for a missing value, and for a column that is missing.
NO_TAG = "Unknown Tag"
NO_STATUS = "Other/Unknown"
NO_CUSTOMER_TYPE = "Unknown"
STATUS_COLUMN_MISSING = "N/A (Status Tag Missing)"
SITE_COLUMN_MISSING = "N/A (Site Data Missing)"
TAG_COLUMN_MISSING = "N/A (Tags Missing)"
CUSTOMER_TYPE_COLUMN_MISSING = "N/A (Customer Type Missing)"


def line_count() -> Column:
    """How many lines the three arrays of an order give: the length of the shortest."""
    return F.least(*[F.coalesce(F.array_size(name), F.lit(0)) for name in ARRAYS])


def order_lines(orders: DataFrame, numbered: bool = False) -> DataFrame:
    """One row per position that all three arrays of an order have; on request with its
    ``line_number`` from 1."""
    require_columns(orders, ARRAYS, "orders")
    at, line = (free_name(orders.columns, name) for name in ("_at", "_line"))
    zipped = F.slice(F.arrays_zip(*ARRAYS), F.lit(1), line_count())
    others = [F.col(name) for name in orders.columns if name not in ARRAYS]
    if numbered:
        lines = orders.select("*", F.posexplode(zipped).alias(at, line))
        others.append((F.col(at) + 1).alias("line_number"))
    else:
        lines = orders.withColumn(line, F.explode(zipped))
    return lines.select(
        *others,
        F.col(f"{line}.product_sku").alias("order_product_sku"),
        F.col(f"{line}.product_ids").alias("order_product_id"),
        F.col(f"{line}.quantities").alias("quantity"),
    )


def product_skus(products: DataFrame) -> DataFrame:
    """One row per product and SKU, tags still in their array; untagged products drop out."""
    require_columns(products, ("product_sku", "product_tags"), "products")
    tagged = products.where(F.size("product_tags") > 0)
    columns = [name for name in products.columns if name != "product_sku"]
    return tagged.select(*columns, F.explode("product_sku").alias("product_sku"))


def products_by_sku(products: DataFrame) -> DataFrame:
    """One row per SKU: the tagged product with the smallest ``product_id`` that has it, and in
    ``product_tags`` all tags of all its products, each once, in order."""
    skus = product_skus(products).where(F.col("product_sku").isNotNull())
    names = [name for name in skus.columns if name not in ("product_sku", "product_tags", "product_id")]
    whole = F.struct("product_id", *names) if "product_id" in skus.columns else F.struct(*names)
    first = skus.groupBy("product_sku").agg(F.min(whole).alias("first"))
    tags = skus.select("product_sku", F.explode("product_tags").alias("tag"))
    tags = tags.groupBy("product_sku").agg(F.array_sort(F.collect_set("tag")).alias("product_tags"))
    return first.join(tags, "product_sku").select("product_sku", "first.*", "product_tags")


def line_items(
    orders: DataFrame,
    products: DataFrame,
    stores: Sequence[Store] = (),
    suffixes: Suffixes | DataFrame = DEFAULT_SUFFIXES,
    grain: str = "tag",
    frequent: DataFrame | None = None,
) -> DataFrame:
    """The full line-item table: 39 columns of both sides and 6 derived ones.

    With ``frequent``, the SKUs that ``frequent_keys`` finds in the order lines, only these are split
    in the product join, and only their products copied.

    With ``grain="line"`` it has one row per order line, whatever the tags and products of its
    SKU: ``line_number`` takes the place of ``individual_product_tag``, the product columns are those of
    ``products_by_sku``, ``product_tags_list`` has all tags in order and ``product_tags_compound`` names
    them. So a sum over lines counts each once.
    """
    if grain not in ("tag", "line"):
        raise ValueError(f"a grain of line items is 'tag' or 'line', not {grain!r}")
    # Sources are named per order, before its lines and their tags multiply it.
    named = with_source(orders, stores, suffixes)
    if grain == "tag":
        return join_products(order_lines(named), products, stores, suffixes, frequent)
    return join_skus(order_lines(named, numbered=True), products, stores, suffixes, frequent)


def join_skus(
    lines: DataFrame,
    products: DataFrame,
    stores: Sequence[Store] = (),
    suffixes: Suffixes | DataFrame = DEFAULT_SUFFIXES,
    frequent: DataFrame | None = None,
) -> DataFrame:
    """Line items of one row per line, from numbered order lines."""
    lines = _renamed(lines)
    catalog = products_by_sku(products).withColumnRenamed("updated_at", "product_updated_at")
    joined = _with_products(lines, catalog.drop("product_id"), frequent)
    columns = [name for name in LINE_ITEM_COLUMNS if name != "individual_product_tag"]
    derived = [name for name in ("cleaned_referring_site",) if name in joined.columns]
    items = typed_lines(joined.select("line_number", *columns, *derived, "product_tags"))
    tags = F.coalesce("product_tags", F.array().cast("array<string>"))
    named = F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise(NO_TAG)
    items = derived_columns(items, stores, suffixes)
    items = items.withColumns({"product_tags_list": tags, "product_tags_compound": named})
    return items.drop("product_tags")


def with_source(
    orders: DataFrame, stores: Sequence[Store] = (), suffixes: Suffixes | DataFrame = DEFAULT_SUFFIXES
) -> DataFrame:
    """Add ``cleaned_referring_site`` unless it is there already."""
    if "cleaned_referring_site" in orders.columns:
        return orders
    if "referring_site" in orders.columns:
        return with_referrer(orders, "referring_site", "cleaned_referring_site", stores, suffixes)
    return orders.withColumn("cleaned_referring_site", F.lit(SITE_COLUMN_MISSING))


def _same_sku(lines: DataFrame) -> Column:
    """Equal SKUs. Lines without one match nothing; they are spread over all tasks of the join,
    where equal keys would meet in one."""
    sku = F.col("order_product_sku")
    place = [name for name in ("order_id", "quantity") if name in lines.columns]
    spread = F.concat(F.lit("\0"), F.xxhash64(*place, F.lit(0)).cast("string"))
    return (F.coalesce(sku, spread) == F.col("product_sku")) & sku.isNotNull()


def _with_products(lines: DataFrame, catalog: DataFrame, frequent: DataFrame | None) -> DataFrame:
    if frequent is None:
        return lines.join(catalog, _same_sku(lines), "left")
    # Lines of one order and quantity share a place, so no other column has to be hashed.
    spread = [name for name in ("order_id", "quantity") if name in lines.columns]
    return hot_join(lines, catalog, "order_product_sku", "product_sku", frequent, spread=spread)


def join_products(
    lines: DataFrame,
    products: DataFrame,
    stores: Sequence[Store] = (),
    suffixes: Suffixes | DataFrame = DEFAULT_SUFFIXES,
    frequent: DataFrame | None = None,
) -> DataFrame:
    """The line-item table from order lines that are already one row per line."""
    return _items(_with_products(_renamed(lines), _catalog(products), frequent), stores, suffixes)


def join_orders_and_products(
    orders: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    stores: Sequence[Store] = (),
    suffixes: Suffixes | DataFrame = DEFAULT_SUFFIXES,
    frequent: DataFrame | None = None,
) -> DataFrame:
    """The line-item table from orders and from their lines as a table of their own.

    What ``join_products`` gives for the orders joined with the lines. Here the lines meet the catalog
    first, while they are narrow, and their orders after it; so no line is shuffled and sorted
    with all columns of its order, and each order is sorted once, not once per line.
    """
    priced = _with_products(lines, _catalog(products), frequent)
    return _items(_renamed(orders).join(priced, "order_id"), stores, suffixes)


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"updated_at": "order_updated_at", "email": "customer_email"})


def _catalog(products: DataFrame) -> DataFrame:
    """One row per product and SKU, with its columns' names in the line-item table."""
    skus = product_skus(products).withColumnRenamed("updated_at", "product_updated_at")
    return skus.drop("product_id")


def _items(
    joined: DataFrame, stores: Sequence[Store], suffixes: Suffixes | DataFrame
) -> DataFrame:
    """The line-item table from joined rows: a row per tag, made after the last join."""
    tagged = joined.withColumn("individual_product_tag", F.explode_outer("product_tags"))
    derived = [name for name in ("cleaned_referring_site",) if name in tagged.columns]
    items = typed_lines(tagged.select(*LINE_ITEM_COLUMNS, *derived))
    return derived_columns(items, stores, suffixes)


def typed_lines(lines: DataFrame) -> DataFrame:
    """Times and numbers typed; what cannot be read becomes null."""
    typed = {name: as_timestamp(lines, name) for name in TIMES if name in lines.columns}
    typed |= {name: as_double(lines, name) for name in NUMBERS if name in lines.columns}
    return lines.withColumns(typed)


def derived_columns(
    lines: DataFrame, stores: Sequence[Store] = (), suffixes: Suffixes | DataFrame = DEFAULT_SUFFIXES
) -> DataFrame:
    """Line revenue, status, referrer name, tag forms and customer type."""
    present = set(lines.columns)
    if {"quantity", "price"} <= present:
        revenue = F.col("quantity") * F.col("price")
    else:
        revenue = F.lit(0.0)
    if "individual_product_tag" in present:
        tag = F.col("individual_product_tag")
        tags = F.when(tag != "", F.array(tag)).otherwise(F.array().cast("array<string>"))
        compound = F.coalesce(tag, F.lit(NO_TAG))
    else:
        tags = F.array().cast("array<string>")
        compound = F.lit(TAG_COLUMN_MISSING)
    status = optional_column(lines, "order_status_from_tag", STATUS_COLUMN_MISSING)
    customer_type = optional_column(lines, "customer_type", CUSTOMER_TYPE_COLUMN_MISSING)
    return with_source(lines, stores, suffixes).withColumns(
        {
            "line_item_revenue": revenue,
            "extracted_status": F.coalesce(status, F.lit(NO_STATUS)),
            "product_tags_list": tags,
            "product_tags_compound": compound,
            "imputed_customer_type": F.coalesce(customer_type, F.lit(NO_CUSTOMER_TYPE)),
        }
    )


def sku_sales(
    lines: DataFrame, products: DataFrame, keys: Sequence[str] = (), per_tag: bool = False
) -> DataFrame:
    """Quantity and revenue per (product SKU row, ``keys``), with the line-item sums.

    ``lines`` are order lines; ``keys`` are the order columns a result groups or filters by.
    The output has the line-item names ``quantity`` and ``line_item_revenue`` next to the
    product columns, so every result that only sums takes it in place of the line-item
    table; ``line_rows`` is the number of line-item rows summed. With ``per_tag`` there is a
    row per tag, else the tags are multiplied in.
    """
    units = lines.groupBy("order_product_sku", *keys).agg(
        exact_sum("quantity").alias("_units"),
        F.count(F.lit(1)).alias("line_rows"),
    )
    joined = units.join(
        product_skus(products), F.col("order_product_sku") == F.col("product_sku"), "left"
    )
    if per_tag:
        tag = F.explode_outer("product_tags").alias("_tag")
        joined = joined.select(*joined.columns, tag)
        joined = joined.withColumn("product_tags_compound", F.coalesce("_tag", F.lit(NO_TAG)))
        joined = joined.withColumn("quantity", F.col("_units")).drop("_tag")
    else:
        copies = F.coalesce(F.array_size("product_tags"), F.lit(1))
        joined = joined.withColumn("quantity", F.col("_units") * copies)
        joined = joined.withColumn("line_rows", F.col("line_rows") * copies)
    revenue = F.col("quantity") * F.col("price")
    return joined.withColumn("line_item_revenue", revenue).drop(
        "_units", "order_product_sku", "product_tags"
    )


# Copies of the per-SKU catalog, so that the lines of one SKU spread over several tasks.
SALTS = 4


# Orders whose sums one task holds at a time.
ORDERS_PER_TASK = 100_000


def order_tasks(orders: DataFrame) -> int:
    """How many tasks sum the lines of these orders; the rows of a stored table cost no scan."""
    return max(-(-orders.count() // ORDERS_PER_TASK), orders.sparkSession.sparkContext.defaultParallelism)


def order_totals(
    lines: DataFrame,
    products: DataFrame,
    priced_only: bool = False,
    frequent: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Per order, ``quantity``, ``line_item_revenue`` and ``line_rows`` of its line items.

    The catalog comes down to one row per SKU, the number of its line-item rows and their
    summed price, so a line never becomes more than one row. With ``priced_only`` only line
    items that have a revenue are counted. With ``frequent``, the SKUs that ``frequent_keys`` finds in
    the lines, only these are split and copied; else all SKUs have ``SALTS`` copies.

    The lines of an order are summed in one of ``tasks`` tasks, and a join with the orders takes as
    many; without it Spark decides by the bytes shuffled, which are few for very many orders.
    ``order_tasks`` gives a number for a number of orders.
    """
    skus = product_skus(products).where(F.col("price").isNotNull() | F.lit(not priced_only))
    copies = F.size("product_tags")
    weighed = skus.select(
        "product_sku", copies.alias("_rows"), (copies * F.col("price")).alias("_price")
    )
    weights = weighed.groupBy("product_sku").agg(
        F.sum("_rows").alias("_rows"), exact_sum("_price").alias("_price")
    )
    if frequent is None:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        weights = weights.withColumn("_copy", salts)
        salt = F.pmod(F.xxhash64("order_id"), F.lit(SALTS)).cast("int")
        items = lines.join(weights, _same_sku(lines) & (salt == F.col("_copy")), "left")
    else:
        items = _with_products(lines, weights, frequent)
    rows = F.coalesce(F.col("_rows"), F.lit(1))
    items = items.select(
        "order_id",
        (F.col("quantity") * rows).alias("quantity"),
        (F.col("quantity") * F.col("_price")).alias("line_item_revenue"),
        rows.alias("line_rows"),
    )
    if priced_only:
        items = items.where(F.col("line_item_revenue").isNotNull())
    if tasks is not None:
        items = items.repartition(tasks, "order_id")
    return items.groupBy("order_id").agg(
        exact_sum("quantity").alias("quantity"),
        exact_sum("line_item_revenue").alias("line_item_revenue"),
        F.sum("line_rows").alias("line_rows"),
    )


def last_sku_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """The newest order line of each SKU (by date, then order id) with its product columns."""
    newest = lines.groupBy("order_product_sku").agg(
        F.max(F.struct("order_date", "order_id")).alias("_newest")
    )
    joined = newest.join(
        product_skus(products), F.col("order_product_sku") == F.col("product_sku"), "left"
    )
    scratch = ("_newest", "order_product_sku", "product_tags")
    return joined.select("_newest.*", *[c for c in joined.columns if c not in scratch])

