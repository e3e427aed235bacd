"""The shop's tables derived from a star schema (orders, lineitem, customer, part, ...).

The star tables are clean, so the expressions add the nulls, blanks, unreadable cells and
missing keys that the operators have rules for. Order lines are a table of their own here
and are never collected into the arrays of an order: one order may have any number of lines.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.referrers import Store
from ..functions.suffix_rules import suffix_rules
from ..operators.filters import date_range
from .tables import typed_customers, typed_returns

STORES = (Store("Example Shop", ("shop.example",)),)

# The parts that arrays of order lines are made of.
ARRAY_PARTS = 150

# The shop's columns as SQL over the star columns; together with STORES they are the shop.
_KNOWN_PLACE = "o_orderkey % 50 <> 0"
ORDER_SQL = {
    "order_date": "timestampadd(HOUR, cast(o_orderkey % 24 as int), o_orderdate)",
    "updated_at": "o_orderdate",
    "order_id": "o_orderkey",
    "order_number": "cast(o_orderkey as double)",
    "customer_id": "case when o_custkey % 50 <> 7 then o_custkey end",
    "email": "cast(null as string)",
    "cross_product_linkage": "cast(null as string)",
    "total_order_value": "o_totalprice",
    "discount_applied": """case when o_orderkey % 5 = 1 then ''
        when o_orderkey % 5 > 1 then 'CODE' || (o_orderkey % 23) end""",
    "discount_amount": "(o_orderkey % 40) * 2.5D",
    "tax_amount": "(o_orderkey % 30) * 1.25D",
    "payment_status": "'paid'",
    "fulfillment_status": "case when o_orderkey % 24 < 12 then 'fulfilled' end",
    "shipping_method": "o_orderpriority",
    "shipping_cost": "(o_orderkey % 7) * 10.0D",
    "return_refund_status": "cast(null as string)",
    "order_channel": "case o_orderkey % 4 when 0 then 'web' when 1 then 'pos' when 2 then 'app' end",
    "customer_type": "case o_orderkey % 3 when 0 then 'new' when 1 then 'returning' end",
    "order_status_from_tag": "case when o_orderkey % 11 <> 0 then o_orderstatus end",
    "geography_country": "'Example'",
    "geography_postal_code": "cast(null as string)",
}
PLACE_SQL = {
    "geography_state": f"case when {_KNOWN_PLACE} then n_name end",
    "geography_city": f"case when {_KNOWN_PLACE} then n_name || '-' || (o_custkey % 4) end",
    "shipping_address_latitude": f"case when {_KNOWN_PLACE} then 8.0D + n_nationkey end",
    "shipping_address_longitude": f"""case when {_KNOWN_PLACE}
        then 68.0D + (o_custkey % 4) * 0.5D end""",
}
SITE_SQL = {
    "referring_site": """case o_orderkey % 16 when 0 then null when 1 then ''
        when 2 then 'android-app://com.google.android.gm/'
        when 3 then 'https://www.google.com/search?q=x'
        when 4 then 'https://www.google.com/'
        when 5 then 'https://l.instagram.com/'
        when 6 then 'https://m.facebook.com/'
        when 7 then 'https://shop.example/products/1'
        when 8 then 'https://shop.example/?fbclid=1'
        when 9 then 'https://www.reddit.com/r/x' else url end""",
}
LINE_SQL = {
    "order_id": "l_orderkey",
    "order_product_sku": "'SKU-' || l_partkey",
    "order_product_id": "l_partkey",
    "quantity": "l_quantity",
}
PRODUCT_SQL = {
    "product_id": "p_partkey",
    "product_sku": "array('SKU-' || p_partkey)",
    "product_tags": """case when p_size % 10 <> 0 then array(p_type, p_brand)
        else cast(array() as array<string>) end""",
    "product_name": "p_name",
    "product_status": "'active'",
    "product_type": "p_type",
    "price": "p_retailprice",
    "product_created_at": "cast(null as timestamp)",
    "updated_at": "cast(null as timestamp)",
    "stock_available": "case when p_size % 7 <> 0 then cast(p_size as double) end",
    "shipping_weight": "cast(null as double)",
}
CUSTOMER_SQL = {
    "customer_id": "c_custkey",
    "first_name": "c_name",
    "email": "c_name || '@shop.example'",
    "signup_date": "cast(date_add(date'1995-01-01', cast(c_custkey % 700 as int)) as timestamp_ntz)",
    "updated_at": "cast(null as timestamp)",
    "total_spent": "c_acctbal",
    "orders_count": "case when c_custkey % 50 <> 49 then cast(c_custkey % 5 as double) end",
    "aov": "case when c_custkey % 50 <> 49 then c_acctbal / nullif(c_custkey % 5, 0) end",
    "marketing_opt_in": "c_custkey % 2 = 0",
    "state": "n_name",
    "city": "n_name || '-' || (c_custkey % 4)",
}
SHEET_SQL = {
    "Date": "case when l_suppkey % 50 = 0 then 'n/a' else date_format(l_shipdate, 'yyyy-MM-dd') end",
    "Product Name": "p_name",
    "Quantity": "case when l_partkey % 97 = 0 then '' else cast(l_quantity as string) end",
    "Comments": """case l_linenumber % 5 when 0 then 'Damaged / Late' when 1 then 'wrong item'
        when 2 then '' when 4 then 'Bad taste, smell' end""",
}


# Suffix rules, as a public list writes them, and hosts under all kinds of them.
SUFFIX_RULES = (
    "// suffixes", "", "com", "org", "uk", "co.uk", "a.b.com", "agency", "photography  // one word",
    "*.bd", "*.ck", "!www.ck",
)
RULED_SITE_SQL = """case o_orderkey % 12 when 0 then 'https://www.studio.photography/x'
    when 1 then 'http://a.agency' when 2 then 'https://news.bbc.com.bd/y?z=1'
    when 3 then 'https://x' || (o_custkey % 20) || '.y.ck/' when 4 then 'http://deep.www.ck/'
    when 5 then 'https://m.shop' || (o_custkey % 30) || '.co.uk:8080/q' when 6 then 'http://y.ck/'
    when 7 then 'http://10.0.0.' || (o_custkey % 9) when 8 then 'http://host' || (o_custkey % 15) || '/'
    when 10 then 'https://www.google.com/search?q=x' when 11 then 'https://user@q.a.b.com/' end"""


def _derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} as `{name}`" for name, sql in columns.items()])


class StarShop:
    """A shop in a folder of star-schema parquet files."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def _located_customers(self) -> DataFrame:
        nations = self.table("nation").select("n_nationkey", "n_name")
        same = F.col("c_nationkey") == F.col("n_nationkey")
        return self.table("customer").join(nations, same, "left")

    def orders(
        self,
        geography: bool = False,
        referrers: bool = False,
        start: dt.date | None = None,
        end: dt.date | None = None,
    ) -> DataFrame:
        """Order-level columns; those that need another table only on request.

        The range is applied to the stored date, where the file scan can use it.
        """
        raw = date_range(self.table("orders"), "o_orderdate", start, end)
        columns = dict(ORDER_SQL)
        if geography:
            homes = self._located_customers().select("c_custkey", "n_nationkey", "n_name")
            raw = raw.join(homes, F.col("o_custkey") == F.col("c_custkey"), "left")
            columns |= PLACE_SQL
        if referrers:
            pages = self.table("pages").select("page_id", "url")
            count = pages.agg(F.nullif(F.count("page_id"), F.lit(0))).scalar()
            # Every order gets a page, needed or not: null keys would all meet in one task.
            raw = raw.withColumn("_page", F.col("o_orderkey") % count)
            raw = raw.join(pages, F.col("_page") == F.col("page_id"), "left")
            columns |= SITE_SQL
        return _derive(raw, columns)

    def sites_under_rules(self) -> tuple[DataFrame, DataFrame]:
        """Orders with referring sites under rare and nested suffixes, and the table of rules."""
        sites = {"order_id": "o_orderkey", "referring_site": RULED_SITE_SQL}
        lines = self.spark.createDataFrame([(rule,) for rule in SUFFIX_RULES], "value string")
        return _derive(self.table("orders"), sites), suffix_rules(lines)

    def lines(self) -> DataFrame:
        """Order lines without order-level columns."""
        return _derive(self.table("lineitem"), LINE_SQL)

    def order_lines(self, **options) -> DataFrame:
        """Order lines with the order-level columns of their order."""
        return self.orders(**options).join(self.lines(), "order_id")

    def array_orders(self) -> DataFrame:
        """Orders whose lines are three parallel arrays, of 0 to 3 items and not all as long;
        these are made within each row, not collected."""
        number = F.col("order_number").cast("bigint")
        places = F.sequence(F.lit(1), F.lit(3))
        part = lambda i: F.pmod(number * 3 + i, F.lit(ARRAY_PARTS)) + 1
        skus = F.transform(places, lambda i: F.concat(F.lit("SKU-"), part(i).cast("string")))
        ids = F.transform(places, part)
        amounts = F.transform(places, lambda i: (F.pmod(number + i, F.lit(5)) + 1).cast("double"))
        length = F.pmod(number, F.lit(4)).cast("int")
        orders = self.orders(geography=True, referrers=True)
        return orders.withColumns(
            {
                "product_sku": F.when(length > 0, F.slice(skus, F.lit(1), length)),
                "product_ids": ids,
                "quantities": F.slice(amounts, F.lit(1), F.pmod(number, F.lit(3)).cast("int") + 1),
            }
        )

    def two_sku_products(self) -> DataFrame:
        """The catalog with two SKUs per product; the second is shared with another product."""
        following = F.concat(F.lit("SKU-"), (F.col("product_id") + 1).cast("string"))
        return self.products().withColumn("product_sku", F.array_append("product_sku", following))

    def products(self) -> DataFrame:
        """The catalog: two tags per product, none for some; some stock unknown."""
        return _derive(self.table("part"), PRODUCT_SQL)

    def customers(self) -> DataFrame:
        """The customer master, typed; some order counts unknown, some 0."""
        return typed_customers(_derive(self._located_customers(), CUSTOMER_SQL))

    def returns_sheet(self) -> DataFrame:
        """The text sheet of returns, with unreadable dates and blank quantities."""
        returned = self.table("lineitem").where(F.col("l_returnflag") == "R")
        parts = self.table("part").select("p_partkey", "p_name")
        named = returned.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
        return _derive(named, SHEET_SQL)

    def typed_in_sheet(self) -> DataFrame:
        """The sheet as typed in by hand: dates in many forms, quotes and line breaks in names."""
        day, number = F.to_date("Date"), F.length("Product Name") + F.col("Quantity").cast("double")
        forms = ("yyyy-MM-dd", "M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MMM d, yyyy")
        text = F.when(F.col("Date") == "n/a", F.lit("n/a"))
        for i, form in enumerate(forms):
            text = text.when(F.pmod(number, F.lit(len(forms))) == i, F.date_format(day, form))
        sheet = self.returns_sheet().where("Quantity <> ''")
        name = F.concat(F.lit('Tea "Gold", '), F.col("Product Name"), F.lit("\nline two"))
        readable = sheet.where("Date <> 'n/a'")
        return readable.withColumns({"Date": text, "Product Name": name})

    def returns(self) -> DataFrame:
        """The returns sheet, typed."""
        return typed_returns(self.returns_sheet())
