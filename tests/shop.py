"""Small shop tables for the tests: every column of the schemas, null unless given."""

from tillwise import schemas


def table(spark, schema, *rows):
    return spark.createDataFrame([[row.get(name) for name in schema.names] for row in rows], schema)


def orders(spark, *rows):
    return table(spark, schemas.ORDERS, *rows)


def products(spark, *rows):
    return table(spark, schemas.PRODUCTS, *rows)


def order(order_id, skus, quantities, **more):
    ids = None if skus is None else [f"id-{sku}" for sku in skus]
    return {
        "order_id": order_id,
        "product_sku": skus,
        "product_ids": ids,
        "quantities": quantities,
        **more,
    }


def product(name, skus, tags, price=10.0, **more):
    return {"product_name": name, "product_sku": skus, "product_tags": tags, "price": price, **more}


def rows(df, *columns):
    """The rows as sorted tuples; doubles to 9 digits, as sums of products that are no whole
    millionths may differ in the last bit."""
    picked = df.select(*columns) if columns else df
    found = [tuple(_plain(v) for v in r) for r in picked.collect()]
    return sorted(found, key=lambda r: [(v is None, v) for v in r])


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value
