"""The registered queries as SQL over the same tables, derived independently.

Lines are joined to their orders directly and fanned out by tag, as the line-item table is
defined; nothing is summed before the product join.
"""

from __future__ import annotations

from ..sources.star import RULED_SITE_SQL


def _exact(value: str) -> str:
    """A sum with compensation for rounding; only the result is rounded."""
    return f"round(fsum({value}), 6)"


def _sum(value: str) -> str:
    return f"coalesce({_exact(value)}, 0)"


def _mean(value: str) -> str:
    return f"fsum({value}) / nullif(count({value}), 0)"


def _ratio(a: str, b: str, factor: str = "") -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b}{factor} ELSE 0.0::DOUBLE END"


PERIOD = "order_date >= DATE '1996-01-01' AND order_date < DATE '1999-01-01'"

_OF_PRODUCT = "order_id IN (SELECT order_id FROM li WHERE product_name = 'red widget')"

_SITE = """CASE o_orderkey % 16 WHEN 0 THEN NULL WHEN 1 THEN ''
  WHEN 2 THEN 'android-app://com.google.android.gm/'
  WHEN 3 THEN 'https://www.google.com/search?q=x' WHEN 4 THEN 'https://www.google.com/'
  WHEN 5 THEN 'https://l.instagram.com/' WHEN 6 THEN 'https://m.facebook.com/'
  WHEN 7 THEN 'https://shop.example/products/1' WHEN 8 THEN 'https://shop.example/?fbclid=1'
  WHEN 9 THEN 'https://www.reddit.com/r/x' ELSE url END"""

_SOURCE = """CASE WHEN coalesce(trim(referring_site), '') = '' THEN 'Direct/Unknown'
  WHEN starts_with(referring_site, 'android-app://com.google.android.gm') THEN 'Google Mail App'
  WHEN contains(referring_site, 'shop.example') AND contains(referring_site, '/products/')
    THEN 'Example Shop (Internal)'
  WHEN contains(referring_site, 'shop.example') AND contains(referring_site, 'fbclid=')
    THEN 'Example Shop (Paid Ads)'
  WHEN contains(referring_site, 'instagram.com') THEN 'Instagram'
  WHEN contains(referring_site, 'facebook.com') THEN 'Facebook'
  WHEN contains(referring_site, 't.co') THEN 'Twitter'
  WHEN contains(referring_site, 'google.com') AND contains(referring_site, '?q=')
    THEN 'Google Search'
  WHEN contains(referring_site, 'google.com') THEN 'Google Direct'
  WHEN regexp_extract(referring_site, '://([^/?#]*)', 1) SIMILAR TO '(.*[.])?example[.](com|net|org)'
    THEN 'Example' ELSE 'not expected' END"""

# The input tables. Each name may use the ones before it.
_TABLES = {
    "ord": f"""SELECT o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS order_date,
  o_orderdate AS order_updated_at, o_orderkey AS order_id,
  CAST(o_orderkey AS DOUBLE) AS order_number,
  CASE WHEN o_custkey % 50 <> 7 THEN o_custkey END AS customer_id,
  CAST(NULL AS VARCHAR) AS customer_email, CAST(NULL AS VARCHAR) AS cross_product_linkage,
  o_totalprice AS total_order_value,
  CASE WHEN o_orderkey % 5 = 1 THEN ''
       WHEN o_orderkey % 5 > 1 THEN 'CODE' || (o_orderkey % 23) END AS discount_applied,
  CAST((o_orderkey % 40) * 2.5 AS DOUBLE) AS discount_amount,
  CAST((o_orderkey % 30) * 1.25 AS DOUBLE) AS tax_amount,
  'paid' AS payment_status,
  CASE WHEN o_orderkey % 24 < 12 THEN 'fulfilled' END AS fulfillment_status,
  o_orderpriority AS shipping_method,
  CAST((o_orderkey % 7) * 10.0 AS DOUBLE) AS shipping_cost,
  {_SITE} AS referring_site, CAST(NULL AS VARCHAR) AS return_refund_status,
  CASE o_orderkey % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'pos' WHEN 2 THEN 'app' END AS order_channel,
  CASE o_orderkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'returning' END AS customer_type,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS order_status_from_tag,
  'Example' AS geography_country,
  CASE WHEN o_orderkey % 50 <> 0 THEN n_name END AS geography_state,
  CASE WHEN o_orderkey % 50 <> 0 THEN n_name || '-' || (o_custkey % 4) END AS geography_city,
  CAST(NULL AS VARCHAR) AS geography_postal_code,
  CASE WHEN o_orderkey % 50 <> 0 THEN CAST(8.0 + n_nationkey AS DOUBLE) END
    AS shipping_address_latitude,
  CASE WHEN o_orderkey % 50 <> 0 THEN CAST(68.0 + (o_custkey % 4) * 0.5 AS DOUBLE) END
    AS shipping_address_longitude
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN pages ON page_id = o_orderkey % (SELECT count(*) FROM pages)""",
    "od": "SELECT * FROM ord WHERE order_id IN (SELECT l_orderkey FROM lineitem)",
    "px": """SELECT p_name AS product_name, 'active' AS product_status, p_type AS product_type,
  p_retailprice AS price, CAST(NULL AS TIMESTAMP) AS product_created_at,
  CAST(NULL AS TIMESTAMP) AS product_updated_at,
  CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS stock_available,
  unnest([p_type, p_brand]) AS individual_product_tag, 'SKU-' || p_partkey AS product_sku,
  CAST(NULL AS DOUBLE) AS shipping_weight
FROM part WHERE p_size % 10 <> 0""",
    "li": f"""SELECT ord.*, 'SKU-' || l_partkey AS order_product_sku,
  l_partkey AS order_product_id, l_quantity AS quantity, px.*,
  l_quantity * price AS line_item_revenue,
  coalesce(order_status_from_tag, 'Other/Unknown') AS extracted_status,
  {_SOURCE} AS cleaned_referring_site,
  coalesce(individual_product_tag, 'Unknown Tag') AS product_tags_compound,
  coalesce(customer_type, 'Unknown') AS imputed_customer_type
FROM lineitem JOIN ord ON l_orderkey = order_id
LEFT JOIN px ON 'SKU-' || l_partkey = product_sku""",
    "cu": """SELECT c_custkey AS customer_id, c_name AS first_name,
  c_name || '@shop.example' AS email,
  CAST(DATE '1995-01-01' + CAST(c_custkey % 700 AS INTEGER) AS TIMESTAMP) AS signup_date,
  CAST(NULL AS TIMESTAMP) AS updated_at, c_acctbal AS total_spent,
  CASE WHEN c_custkey % 50 <> 49 THEN CAST(c_custkey % 5 AS DOUBLE) END AS orders_count,
  CASE WHEN c_custkey % 50 <> 49 THEN c_acctbal / nullif(c_custkey % 5, 0) END AS aov,
  c_custkey % 2 = 0 AS marketing_opt_in, n_name AS state,
  n_name || '-' || (c_custkey % 4) AS city,
  CASE WHEN c_custkey % 50 <> 49 AND c_custkey % 5 > 1 THEN 'Returning Customer'
       ELSE 'New/One-Time Customer' END AS imputed_customer_type
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "sheet": """SELECT CASE WHEN l_suppkey % 50 = 0 THEN 'n/a'
    ELSE strftime(l_shipdate, '%Y-%m-%d') END AS "Date",
  p_name AS "Product Name",
  CASE WHEN l_partkey % 97 = 0 THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS "Quantity",
  CASE l_linenumber % 5 WHEN 0 THEN 'Damaged / Late' WHEN 1 THEN 'wrong item' WHEN 2 THEN ''
    WHEN 4 THEN 'Bad taste, smell' END AS "Comments"
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'""",
    "ret": """SELECT CAST("Date" AS TIMESTAMP) AS return_date, "Product Name" AS product_name,
  CAST("Quantity" AS DOUBLE) AS returned_quantity, "Comments" AS return_comments
FROM sheet WHERE "Date" <> 'n/a' AND "Quantity" <> ''""",
}

_NEEDS = {"od": ["ord"], "li": ["ord", "px"], "ret": ["sheet"]}


def _with(tables: str, body: str, **more: str) -> str:
    """``body`` with the named input tables, and then ``more``, as common table expressions."""
    names: list[str] = []
    for name in tables.split():
        names += [n for n in [*_NEEDS.get(name, []), name] if n not in names]
    parts = [f"{name} AS ({_TABLES[name]})" for name in names]
    parts += [f"{name} AS ({text})" for name, text in more.items()]
    return f"WITH {', '.join(parts)}\n{body}"


def _kpis(where: str = "true", source: str = "od") -> str:
    return f"""SELECT *, {_ratio("total_revenue", "total_orders")} AS average_order_value FROM (
  SELECT {_sum("total_order_value")} AS total_revenue, count(order_id) AS total_orders,
    {_sum("discount_amount")} AS total_discount_amount, {_sum("tax_amount")} AS total_tax_amount,
    {_sum("shipping_cost")} AS total_shipping_cost
  FROM {source} WHERE {where})"""


def _revenue_by(column: str, table: str = "od") -> str:
    return f"""SELECT {column}, {_sum("total_order_value")} AS total_order_value
FROM {table} WHERE {column} IS NOT NULL GROUP BY 1"""


def _top(column: str, measure: str, k: int, table: str = "li") -> str:
    return f"""SELECT {column}, {_sum(measure)} AS {measure} FROM {table}
WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}"""


def _top_distinct(column: str, counted: str, name: str, table: str, k: int = 10) -> str:
    return f"""SELECT {column}, count(DISTINCT {counted}) AS {name} FROM {table}
WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}"""


def _shared(body: str, value: str) -> str:
    total = f"CAST(sum({value}) OVER () AS DOUBLE)"
    return f"SELECT *, {value} * 100.0::DOUBLE / {total} AS share_pct FROM ({body})"


_DISCOUNTS = f"""SELECT discount_applied, {_sum("discount_amount")} AS total_discount_amount,
  count(order_id) AS number_of_uses
FROM od WHERE discount_applied <> '' GROUP BY 1"""

_PRODUCT_KPIS = f"""SELECT *,
  {_ratio("total_product_revenue", "total_products_sold")} AS avg_product_price FROM (
  SELECT {_sum("quantity")} AS total_products_sold,
    {_sum("line_item_revenue")} AS total_product_revenue,
    count(DISTINCT product_sku) AS unique_products_sold FROM li WHERE {{where}})"""


def _daily(value: str, name: str, table: str) -> str:
    return f"SELECT CAST(order_date AS DATE) AS date, {value} AS {name} FROM {table} GROUP BY 1"


_CUSTOMER_KPIS = f"""SELECT count(DISTINCT customer_id) AS total_customers,
  {_sum("total_spent")} AS total_lifetime_spent, {_mean("orders_count")} AS avg_lifetime_orders,
  {_mean("aov")} AS avg_lifetime_aov FROM cu"""

_SIGNUPS = """SELECT CAST(signup_date AS DATE) AS date,
  count(DISTINCT customer_id) AS new_customers FROM cu GROUP BY 1"""

_GEO_KPIS = f"""SELECT {_sum("total_order_value")} AS total_revenue,
  count(order_id) AS total_orders, count(DISTINCT geography_state) AS unique_states,
  count(DISTINCT geography_city) AS unique_cities FROM od"""

_POINTS = f"""SELECT shipping_address_latitude, shipping_address_longitude, geography_city,
  {_sum("line_item_revenue")} AS total_revenue, {_sum("quantity")} AS total_quantity,
  count(DISTINCT order_id) AS order_count
FROM li WHERE shipping_address_latitude IS NOT NULL AND shipping_address_longitude IS NOT NULL
  AND geography_city IS NOT NULL AND line_item_revenue IS NOT NULL GROUP BY 1, 2, 3"""

_ARRAY_LINES = """SELECT ord.*, 'SKU-' || ((order_id * 3 + i) % 150 + 1) AS order_product_sku,
  (order_id * 3 + i) % 150 + 1 AS order_product_id,
  CAST((order_id + i) % 5 + 1 AS DOUBLE) AS quantity
FROM ord, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= least(order_id % 4, order_id % 3 + 1)"""

_VERSIONS = """SELECT CASE WHEN order_id % 97 <> 0 THEN order_id END AS order_id, order_number,
  CASE WHEN order_id % 3 = 0 THEN order_updated_at + INTERVAL 1 DAY ELSE order_updated_at END
    AS updated_at,
  CASE WHEN order_id % 3 = 0 THEN total_order_value / 2 ELSE total_order_value END
    AS total_order_value,
  CASE WHEN order_id % 3 = 0 THEN tax_amount + 5 ELSE tax_amount END AS tax_amount,
  discount_amount, shipping_cost FROM ord"""

_RFM = {
    "per_customer": f"""SELECT customer_id, max(order_date) AS last, count(*) AS "Frequency",
  {_exact("total_order_value")} AS "Monetary"
FROM od WHERE customer_id IS NOT NULL GROUP BY 1""",
    "aged": """SELECT *, (max(epoch_us(last)) OVER () + 86400000000 - epoch_us(last))
  // 86400000000 AS "Recency", count(*) OVER () AS n FROM per_customer""",
    "ranked": """SELECT *, row_number() OVER (ORDER BY "Recency" DESC, customer_id) AS r,
  row_number() OVER (ORDER BY "Frequency", customer_id) AS f,
  row_number() OVER (ORDER BY "Monetary", customer_id) AS m FROM aged""",
    "scored": """SELECT customer_id, "Recency", "Frequency", "Monetary",
  CAST(greatest(1, (5 * (r - 1) + n - 2) // (n - 1)) AS INTEGER) AS "R_Score",
  CAST(greatest(1, (5 * (f - 1) + n - 2) // (n - 1)) AS INTEGER) AS "F_Score",
  CAST(greatest(1, (5 * (m - 1) + n - 2) // (n - 1)) AS INTEGER) AS "M_Score" FROM ranked""",
    "rfm": """SELECT cu.*, coalesce("Recency", max("Recency") OVER () + 30) AS "Recency",
  coalesce("Frequency", 0) AS "Frequency", coalesce("Monetary", 0) AS "Monetary",
  coalesce("R_Score", 1) AS "R_Score", coalesce("F_Score", 1) AS "F_Score",
  coalesce("M_Score", 1) AS "M_Score",
  coalesce("R_Score" || '' || "F_Score" || "M_Score", '111') AS "RFM_Score",
  CASE WHEN "R_Score" IS NULL THEN 'New/Inactive'
    WHEN "R_Score" >= 4 AND "F_Score" >= 4 AND "M_Score" >= 4 THEN 'Champions'
    WHEN "R_Score" >= 4 AND "F_Score" >= 3 THEN 'Loyal Customers'
    WHEN "R_Score" >= 3 AND "F_Score" >= 3 AND "M_Score" >= 3 THEN 'Potential Loyalists'
    WHEN "R_Score" >= 3 AND "F_Score" < 3 AND "M_Score" < 3 THEN 'Needs Attention'
    WHEN "R_Score" <= 2 AND "F_Score" >= 4 THEN 'At Risk'
    WHEN "R_Score" <= 2 AND "F_Score" <= 2 AND "M_Score" <= 2 THEN 'Churned'
    WHEN "R_Score" >= 4 AND "F_Score" <= 2 THEN 'New Customers' ELSE 'Other' END
    AS "RFM_Segment"
FROM cu LEFT JOIN scored USING (customer_id)""",
}


def _rfm(body: str) -> str:
    return _with("od cu", body, **_RFM)


_RULED = f"""WITH rules AS (SELECT * FROM (VALUES ('com', 'plain'), ('org', 'plain'), ('uk', 'plain'),
  ('co.uk', 'plain'), ('a.b.com', 'plain'), ('agency', 'plain'), ('photography', 'plain'),
  ('bd', 'any'), ('ck', 'any'), ('www.ck', 'not')) AS v(name, kind)),
sites AS (SELECT o_orderkey AS order_id, {RULED_SITE_SQL} AS referring_site FROM orders),
hosts AS (
  SELECT DISTINCT host, string_split(host, '.') AS labels FROM (
    SELECT regexp_extract(referring_site, '://(?:[^/@]*@)?([^/:]*)', 1) AS host FROM sites)),
sizes AS (
  SELECT host, labels, max(CASE kind WHEN 'plain' THEN n WHEN 'any' THEN n + 1 END) AS longest,
    max(n - 1) FILTER (kind = 'not') AS instead
  FROM (SELECT *, len(string_split(name, '.')) AS n FROM hosts LEFT JOIN rules
    ON host = name AND kind <> 'any' OR ends_with(host, '.' || name)) GROUP BY 1, 2),
named AS (
  SELECT host, CASE WHEN host SIMILAR TO '[0-9.]+' THEN host
    WHEN coalesce(instead, longest) IS NULL THEN labels[-1]
    WHEN coalesce(instead, longest) = len(labels) THEN labels[-2]
    ELSE labels[len(labels) - coalesce(instead, longest)] END AS label FROM sizes)
SELECT order_id, referring_site, CASE WHEN referring_site IS NULL THEN 'Direct/Unknown'
  WHEN contains(referring_site, 'google.com') THEN 'Google Search'
  ELSE upper(label[1]) || label[2:] END AS cleaned_referring_site
FROM sites LEFT JOIN named ON host = regexp_extract(referring_site, '://(?:[^/@]*@)?([^/:]*)', 1)"""


def _rfm_top(where: str) -> str:
    return _rfm(f"""SELECT customer_id, first_name, email, "Recency", "Frequency", "Monetary",
  "R_Score", "F_Score", "M_Score", "RFM_Segment", CASE "RFM_Segment"
    WHEN 'Champions' THEN 'Reward them. They can be early adopters for new products.'
    WHEN 'Loyal Customers' THEN 'Engage them with loyalty programs and exclusive offers.'
    WHEN 'Potential Loyalists' THEN 'Offer incentives for repeat purchases and engagement.'
    WHEN 'New Customers' THEN 'Provide excellent onboarding and welcome offers.'
    WHEN 'At Risk' THEN 'Win them back with strong retention campaigns and personalized outreach.'
    WHEN 'Other' THEN 'Review manually, or refine RFM segmentation rules.'
    ELSE 'No specific action defined for this segment.' END AS "Proposed_Action"
FROM rfm WHERE {where} ORDER BY "Monetary" DESC, customer_id LIMIT 20""")


def _rvs(body: str, li: str = "true", ret: str = "true") -> str:
    sales = f"""SELECT CAST(order_date AS DATE) AS date, product_name,
  {_sum("quantity")} AS total_sold_quantity, {_sum("line_item_revenue")} AS total_sales_revenue
FROM li WHERE product_name IS NOT NULL AND {li} GROUP BY 1, 2"""
    back = f"""SELECT CAST(return_date AS DATE) AS date, product_name,
  {_sum("returned_quantity")} AS total_returned_quantity
FROM ret WHERE product_name IS NOT NULL AND {ret} GROUP BY 1, 2"""
    rvs = f"""SELECT *, total_returned_quantity * estimated_unit_price
  AS estimated_returned_value FROM (
  SELECT *, {_ratio("total_returned_quantity", "total_sold_quantity", " * 100")}
      AS return_rate_percentage,
    {_ratio("total_sales_revenue", "total_sold_quantity")} AS estimated_unit_price FROM (
    SELECT date, product_name, coalesce(total_sold_quantity, 0) AS total_sold_quantity,
      coalesce(total_sales_revenue, 0) AS total_sales_revenue,
      coalesce(total_returned_quantity, 0) AS total_returned_quantity
    FROM sold FULL JOIN back USING (date, product_name)))"""
    return _with("li ret", body, sold=sales, back=back, rvs=rvs)


_RETURN_KPIS = f"""SELECT *,
  {_ratio("total_returned", "total_sold", " * 100")} AS overall_return_rate FROM (
  SELECT {_sum("total_sold_quantity")} AS total_sold,
    {_sum("total_returned_quantity")} AS total_returned,
    {_sum("total_sales_revenue")} AS total_sales_value,
    {_sum("estimated_returned_value")} AS total_estimated_returned_value FROM rvs)"""


def _rollup(key: str) -> str:
    return f"""SELECT *,
  {_ratio("total_returned_quantity", "total_sold_quantity", " * 100")} AS return_rate_percentage
FROM (SELECT {key}, {_sum("total_returned_quantity")} AS total_returned_quantity,
    {_sum("total_sold_quantity")} AS total_sold_quantity,
    {_sum("estimated_returned_value")} AS estimated_returned_value FROM rvs GROUP BY 1)"""


def _short(x: str) -> str:
    a = f"abs({x})"
    return f"""CASE WHEN {x} IS NULL THEN 'N/A' ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END ||
  CASE WHEN {a} >= 1e9 THEN format('{{:.2f}}B', {a} / 1e9)
    WHEN {a} >= 1e6 THEN format('{{:.2f}}M', {a} / 1e6)
    WHEN {a} >= 1e3 AND {a} % 1000 = 0 THEN format('{{:d}}K', CAST({a} / 1e3 AS BIGINT))
    WHEN {a} >= 1e3 THEN format('{{:.1f}}K', {a} / 1e3)
    WHEN {a} = floor({a}) THEN format('{{:d}}', CAST({a} AS BIGINT))
    ELSE format('{{:.2f}}', {a}) END END"""


def _counters(table: str, **conditions: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS counter, count(*) FILTER ({condition}) AS n FROM {table}"
        for name, condition in conditions.items()
    )


# The columns of doubles in each result, which both engines round to 6 digits at the end.
_DOUBLES = {
    "line_items_by_line": "quantity price line_item_revenue",
    "line_items_refreshed": "quantity total_order_value line_item_revenue",
    "rfm_of_batches": "Monetary",
    "rfm_ranks": "Monetary",
    "line_items_of_arrays": "quantity line_item_revenue total_order_value",
    "sales_kpis_of_arrays": (
        "total_revenue total_discount_amount total_tax_amount total_shipping_cost "
        "average_order_value"
    ),
    "customer_kpis_readable": "total_lifetime_spent avg_lifetime_orders avg_lifetime_aov",
    "product_kpis_readable": "total_products_sold total_product_revenue avg_product_price",
    "orders_in_versions": "order_number total_order_value tax_amount",
    "sales_kpis_versions": (
        "total_revenue total_discount_amount total_tax_amount total_shipping_cost "
        "average_order_value"
    ),
    "line_items": (
        "order_number total_order_value discount_amount tax_amount shipping_cost "
        "shipping_address_latitude shipping_address_longitude quantity price stock_available "
        "shipping_weight line_item_revenue"
    ),
    "order_lines_from_arrays": "quantity",
    "top_products_quantity": "quantity",
    "top_tags_quantity": "quantity",
    "orders_in_scope": "total_order_value",
    "revenue_by_channel": "total_order_value",
    "revenue_by_status": "total_order_value",
    "top_referrers": "total_order_value",
    "orders_of_customers": "total_order_value",
    "sales_kpis": (
        "total_revenue total_discount_amount total_tax_amount total_shipping_cost "
        "average_order_value"
    ),
    "sales_kpis_period": (
        "total_revenue total_discount_amount total_tax_amount total_shipping_cost "
        "average_order_value"
    ),
    "sales_kpis_reversed_range": (
        "total_revenue total_discount_amount total_tax_amount total_shipping_cost "
        "average_order_value"
    ),
    "sales_kpis_empty": (
        "total_revenue total_discount_amount total_tax_amount total_shipping_cost "
        "average_order_value"
    ),
    "sales_kpis_filtered": (
        "total_revenue total_discount_amount total_tax_amount total_shipping_cost "
        "average_order_value"
    ),
    "sales_kpis_product": (
        "total_revenue total_discount_amount total_tax_amount total_shipping_cost "
        "average_order_value"
    ),
    "sales_kpis_by_order": (
        "total_revenue total_discount_amount total_tax_amount total_shipping_cost "
        "average_order_value"
    ),
    "lines_of_orders": "total_order_value quantity",
    "cube_kpis_filtered": (
        "total_revenue total_discount_amount total_tax_amount total_shipping_cost "
        "average_order_value"
    ),
    "cube_kpis_product": (
        "total_revenue total_discount_amount total_tax_amount total_shipping_cost "
        "average_order_value"
    ),
    "cube_daily_product": "revenue",
    "cube_by_channel": "total_order_value",
    "home_kpis": "total_revenue",
    "geo_kpis": "total_revenue",
    "geo_kpis_state": "total_revenue",
    "daily_revenue": "revenue",
    "daily_product_revenue": "revenue",
    "daily_revenue_last_6m": "revenue",
    "discount_summary": "total_discount_amount",
    "top_discounts": "total_discount_amount",
    "top_discounts_by_uses": "total_discount_amount",
    "product_kpis": "total_products_sold total_product_revenue avg_product_price",
    "product_kpis_tag": "total_products_sold total_product_revenue avg_product_price",
    "top_products_revenue": "line_item_revenue",
    "top_tags_revenue": "line_item_revenue",
    "state_revenue": "line_item_revenue",
    "city_revenue": "line_item_revenue",
    "tag_revenue_share": "value share_pct",
    "tag_quantity_share": "value share_pct",
    "daily_quantity": "quantity_sold",
    "customers_typed": "total_spent orders_count aov",
    "top_customers": "total_spent orders_count aov",
    "customer_kpis": "total_lifetime_spent avg_lifetime_orders avg_lifetime_aov",
    "customer_kpis_filtered": "total_lifetime_spent avg_lifetime_orders avg_lifetime_aov",
    "customer_type_mix": "share_pct",
    "rfm_segment_counts": "share_pct",
    "order_count_mix": "number_of_orders",
    "map_points": (
        "shipping_address_latitude shipping_address_longitude total_revenue total_quantity"
    ),
    "map_center": "center_lat center_lon",
    "rfm_customers": "total_spent orders_count aov Monetary",
    "rfm_segment_averages": "Avg_Recency Avg_Frequency Avg_Monetary",
    "rfm_top_customers": "Monetary",
    "rfm_top_customers_segment": "Monetary",
    "returns_typed": "returned_quantity",
    "returns_vs_sales": (
        "total_sold_quantity total_sales_revenue total_returned_quantity "
        "return_rate_percentage estimated_unit_price estimated_returned_value"
    ),
    "return_kpis": (
        "total_sold total_returned total_sales_value total_estimated_returned_value "
        "overall_return_rate"
    ),
    "return_kpis_period": (
        "total_sold total_returned total_sales_value total_estimated_returned_value "
        "overall_return_rate"
    ),
    "return_kpis_product": (
        "total_sold total_returned total_sales_value total_estimated_returned_value "
        "overall_return_rate"
    ),
    "product_returns": (
        "total_returned_quantity total_sold_quantity estimated_returned_value "
        "return_rate_percentage"
    ),
    "daily_returns": (
        "total_returned_quantity total_sold_quantity estimated_returned_value "
        "return_rate_percentage"
    ),
    "top_returned_qty": (
        "total_returned_quantity total_sold_quantity estimated_returned_value "
        "return_rate_percentage"
    ),
    "top_return_rate": (
        "total_returned_quantity total_sold_quantity estimated_returned_value "
        "return_rate_percentage"
    ),
}


# A third of the lines have one SKU and some none.
_HOT = """SELECT l_orderkey AS order_id, l_quantity AS quantity,
  CASE WHEN l_orderkey % 9 < 3 THEN 'SKU-1' WHEN l_orderkey % 9 > 3 THEN 'SKU-' || l_partkey END
    AS order_product_sku FROM lineitem"""


def _choice(cascade: str, turn: int, column: str, where: str = "true") -> str:
    """One choice list, as a query of its own."""
    return f"""SELECT '{cascade}' AS cascade, {turn} AS turn, '{column}' AS filter, {column} AS value
FROM li WHERE {column} IS NOT NULL AND {where}"""


def all_sql() -> dict[str, str]:
    """SQL per query name."""
    return {name: _rounded(sql, _DOUBLES.get(name, "").split()) for name, sql in _all().items()}


def _rounded(sql: str, names: list[str]) -> str:
    if not names:
        return sql
    rounds = ", ".join(f'round("{name}", 6) AS "{name}"' for name in names)
    return f"SELECT * REPLACE ({rounds}) FROM (\n{sql}\n)"


def _all() -> dict[str, str]:
    value = "total_order_value"
    daily_revenue = _daily(_sum(value), "revenue", "od")
    return {
        "line_items": _with("li", "SELECT * FROM li"),
        "order_lines_from_arrays": """SELECT l_orderkey AS order_id,
  'SKU-' || (l_partkey + i) AS order_product_sku, l_partkey + i AS order_product_id,
  l_quantity + i - 1 AS quantity
FROM lineitem, (SELECT unnest([1, 2, 3]) AS i)
WHERE i <= least(l_linenumber % 4, 2, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE 3 END)""",
        "line_items_of_arrays": _with(
            "ord px",
            f"""SELECT order_id, order_product_sku, order_product_id, quantity, product_sku,
  product_name, quantity * price AS line_item_revenue,
  coalesce(order_status_from_tag, 'Other/Unknown') AS extracted_status,
  {_SOURCE} AS cleaned_referring_site,
  coalesce(individual_product_tag, 'Unknown Tag') AS product_tags_compound,
  coalesce(customer_type, 'Unknown') AS imputed_customer_type, total_order_value,
  coalesce(individual_product_tag, '') AS tags
FROM made LEFT JOIN catalog ON order_product_sku = product_sku""",
            made=_ARRAY_LINES,
            catalog="""SELECT product_sku, product_name, price, individual_product_tag FROM px
UNION ALL SELECT 'SKU-' || (CAST(substr(product_sku, 5) AS BIGINT) + 1), product_name, price,
  individual_product_tag FROM px""",
        ),
        "line_items_by_line": _with(
            "ord",
            f"""SELECT order_id, line_number, order_product_sku, quantity, product_name, price,
  quantity * price AS line_item_revenue, {_SOURCE} AS cleaned_referring_site,
  coalesce(tags, 'Unknown Tag') AS product_tags_compound
FROM made LEFT JOIN firsts ON order_product_sku = 'SKU-' || firsts.sku
LEFT JOIN tags ON tags.sku = firsts.sku""",
            made=_ARRAY_LINES.replace("ord.*,", "ord.*, i AS line_number,"),
            catalog="""SELECT p_partkey + k AS sku, part.* FROM part, (SELECT unnest([0, 1]) AS k)
WHERE p_size % 10 <> 0""",
            firsts="""SELECT sku, arg_min(p_name, p_partkey) AS product_name,
  arg_min(p_retailprice, p_partkey) AS price FROM catalog GROUP BY 1""",
            tags="""SELECT sku, string_agg(tag, ', ' ORDER BY tag) AS tags FROM (
  SELECT DISTINCT sku, unnest([p_type, p_brand]) AS tag FROM catalog) GROUP BY 1""",
        ),
        "line_items_refreshed": _with(
            "li",
            """SELECT order_id, order_date, order_updated_at, order_product_sku, quantity,
  total_order_value, line_item_revenue, product_tags_compound FROM li""",
        ),
        "rfm_of_batches": _rfm("SELECT * FROM scored"),
        "rfm_ranks": _rfm(
            """SELECT customer_id, "Recency", "Frequency", "Monetary", r AS "R_Rank", f AS "F_Rank",
  m AS "M_Rank" FROM ranked"""
        ),
        "referrer_names_by_rules": _RULED,
        "sales_kpis_of_arrays": _with("ord", _kpis("order_id % 4 > 0", "ord")),
        "line_items_without_columns": """SELECT l_orderkey AS order_id, l_quantity AS quantity,
  'N/A (Site Data Missing)' AS cleaned_referring_site, 0.0::DOUBLE AS line_item_revenue,
  'N/A (Status Tag Missing)' AS extracted_status, '' AS product_tags_list,
  'N/A (Tags Missing)' AS product_tags_compound,
  'N/A (Customer Type Missing)' AS imputed_customer_type FROM lineitem""",
        "customer_kpis_readable": _with("cu", _CUSTOMER_KPIS + " WHERE customer_id % 10 <> 3"),
        "product_kpis_readable": _with("li", _PRODUCT_KPIS.format(where="order_id % 10 <> 3")),
        "date_bounds_without_signups": _with(
            "od",
            """SELECT CAST(min(order_date) AS DATE) AS min_date,
  CAST(max(order_date) AS DATE) AS max_date FROM od""",
        ),
        "product_tags_by_sku": _with(
            "px", "SELECT product_sku, product_name, individual_product_tag FROM px"
        ),
        "orders_in_scope": _with(
            "li",
            f"""SELECT DISTINCT order_id, customer_id, geography_city, total_order_value
FROM li WHERE {PERIOD} AND product_tags_compound = 'ECONOMY'""",
        ),
        "sales_kpis": _with("od", _kpis()),
        "sales_kpis_period": _with("od", _kpis(PERIOD)),
        "sales_kpis_reversed_range": _with("od", _kpis()),
        "sales_kpis_empty": _with("od", _kpis("false")),
        "sales_kpis_filtered": _with(
            "od", _kpis(f"order_channel = 'web' AND {_SOURCE} = 'Example'")
        ),
        "sales_kpis_product": _with(
            "od li",
            _kpis("order_id IN (SELECT order_id FROM li WHERE product_name = 'red widget')"),
        ),
        "home_kpis": _with(
            "od cu",
            f"""SELECT {_sum(value)} AS total_revenue, count(order_id) AS total_orders,
  (SELECT count(DISTINCT customer_id) FROM cu WHERE customer_id IN (
    SELECT customer_id FROM od WHERE {PERIOD})) AS total_customers
FROM od WHERE {PERIOD}""",
        ),
        "daily_revenue": _with("od", daily_revenue),
        "daily_orders": _with("od", _daily("count(order_id)", "orders", "od")),
        "revenue_by_channel": _with("od", _revenue_by("order_channel")),
        "revenue_by_status": _with("od", _revenue_by("order_status_from_tag")),
        "top_referrers": _with(
            "od",
            _top("cleaned_referring_site", value, 10, "named"),
            named=f"SELECT *, {_SOURCE} AS cleaned_referring_site FROM od",
        ),
        "discount_summary": _with("od", _DISCOUNTS),
        "top_discounts": _with("od", _DISCOUNTS + " ORDER BY 2 DESC, 1 LIMIT 10"),
        "top_discounts_by_uses": _with("od", _DISCOUNTS + " ORDER BY 3 DESC, 1 LIMIT 10"),
        "product_kpis": _with("li", _PRODUCT_KPIS.format(where="true")),
        "product_kpis_tag": _with(
            "li",
            _PRODUCT_KPIS.format(where=f"{PERIOD} AND product_tags_compound = 'ECONOMY'"),
        ),
        "top_products_revenue": _with("li", _top("product_name", "line_item_revenue", 10)),
        "top_products_quantity": _with("li", _top("product_name", "quantity", 10)),
        "top_tags_revenue": _with("li", _top("product_tags_compound", "line_item_revenue", 15)),
        "top_tags_quantity": _with("li", _top("product_tags_compound", "quantity", 15)),
        "tag_revenue_share": _with(
            "li",
            _shared(
                f"""SELECT product_tags_compound, {_sum("line_item_revenue")} AS value
FROM li GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
                "value",
            ),
        ),
        "tag_quantity_share": _with(
            "li",
            _shared(
                f"SELECT product_tags_compound, {_sum('quantity')} AS value FROM li GROUP BY 1",
                "value",
            ),
        ),
        "daily_product_revenue": _with("li", _daily(_sum("line_item_revenue"), "revenue", "li")),
        "daily_quantity": _with("li", _daily(_sum("quantity"), "quantity_sold", "li")),
        "low_stock": _with(
            "li",
            """SELECT * FROM (SELECT product_name, product_sku,
    CAST(trunc(coalesce(stock_available, 0)) AS INTEGER) AS stock_available FROM (
    SELECT *, row_number() OVER (PARTITION BY product_sku ORDER BY order_date DESC NULLS LAST,
      order_id DESC NULLS LAST, product_name DESC NULLS LAST, stock_available DESC NULLS LAST)
      AS newest FROM li) WHERE newest = 1) WHERE stock_available <= 20""",
        ),
        "customers_typed": _with("cu", "SELECT * FROM cu"),
        "customer_kpis": _with("cu", _CUSTOMER_KPIS),
        "customer_kpis_filtered": _with(
            "cu",
            _CUSTOMER_KPIS
            + """ WHERE signup_date >= DATE '1995-03-01' AND signup_date < DATE '1996-03-02'
  AND imputed_customer_type = 'Returning Customer' AND state = 'NATION_3'""",
        ),
        "daily_signups": _with("cu", _SIGNUPS),
        "customer_type_mix": _with(
            "cu",
            _shared(
                "SELECT imputed_customer_type, count(*) AS count FROM cu GROUP BY 1", "count"
            ),
        ),
        "order_count_mix": _with(
            "cu",
            """SELECT orders_count AS number_of_orders, count(*) AS number_of_customers
FROM cu WHERE orders_count IS NOT NULL GROUP BY 1""",
        ),
        "repeat_buyer_mix": _with(
            "cu",
            """SELECT CASE orders_count WHEN 1 THEN '1 (First-time Buyer)'
  WHEN 2 THEN '2 (Second-time Buyer)' ELSE '3+ (Repeat Buyer)' END AS order_group,
  count(*) AS number_of_customers FROM cu WHERE orders_count IS NOT NULL GROUP BY 1""",
        ),
        "customers_by_state": _with(
            "cu", _top_distinct("state", "customer_id", "number_of_customers", "cu")
        ),
        "customers_by_city": _with(
            "cu", _top_distinct("city", "customer_id", "number_of_customers", "cu")
        ),
        "top_customers": _with(
            "cu",
            """SELECT customer_id, total_spent, orders_count, aov FROM cu
ORDER BY total_spent DESC NULLS LAST, customer_id LIMIT 10""",
        ),
        "orders_of_customers": _with(
            "od cu",
            """SELECT order_id, customer_id, total_order_value FROM od
WHERE customer_id IN (SELECT customer_id FROM cu WHERE state = 'NATION_3')""",
        ),
        "geo_kpis": _with("od", _GEO_KPIS),
        "geo_kpis_state": _with("od", _GEO_KPIS + " WHERE geography_state = 'NATION_3'"),
        "map_points": _with(
            "li",
            """SELECT *, 'City: ' || geography_city || '<br>Revenue: ₹' ||
  format('{:,}', CAST(trunc(total_revenue) AS BIGINT)) ||
  right(format('{:.2f}', total_revenue), 3) || '<br>Orders: ' || order_count ||
  '<br>Quantity: ' || CAST(total_quantity AS BIGINT) || '.0' AS tooltip_text FROM points""",
            points=_POINTS,
        ),
        "map_center": _with(
            "li",
            """SELECT coalesce(avg(shipping_address_latitude), 20.5937) AS center_lat,
  coalesce(avg(shipping_address_longitude), 78.9629) AS center_lon FROM points""",
            points=_POINTS,
        ),
        "state_revenue": _with("li", _top("geography_state", "line_item_revenue", 10)),
        "city_revenue": _with("li", _top("geography_city", "line_item_revenue", 10)),
        "state_orders": _with("li", _top_distinct("geography_state", "order_id", "orders", "li")),
        "city_orders": _with("li", _top_distinct("geography_city", "order_id", "orders", "li")),
        "rfm_customers": _rfm("SELECT * FROM rfm"),
        "rfm_segment_counts": _rfm(
            _shared(
                'SELECT "RFM_Segment", count(*) AS number_of_customers FROM rfm GROUP BY 1',
                "number_of_customers",
            )
        ),
        "rfm_score_hist": _rfm(
            """SELECT score_name, score, count(*) AS number_of_customers FROM (
  SELECT 'R_Score' AS score_name, "R_Score" AS score FROM rfm UNION ALL
  SELECT 'F_Score', "F_Score" FROM rfm UNION ALL
  SELECT 'M_Score', "M_Score" FROM rfm) GROUP BY 1, 2"""
        ),
        "rfm_segment_averages": _rfm(
            f"""SELECT "RFM_Segment", round_even({_mean('"Recency"')} * 100, 0) / 100
    AS "Avg_Recency",
  round_even({_mean('"Frequency"')} * 100, 0) / 100 AS "Avg_Frequency",
  round_even({_mean('"Monetary"')} * 100, 0) / 100 AS "Avg_Monetary",
  count(DISTINCT customer_id) AS "Customer_Count" FROM rfm GROUP BY 1"""
        ),
        "rfm_top_customers": _rfm_top("true"),
        "rfm_top_customers_segment": _rfm_top("\"RFM_Segment\" = 'Needs Attention'"),
        "returns_sheet": _with("sheet", "SELECT * FROM sheet"),
        "returns_typed": _with("ret", "SELECT * FROM ret"),
        "returns_from_csv": _with(
            "ret",
            """SELECT return_date, 'Tea "Gold", ' || product_name || chr(10) || 'line two'
  AS product_name, returned_quantity, coalesce(return_comments, '') AS return_comments FROM ret""",
        ),
        "sales_kpis_by_order": _with("od", _kpis()),
        "lines_of_orders": _with(
            "ord",
            """SELECT order_id, any_value(total_order_value) AS total_order_value,
  count(l_orderkey) AS n_lines, sum(l_quantity) AS quantity
FROM ord LEFT JOIN lineitem ON l_orderkey = order_id GROUP BY 1""",
        ),
        "returns_losses": _with(
            "sheet",
            _counters(
                "sheet",
                rows_read="true",
                rows_dropped="""("Date" = 'n/a' OR "Quantity" = '')""",
                unreadable_return_date="""("Date" = 'n/a')""",
                blank_return_date="""("Date" = '')""",
                unreadable_returned_quantity="""("Quantity" <> '' AND TRY_CAST("Quantity" AS DOUBLE) IS NULL)""",
                blank_returned_quantity="""("Quantity" = '')""",
            ),
        ),
        "line_items_written": _with(
            "li",
            _counters(
                "li",
                rows_written="true",
                without_date="order_date IS NULL",
                without_product="product_sku IS NULL",
            ),
        ),
        "returns_unreadable": _with(
            "sheet",
            """SELECT "Date" AS return_date, "Product Name" AS product_name,
  "Quantity" AS returned_quantity, "Comments" AS return_comments
FROM sheet WHERE "Date" = 'n/a' OR "Quantity" = ''""",
        ),
        "orders_in_versions": _with(
            "ord",
            """SELECT order_id, order_number, total_order_value, tax_amount FROM versions
WHERE order_id IS NOT NULL UNION ALL SELECT * FROM (
  SELECT order_id, order_number, total_order_value, tax_amount FROM versions WHERE order_id IS NULL
  ORDER BY updated_at DESC, order_number DESC LIMIT 1)""",
            versions=_VERSIONS,
        ),
        "sales_kpis_versions": _with(
            "ord",
            _kpis("true", "kept"),
            versions=_VERSIONS,
            kept="""SELECT * FROM versions WHERE order_id IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT * FROM (SELECT * FROM versions WHERE order_id IS NULL
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey % 97 = 0)
  ORDER BY updated_at DESC, total_order_value DESC, discount_amount DESC, tax_amount DESC,
    shipping_cost DESC LIMIT 1)""",
        ),
        "returns_vs_sales": _rvs("SELECT * FROM rvs"),
        "return_kpis": _rvs(_RETURN_KPIS),
        "return_kpis_period": _rvs(
            _RETURN_KPIS, PERIOD, PERIOD.replace("order_date", "return_date")
        ),
        "return_kpis_product": _rvs(
            _RETURN_KPIS, "product_name = 'red widget'", "product_name = 'red widget'"
        ),
        "product_returns": _rvs(_rollup("product_name")),
        "daily_returns": _rvs(_rollup("date")),
        "top_returned_qty": _rvs(
            _rollup("product_name") + " ORDER BY total_returned_quantity DESC, 1 LIMIT 10"
        ),
        "top_return_rate": _rvs(
            _rollup("product_name")
            + """ WHERE total_sold_quantity > 0 OR total_returned_quantity = 0
ORDER BY return_rate_percentage DESC, 1 LIMIT 10"""
        ),
        "top_return_comments": _with(
            "ret",
            """SELECT CASE return_comments WHEN 'Damaged / Late' THEN 'damaged-late'
    WHEN 'wrong item' THEN 'wrong-item' WHEN 'Bad taste, smell' THEN 'bad-taste-smell'
    ELSE '' END AS comment, count(*) AS count
FROM ret WHERE return_comments IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        ),
        "referrer_names": _with(
            "ord",
            f"""SELECT DISTINCT referring_site, {_SOURCE} AS cleaned_referring_site FROM ord""",
        ),
        "raw_referrer_counts": _with(
            "li",
            """SELECT referring_site AS raw_referring_site, count(*) AS count FROM li
WHERE referring_site IS NOT NULL GROUP BY 1""",
        ),
        "raw_referrer_total": _with(
            "li", "SELECT count(DISTINCT referring_site) AS unique_referring_sites FROM li"
        ),
        "raw_referrers": _with(
            "li",
            """SELECT DISTINCT referring_site AS raw_referring_site FROM li
WHERE referring_site IS NOT NULL""",
        ),
        "raw_referrer_search": _with(
            "li",
            """SELECT DISTINCT referring_site AS raw_referring_site FROM li
WHERE contains(lower(referring_site), 'google')""",
        ),
        "filter_values_tag": _with("li", "SELECT DISTINCT product_tags_compound FROM li"),
        "filter_values_city": _with(
            "li",
            """SELECT DISTINCT geography_city FROM li
WHERE geography_state = 'NATION_3' AND geography_city IS NOT NULL""",
        ),
        "product_name_choices": _with(
            "li ret",
            """SELECT product_name FROM li WHERE product_name IS NOT NULL
UNION SELECT product_name FROM ret WHERE product_name IS NOT NULL""",
        ),
        "date_bounds_orders": _with(
            "od",
            """SELECT greatest(DATE '1994-01-01', CAST(min(order_date) AS DATE)) AS min_date,
  CAST(max(order_date) AS DATE) AS max_date FROM od""",
        ),
        "date_bounds_signups": _with(
            "cu",
            """SELECT CAST(min(signup_date) AS DATE) AS min_date,
  CAST(max(signup_date) AS DATE) AS max_date FROM cu""",
        ),
        "date_bounds_returns": _with(
            "od ret",
            """SELECT DATE '1996-01-01' AS min_date, greatest(
  (SELECT CAST(max(order_date) AS DATE) FROM od),
  (SELECT CAST(max(return_date) AS DATE) FROM ret)) AS max_date""",
        ),
        "daily_revenue_last_6m": _with(
            "od",
            "SELECT * FROM d WHERE date >= (SELECT max(date) FROM d) - INTERVAL 6 MONTH",
            d=daily_revenue,
        ),
        "daily_signups_ytd": _with(
            "cu",
            "SELECT * FROM d WHERE date >= (SELECT date_trunc('year', max(date)) FROM d)",
            d=_SIGNUPS,
        ),
        "number_texts": _with(
            "ord",
            f"""SELECT order_id, {_short(value)} AS plain, {_short(f"-{value} / 1000")} AS small,
  {_short(f"({value} * 100)")} AS millions, {_short(f"({value} * 100000)")} AS billions,
  {_short(f"(floor({value} / 1000) * 1000)")} AS thousands,
  '₹ ' || {_short("discount_amount")} AS money, '₹ ' || format('{{:.2f}}', tax_amount)
    AS two_digits,
  format('{{:,}}', CAST(round_even({value} / 7, 0) AS BIGINT)) AS count,
  format('{{:.2f}}%', {value} / 7000) AS percent FROM ord""",
        ),
        "frequent_skus": _with(
            "",
            """SELECT order_product_sku AS key, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM hot), 6) AS share FROM hot
WHERE order_product_sku IS NOT NULL GROUP BY ALL
HAVING count(*) >= 0.0005::DOUBLE * (SELECT count(*) FROM hot)""",
            hot=_HOT,
        ),
        "hot_sku_order_totals": _with(
            "px",
            f"""SELECT order_id, {_sum("quantity")} AS quantity, {_sum("quantity * price")}
  AS line_item_revenue, count(*) AS line_rows
FROM hot LEFT JOIN px ON order_product_sku = product_sku GROUP BY order_id""",
            hot=_HOT,
        ),
        "hot_sku_line_items": _with(
            "ord px",
            """SELECT hot.order_id, order_product_sku, quantity, product_name, product_sku,
  coalesce(individual_product_tag, 'Unknown Tag') AS product_tags_compound,
  round(quantity * price, 6) AS line_item_revenue, order_channel
FROM hot JOIN ord ON hot.order_id = ord.order_id
LEFT JOIN px ON order_product_sku = product_sku""",
            hot=_HOT,
        ),
        "cube_kpis_filtered": _with("od", _kpis(f"{PERIOD} AND order_channel = 'web'")),
        "cube_kpis_product": _with("od li", _kpis(f"{PERIOD} AND {_OF_PRODUCT}")),
        "cube_daily_product": _with(
            "od li",
            f"""SELECT CAST(order_date AS DATE) AS date, {_sum("total_order_value")} AS revenue,
  count(order_id) AS orders FROM od WHERE {_OF_PRODUCT} GROUP BY 1""",
        ),
        "cube_by_channel": _with(
            "od",
            f"""SELECT order_channel, {_sum("total_order_value")} AS total_order_value,
  count(order_id) AS orders FROM od
WHERE geography_state = 'NATION_3' AND order_channel IS NOT NULL GROUP BY 1""",
        ),
        "cube_orders_of_products": _with(
            "li",
            f"""SELECT geography_state, count(DISTINCT order_id) AS orders FROM li
WHERE {PERIOD} AND product_name IN ('red widget', 'red plate', 'blue ring', 'hot bolt')
  AND geography_state IS NOT NULL GROUP BY 1""",
        ),
        "choices_of_pages": _with(
            "li",
            "\nUNION ".join(
                [
                    _choice("overview", 1, "product_name", PERIOD),
                    _choice("overview", 2, "order_channel", PERIOD),
                    _choice("overview", 3, "cleaned_referring_site", f"{PERIOD} AND order_channel = 'web'"),
                    _choice(
                        "overview",
                        4,
                        "discount_applied",
                        f"{PERIOD} AND order_channel = 'web' AND cleaned_referring_site = 'Google Direct'",
                    ),
                    _choice("products", 1, "product_name", PERIOD),
                    _choice(
                        "products", 2, "product_tags_compound", f"{PERIOD} AND product_name = 'red widget'"
                    ),
                    _choice("customers", 1, "imputed_customer_type"),
                    _choice("geography", 1, "geography_state"),
                    _choice("geography", 2, "geography_city", "geography_state = 'NATION_3'"),
                ]
            ),
        ),
    }
