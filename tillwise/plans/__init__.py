"""The analytical results. Each function takes rows of a stated grain and returns a frame.

*orders*: one row per order (``operators.orders``). *lines*: the line-item table, or any
table with the same sums under the same names (``operators.line_items.sku_sales``). Filters
are applied to the rows before (``operators.filters``).
"""
