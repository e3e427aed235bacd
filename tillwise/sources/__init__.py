"""Readers of the shop's tables, the returns sheet, and stored line items."""
