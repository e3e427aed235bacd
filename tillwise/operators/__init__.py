"""Building blocks: line items, order grain, filters, rankings."""
