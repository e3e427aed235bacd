"""All results over the star-schema tables, and the same results in plain SQL."""
