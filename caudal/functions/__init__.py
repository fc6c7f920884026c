"""Column expressions: calendar arithmetic, SKU keys, safe numbers, scores and text matching."""
