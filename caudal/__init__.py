"""Demand analytics on Spark: daily consumption by (planta, sku) in, checked panels, forecasts and scores out."""
