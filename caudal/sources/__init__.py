"""Readers of exports and forecast files, and the Parquet tables results are kept in."""
