"""Listing analytics on Spark: landed pages in, scored listings out."""
