"""Distributed record sorting on Spark: keys, pivots, range exchange, ordered output."""
