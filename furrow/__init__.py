"""Furrow: environmental footprints of traded commodities as Spark DataFrame jobs."""
