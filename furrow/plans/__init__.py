"""Whole runs: the operators chained from input tables to result tables."""
