"""All registered queries, by operator id."""

from __future__ import annotations

from verification import flow_checks, grid_checks, impact_checks, run_checks, verb_checks


def all_checks() -> dict:
    """Name → (query(spark, sf_dir), oracle SQL or None)."""
    out: dict = {}
    for module in [flow_checks, grid_checks, impact_checks, verb_checks, run_checks]:
        out.update(module.checks())
    return out
