"""Registered queries, their SQL oracles and the input views both are run on."""
