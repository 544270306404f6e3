"""Whole queries: the engine's API, the query catalogue over the test tables, and its SQL oracles."""
