"""Continuous refresh of the customer rollup."""
