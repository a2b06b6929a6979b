"""Registered queries: what the operators compute on the driver tables, and the same in SQL."""
