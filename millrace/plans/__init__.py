"""Registered queries: each operator over the test tables, with the equivalent SQL."""
