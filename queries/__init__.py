"""Registered queries: each runs a library operator over registers derived from the given tables,
with an equivalent SQL text written independently of the operator."""
