"""Registered queries, one module per area of the operator inventory."""
