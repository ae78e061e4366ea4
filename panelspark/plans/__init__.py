"""Registered queries, their SQL oracles, and the job flows."""
