"""Readers, writers and the binding of the driver's test tables to a panel."""
