"""Registered queries over the driver's tables, with their SQL."""
