"""Filters, sorts, index tables and aggregates as DataFrame transformations."""
