"""Composite plans (whole corpus stages) and the query registry."""
