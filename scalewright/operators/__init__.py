"""Filters, derivatives and diagnostics over cell tables."""
