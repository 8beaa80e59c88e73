"""Operators for large text and page tables; nothing else in the library imports this package."""
