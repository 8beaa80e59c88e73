"""Kernels and geometry as plain functions and Column expressions."""
