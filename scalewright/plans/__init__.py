"""Sweeps over scales, batches and slices, and the report on a setup."""
