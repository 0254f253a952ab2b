"""Scalar functions: geometry and masks."""
