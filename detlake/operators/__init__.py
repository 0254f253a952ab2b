"""Evaluation and dataset operators."""
