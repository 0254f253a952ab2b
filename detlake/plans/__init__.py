"""Queries over the derived scene."""
