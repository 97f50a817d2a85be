"""Schemas and column rules."""
