"""Relational, window and data-quality operators."""
