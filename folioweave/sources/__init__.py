"""Readers of document formats."""
