"""Folioweave: document version history and corpus analytics as PySpark DataFrames."""
