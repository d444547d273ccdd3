"""Maskwright: document-privacy analytics as Spark DataFrame transformations."""
