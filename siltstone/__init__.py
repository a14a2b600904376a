"""Siltstone: document retrieval and analytics as PySpark DataFrame operators."""
