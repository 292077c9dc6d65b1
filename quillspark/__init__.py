"""Document retrieval, structure-aware reading and data processing on PySpark."""

__version__ = "0.1.0"
