"""Document analytics and grounded retrieval as composable PySpark stages."""

__version__ = "0.1.0"
