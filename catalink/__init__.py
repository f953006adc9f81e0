"""catalink: bibliographic record linkage and catalogue analytics on PySpark."""

__version__ = "0.1.0"
