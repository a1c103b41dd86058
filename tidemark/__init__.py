"""tidemark: a time-series storage, retrieval and data-processing engine on PySpark."""

__version__ = "0.1.0"
