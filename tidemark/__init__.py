"""tidemark: point-in-time feature engineering and data preparation on PySpark."""

__version__ = "0.1.0"
