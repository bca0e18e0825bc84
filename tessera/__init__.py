"""tessera: a Spark-first engine for retail and restaurant data at scale."""

__version__ = "0.1.0"
