"""quarry: a Spark-first SQL analytics engine."""

__version__ = "0.1.0"
