"""strandline: a Spark-first analytics engine for genomics tables."""

__version__ = "0.1.0"
