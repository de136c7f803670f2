"""vettable: governed data-quality checks, repairs and selection on Spark."""

__version__ = "0.1.0"
