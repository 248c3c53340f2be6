"""corvane: a Spark-first engine for building, auditing and scoring function-calling corpora."""

__version__ = "0.1.0"
