"""graintide: a Spark-first engine for building and auditing text corpora."""

__version__ = "0.1.0"
