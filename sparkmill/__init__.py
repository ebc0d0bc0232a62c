"""sparkmill: a Spark-first engine for record generation, validation, curation and profiling."""

__version__ = "0.1.0"
