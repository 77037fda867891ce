"""actaloom: a Spark-first engine for document corpora and the graphs that connect them."""

__version__ = "0.1.0"
