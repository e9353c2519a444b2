"""rowloom: a single-table query engine on PySpark."""

__version__ = "0.1.0"
